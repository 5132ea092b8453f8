"""Repaired conversations against the SQL's table of costs, and against all edits of short ones."""

import itertools
import random

import duckdb
import pandas as pd
import pytest

from compare import cell
from tallyreach.llm import conversations as subject

SCHEMA = "conv_id long, turn long, role string, text string, grp string, rank string, size string"
TEXTS = ["Yes.", "No!  ", "What?\n", "cut off", "", " \t", "Yes.", "\u8a9e.", "\u8a9e", "a.b", None]
ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", "User", "usher", None]


def frame_of(spark, rows):
    return spark.createDataFrame([(*row, "a", "b", "c") for row in rows], SCHEMA)


def by_sql(rows):
    database = duckdb.connect()
    database.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        database.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    cursor = database.execute(subject.OP12_SQL)
    names = [column[0] for column in cursor.description]
    return sorted((tuple(cell(v) for v in row) for row in cursor.fetchall()), key=str), names


def check(spark, rows, bits=subject.BLOCK_BITS):
    want, names = by_sql(rows)
    got = subject.repair_report(frame_of(spark, rows), bits).select(*names).collect()
    assert sorted((tuple(cell(v) for v in row) for row in got), key=str) == want


def drawn(draw, conv, length):
    regular = ["user", "assistant"]
    for place in range(length):
        turn = draw.choice([place, place, place, place + 2, None if draw.random() < 0.1 else place])
        role = regular[place % 2] if draw.random() < 0.6 else draw.choice(ROLES)
        text = f"Line {place}." if draw.random() < 0.6 else draw.choice(TEXTS)
        yield conv, turn, role, text


def test_conversations_of_all_kinds(spark):
    draw = random.Random(3)
    rows = [row for conv in range(150) for row in drawn(draw, conv, draw.randint(1, 9))]
    rows += list(drawn(draw, None, 7)) + [(900, None, None, None)] * 3 + rows[:5]
    check(spark, rows)


@pytest.mark.parametrize("bits", [1, 2, 5])
def test_long_conversations_in_blocks(spark, bits):
    draw = random.Random(bits)
    rows = [row for conv, size in enumerate((300, 64, 63, 65, 33, 5)) for row in drawn(draw, conv, size)]
    check(spark, rows, bits)


def test_conversation_of_one_text(spark):
    check(spark, [(1, turn, "user", "Again.") for turn in range(600)] + [(2, 0, "system", "x")])


def test_no_conversation(spark):
    check(spark, [])


def test_conversations_that_lose_all_rows(spark):
    # Every conversation of one row: some are dropped by the damage.
    rows = [(conv, 0, "user", "Hello.") for conv in range(60)]
    check(spark, rows)


def plain_best(codes):
    """The lightest audit by trying all edits, with up to two insertions in a gap."""
    best = None
    gaps = [()] + [("I",) * n for n in (1, 2)]
    for edits in itertools.product("KRD", repeat=len(codes)):
        for inserted in itertools.product(gaps, repeat=len(codes) + 1):
            audit, cost, flow = "", 0, []
            for place, (initial, fault) in enumerate(codes):
                audit += "".join(inserted[place]) + edits[place]
                flow += [None] * len(inserted[place])
                cost += 5 * len(inserted[place])
                if edits[place] == "D":
                    cost += 2
                    continue
                if fault in ("blank", "duplicate"):
                    break
                cost += (edits[place] == "R") + 5 * (fault == "truncated")
                flow.append(initial if edits[place] == "K" else None)
            else:
                audit += "".join(inserted[-1])
                flow += [None] * len(inserted[-1])
                cost += 5 * len(inserted[-1])
                wanted = ("s" if len(flow) % 2 else "") + "ua" * (len(flow) // 2)
                if wanted != "s" and all(a == b for a, b in zip(wanted, flow) if b is not None):
                    if not (wanted[:1] == "s" and flow[0] is None):
                        best = min(best or (cost, audit), (cost, audit))
    return best


def test_agenda_finds_the_lightest_of_all_edits():
    draw = random.Random(9)
    kinds = [(i, f) for i in "sua-" for f in subject.FAULTS]
    cases = [[draw.choice(kinds) for _ in range(draw.randint(0, 4))] for _ in range(60)]
    for codes in cases:
        spans = [subject.row_spans(*code) for code in codes]
        chart, _ = subject.derive(spans, subject.NOTHING, True, (subject.INSERT, "I"))
        assert chart[subject.GOAL] == plain_best(codes), codes


def test_repaired_rows(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hi!"), (1, 3, "user", " "),
        (2, 0, "user", "Alone?"),
        (3, 0, "user", "cut"), (3, 1, "assistant", "Fine."),
    ]
    report, found = subject.repair(frame_of(spark, rows))
    assert {r["grp"]: (r["cost"], r["audit"]) for r in report.collect()} == {
        "=1": (3, "KRKD"), "=2": (2, "D"), "=3": (4, "DD")
    }
    assert sorted(map(tuple, found.collect())) == [
        ("=1", 0, "system", "Be kind."), ("=1", 1, "user", "Hello."), ("=1", 2, "assistant", "Hi!")
    ]
