"""Repair of the structure of conversations by Knuth's lightest derivations.

An item is a prefix of a conversation and the role that its repaired rows end in. It is derived from a
shorter prefix and a span (what is done to the next row, or to a block of rows), or from an insertion. A
derivation weighs (cost, audit), which deductions add up and put together; so no conclusion is lighter than
its antecedents, and the agenda may finalise items in the order of their weights, until the goal comes up.

Long conversations are derived block by block: a block has a lightest derivation from each role before it to
each role after it, and such spans are the axioms of the next level. An insertion belongs to the row
after it, so no audit of a block is the beginning of another one, and the place of an audit among those of
its block stands for it above. The way back picks a span in every block.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyreach.llm.common import SPACES, crc_sql
from tallyreach.llm.ranks import group_of, numbered
from tallyreach.sources.storage import scratch_table

BLOCK_BITS = 8
MOST_SOLVED = 2_000
# What the repaired rows so far end in.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
GOAL = (-1, -1)
# The costs and the letters of the audit.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FAULTS = ("", "blank", "duplicate", "truncated")
# The role that may follow: user after all but user, assistant after user.
FOLLOWS = {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL = ("su", "ua", "au")


def row_spans(initial: str, fault: str) -> dict[tuple[int, int], tuple[int, str]]:
    """What can be done to a row: the weight of getting from one role to the next."""
    spans = {(role, role): (DELETE, "D") for role in range(4)}
    if fault in ("blank", "duplicate"):
        return spans
    more = TRUNCATED if fault == "truncated" else 0
    own = INITIALS.get(initial)
    for before, after in FOLLOWS.items():
        spans[before, after] = (KEEP + more, "K") if own == after else (REROLE + more, "R")
    if own == SYSTEM:
        spans[NOTHING, SYSTEM] = (KEEP + more, "K")
    return spans


def derive(spans: list[dict], start: int, closing: bool, insert=None) -> tuple[dict, dict]:
    """Lightest derivations of all items from ``start``: their weights and the items they come from.

    ``insert`` is the weight of an insertion; after the last span it is allowed where the conversation
    is ``closing``, and then the derivation ends with the goal.
    """
    end = len(spans)
    empty = insert[1][:0] if insert else ()
    agenda = [((0, empty), (0, start), None)]
    chart, origin = {}, {}
    by_start = [
        {q: [(r, w) for (p, r), w in span.items() if p == q] for q in range(4)} for span in spans
    ]
    while agenda:
        weight, item, source = heapq.heappop(agenda)
        if item in chart:
            continue
        chart[item], origin[item] = weight, source
        if item == GOAL:
            break
        at, role = item
        # Each deduction has the item and a span as antecedents; its weight is their superior function.
        found = []
        if at < end:
            found = [((at + 1, r), w) for r, w in by_start[at][role]]
        elif closing and role in ENDS:
            found = [(GOAL, (0, empty))]
        if insert and (at < end or closing):
            found.append(((at, FOLLOWS[role]), insert))
        for conclusion, (cost, audit) in found:
            if conclusion not in chart:
                heapq.heappush(agenda, ((weight[0] + cost, weight[1] + audit), conclusion, item))
    return chart, origin


def path(origin: dict, item: tuple[int, int]) -> list[int]:
    """The roles after each span, on the way to ``item``."""
    roles: dict[int, int] = {}
    while item is not None:
        # Of items at one place the last one comes first: what is before the next span.
        if item != GOAL:
            roles.setdefault(item[0], item[1])
        item = origin[item]
    return [roles[at] for at in range(1, max(roles) + 1)]


def summary(spans: list[dict], whole: bool, closing: bool, insert=None) -> list[dict]:
    """The lightest derivation from each role to each role; of a ``whole`` conversation that of the goal.

    ``rank`` is the audit's place among the audits of the block.
    """
    found = []
    for start in (NOTHING,) if whole else range(4):
        chart, origin = derive(spans, start, closing, insert)
        goals = [GOAL] if whole else [(len(spans), role) for role in range(4)]
        for goal in goals:
            if goal in chart:
                cost, audit = chart[goal]
                # Rows are reached by their letters, blocks by the roles after each.
                found.append((start, goal[1], cost, audit, [] if insert else path(origin, goal)))
    order = {audit: place for place, audit in enumerate(sorted({row[3] for row in found}))}
    return [
        {"q": q, "r": r, "cost": cost, "rank": order[audit], "audit": audit if insert else "", "path": p}
        for q, r, cost, audit, p in found
    ]


SPANS = "array<struct<q:int,r:int,cost:long,rank:int,audit:string,path:array<int>>>"
SPANS_ARROW = pa.list_(
    pa.struct(
        [("q", pa.int32()), ("r", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()),
         ("audit", pa.string()), ("path", pa.list_(pa.int32()))]
    )
)
STATS = ("blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn")
BLOCK_SCHEMA = (
    f"grp string, size long, rank long, spans {SPANS}, first string, last string, "
    + ", ".join(f"{name} long" for name in STATS)
)
UPPER_SCHEMA = f"grp string, size long, rank long, spans {SPANS}"


def _blocks_of(batches: Iterator[pa.RecordBatch], names: list[str], bits: int) -> Iterator[tuple]:
    """grp, size, number and rows of each block, from sorted rows whose blocks are whole in a task."""
    key, held = None, []
    for batch in batches:
        for group, size, rank, *rest in zip(
            *(batch.column(c).to_pylist() for c in ("grp", "size", "rank", *names))
        ):
            own = (group, size, rank >> bits)
            if own != key:
                if held:
                    yield (*key, held)
                key, held = own, []
            held.append(rest)
    if held:
        yield (*key, held)


def _row_blocks(bits: int):
    schema = pa.schema(
        [("grp", pa.string()), ("size", pa.int64()), ("rank", pa.int64()), ("spans", SPANS_ARROW),
         ("first", pa.string()), ("last", pa.string()), *((name, pa.int64()) for name in STATS)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solved: dict[tuple, list] = {}
        rows = []
        for group, size, block, held in _blocks_of(batches, ["initial", "fault", "turn"], bits):
            whole, closing = size <= 1 << bits, block == (size - 1) >> bits
            codes = tuple((initial, fault) for initial, fault, _ in held)
            # Blocks of the same roles and faults have the same derivations.
            case = (codes, whole, closing)
            if case not in solved:
                if len(solved) > MOST_SOLVED:
                    solved.clear()
                solved[case] = summary([row_spans(*c) for c in codes], whole, closing, (INSERT, "I"))
            turns = [turn for _, _, turn in held if turn is not None]
            rows.append(
                {
                    "grp": group, "size": size, "rank": block, "spans": solved[case],
                    "first": codes[0][0], "last": codes[-1][0],
                    **{name: sum(fault == name for _, fault in codes) for name in FAULTS[1:]},
                    "illegal": sum(a[0] + b[0] not in LEGAL for a, b in zip(codes, codes[1:])),
                    "turns": len(set(turns)),
                    "first_turn": turns[0] if turns else None,
                    "last_turn": turns[-1] if turns else None,
                }
            )
            if len(rows) == 500:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _upper_blocks(bits: int):
    schema = pa.schema(
        [("grp", pa.string()), ("size", pa.int64()), ("rank", pa.int64()), ("spans", SPANS_ARROW)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, size, block, held in _blocks_of(batches, ["spans"], bits):
            spans = [
                {(s["q"], s["r"]): (s["cost"], (s["rank"],)) for s in below} for (below,) in held
            ]
            found = summary(spans, size <= 1 << bits, block == (size - 1) >> bits)
            row = {"grp": group, "size": size, "rank": block, "spans": found}
            yield pa.RecordBatch.from_pylist([row], schema)

    return run


def _ordered(rows: DataFrame, bits: int) -> DataFrame:
    block = F.shiftright("rank", bits)
    return rows.repartition("grp", block).sortWithinPartitions("grp", "rank")


def derivations(codes: DataFrame, bits: int = BLOCK_BITS) -> tuple[DataFrame, DataFrame]:
    """cost and audit of each group, and a row of counts for each of its blocks.

    ``codes`` has for each row of a conversation grp, rank, size, initial, fault and turn.
    """
    lowest = _ordered(codes, bits).mapInArrow(_row_blocks(bits), BLOCK_SCHEMA)
    lowest = scratch_table(lowest, "derivations-0")
    size = F.ceil(F.col("size") / (1 << bits))
    levels = [lowest]
    while True:
        rest = levels[-1].filter(size > 1).select("grp", "rank", size.alias("size"), "spans")
        if rest.isEmpty():
            break
        upper = _ordered(rest, bits).mapInArrow(_upper_blocks(bits), UPPER_SCHEMA)
        levels.append(scratch_table(upper, f"derivations-{len(levels)}"))
    # The way back: the spans that the level above has picked, and the goals of groups that end here.
    picked, costs = None, None
    for level in reversed(levels):
        spans = level.select("grp", "size", "rank", F.explode("spans").alias("span")).select(
            "grp", "size", "rank", *(f"span.{name}" for name in ("q", "r", "cost", "audit", "path"))
        )
        goals = spans.filter(size == 1)
        totals = goals.select("grp", "cost")
        costs = totals if costs is None else costs.unionAll(totals)
        columns = ["grp", "rank", "audit", "path"]
        here = goals.select(*columns)
        if picked is not None:
            here = here.unionAll(spans.join(picked, ["grp", "rank", "q", "r"]).select(*columns))
        if level is lowest:
            break
        before = F.when(F.col("nth") == 0, F.col("start")).otherwise(
            F.element_at("path", F.when(F.col("nth") == 0, 1).otherwise(F.col("nth")))
        )
        # A span's first role is picked together with it.
        starts = goals.select("grp", "rank", F.lit(NOTHING).alias("start"), "path")
        if picked is not None:
            starts = starts.unionAll(
                spans.join(picked, ["grp", "rank", "q", "r"]).select("grp", "rank", F.col("q").alias("start"), "path")
            )
        picked = (
            starts.select("grp", "rank", "start", "path", F.posexplode("path").alias("nth", "r"))
            .select(
                "grp",
                (F.shiftleft("rank", bits) + F.col("nth")).alias("rank"),
                before.alias("q"),
                "r",
            )
        )
        picked = scratch_table(picked, "picked")
    # One audit a conversation: a letter for each row, and for each insertion.
    audits = here.groupBy("grp").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "audit"))), lambda s: s["audit"]), "").alias("audit")
    )
    return audits.join(costs, "grp"), lowest


def marked(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with ``grp`` and ``digest``, by which rows of a turn are ordered."""
    plain = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    content = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return plain.withColumn("grp", group_of(F.col("conv_id"))).withColumn(
        "digest", F.unhex(F.sha2(content, 256))
    )


def faults(rows: DataFrame) -> DataFrame:
    """grp, rank, size, turn, initial and the first fault of each of the :func:`marked` rows."""
    stripped = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(stripped == "", "blank").when(
        ~F.substring(stripped, -1, 1).isin(".", "!", "?"), "truncated"
    )
    initial = F.substring("role", 1, 1)
    coded = rows.select(
        "grp",
        "turn",
        "digest",
        F.when(initial.isin(*INITIALS), initial).otherwise("-").alias("initial"),
        F.coalesce(fault, F.lit("")).alias("fault"),
        # Spreads rows that are the same in everything.
        F.monotonically_increasing_id().alias("salt"),
    )
    ranked = scratch_table(numbered(coded, ["turn", "digest", "salt"], "rows").drop("salt"), "ranked")
    # Only contents that come again have a later row.
    firsts = (
        ranked.groupBy("grp", "digest")
        .agg(F.min("rank").alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    firsts = scratch_table(firsts, "firsts")
    again = (F.col("fault") != "blank") & (F.col("rank") > F.col("first"))
    return ranked.join(firsts, ["grp", "digest"], "left").select(
        "grp", "rank", "size", "turn", "initial", F.when(again, "duplicate").otherwise(F.col("fault")).alias("fault")
    )


def counts(blocks: DataFrame) -> DataFrame:
    """grp, gaps, blank, duplicate, truncated and illegal, from the counts of the blocks."""
    along = Window.partitionBy("grp").orderBy("rank")
    met = F.lag("last").over(along)
    # The last turn of any block before: NULL turns come first.
    earlier = F.lag("last_turn").over(along)
    return (
        blocks.withColumn("met", met)
        .withColumn("earlier", earlier)
        .withColumn(
            "illegal",
            F.col("illegal")
            + F.when(F.col("met").isNull() | F.concat("met", "first").isin(*LEGAL), 0).otherwise(1),
        )
        .withColumn("turns", F.col("turns") - F.when(F.col("earlier") == F.col("first_turn"), 1).otherwise(0))
        .groupBy("grp")
        .agg(
            F.coalesce(
                F.max("last_turn") - F.min("first_turn") + 1 - F.sum("turns"), F.lit(0)
            ).alias("gaps"),
            *(F.sum(name).alias(name) for name in (*FAULTS[1:], "illegal")),
        )
    )


REPAIRED_SCHEMA = "grp string, place long, role string, text string"


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired rows, from each conversation's audit followed by its rows in order."""
    names = ("grp", "audit", "role", "text")
    found: list[list] = [[], [], [], []]

    def put(role: str | None, text: str) -> None:
        nonlocal place
        if role is None:
            role = "assistant" if (place + odd) % 2 else "user"
        for column, value in zip(found, (group, place, role, text)):
            column.append(value)
        place += 1

    def batch_of() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
        arrays = [pa.array(column, kind) for column, kind in zip(found, kinds)]
        for column in found:
            column.clear()
        return pa.RecordBatch.from_arrays(arrays, names=["grp", "place", "role", "text"])

    audit, at, place, odd = "", 0, 0, 0
    for batch in batches:
        for group, edits, role, text in zip(*(batch.column(c).to_pylist() for c in names)):
            if edits is not None:
                audit, at, place = edits, 0, 0
                # An odd number of rows begins with the system's.
                odd = (len(edits) - edits.count("D")) % 2
            else:
                while audit[at] == "I":
                    put(None, "")
                    at += 1
                if audit[at] != "D":
                    put(role if audit[at] == "K" else None, text)
                at += 1
            # Insertions after the last row.
            if audit and at < len(audit) and not audit[at:].strip("I"):
                put(None, "")
                for _ in audit[at + 1 :]:
                    put(None, "")
                at = len(audit)
        if found[0]:
            yield batch_of()


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """grp, place, role and text of the repaired conversations, in order within each task.

    A conversation streams through one task, row by row; it isn't collected.
    """
    none = F.lit(None).cast("string")
    heads = audits.select(
        "grp", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"),
        F.lit(None).cast("binary").alias("digest"), "audit", none.alias("role"), none.alias("text"),
    )
    bodies = rows.select("grp", F.lit(1).alias("kind"), "turn", "digest", none.alias("audit"), "role", "text")
    return (
        heads.unionAll(bodies)
        .repartition("grp")
        .sortWithinPartitions("grp", "kind", "turn", "digest")
        .select("grp", "audit", "role", "text")
        .mapInArrow(_applied, REPAIRED_SCHEMA)
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lines ``role:text`` of each conversation, from sorted rows."""
    key, state = None, None
    for batch in batches:
        groups, digests = [], []
        for group, role, text in zip(*(batch.column(c).to_pylist() for c in ("grp", "role", "text"))):
            if group != key:
                if state is not None:
                    groups.append(key)
                    digests.append(state.hexdigest())
                key, state = group, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays(
            [pa.array(groups, pa.string()), pa.array(digests, pa.string())], names=["grp", "digest"]
        )
    if state is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([key], pa.string()), pa.array([state.hexdigest()], pa.string())], names=["grp", "digest"]
        )


def repair(rows: DataFrame, bits: int = BLOCK_BITS) -> tuple[DataFrame, DataFrame]:
    """A report on each conversation (grp, gaps, blank, duplicate, truncated, illegal, cost, audit), and
    its repaired rows (grp, place, role, text).

    ``rows`` has conv_id, turn, role and text; others are ignored. A NULL role or text is one space. Rows
    without conv_id are one conversation, whose ``grp`` is empty; that of others is ``=`` and the id. Rows
    go by turn, NULL first, and within a turn by the SHA-256 of role and text. A row is blank, else
    a duplicate of an earlier one with its role and text, else truncated (it doesn't end with ``.``,
    ``!`` or ``?``). The cheapest edits (Keep 0; Rerole to user or assistant 1; Delete 2; Insert 5; 5 more
    for a truncated row that stays; blank and duplicate rows have to go) give pairs of user and assistant, with or without
    one system row first, or nothing; of equal costs the first audit in ASCII. Texts of any length
    are taken whole. An empty table gives no rows.
    """
    rows = marked(rows)
    audits, blocks = derivations(faults(rows), bits)
    audits = scratch_table(audits, "audits")
    return counts(blocks).join(audits, "grp"), repaired(rows, audits)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with faults drawn by the CRC-32 of ``conv_id:turn``."""
    shown = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    copies = F.when(draw == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.filter(draw != 0).select(
        "conv_id",
        "turn",
        F.when(draw == 4, "user").otherwise(shown("role")).alias("role"),
        text.alias("text"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def repair_report(conversations: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """The report on every conversation after :func:`damaged`, with the digest of its repaired rows."""
    report, rows = repair(damaged(conversations), bits)
    digests = rows.mapInArrow(_digests, "grp string, repaired_sha256 string")
    every = conversations.select("conv_id").distinct().withColumn("grp", group_of(F.col("conv_id")))
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        every.join(report, "grp", "left")
        .join(digests, "grp", "left")
        .select(
            "conv_id",
            *map(zero, ("gaps", *FAULTS[1:], "illegal", "cost")),
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
        )
    )


def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return repair_report(spark.read.parquet(f"{sf}/conversations.parquet"))


def _more(weight: str, cost: str, letter: str) -> str:
    return f"(lpad((substr({weight}, 1, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || substr({weight}, 13) || '{letter}')"


def _step(own: str, role: str) -> str:
    """From the state ``own``, the row of the code c is kept as ``role`` or gets it."""
    return (
        f"CASE WHEN c.gone THEN NULL WHEN c.initial = '{role}' THEN {_more(own, 'c.more', 'K')} "
        f"ELSE {_more(own, 'c.more + 1', 'R')} END"
    )


OP12_SQL = f"""
WITH RECURSIVE source AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {crc_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS draw
    FROM conversations
), hurt AS (
    SELECT conv_id, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role,
        CASE draw WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(CASE draw WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM source WHERE draw <> 0
), placed AS (
    SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS stripped,
        row_number() OVER (PARTITION BY conv_id
            ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text), copy) AS i
    FROM hurt
), seen AS (
    SELECT *, min(i) OVER (PARTITION BY conv_id, role, text) AS first,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
    FROM placed
), coded AS (
    SELECT *, left(role, 1) AS initial, stripped = '' AS blank, stripped <> '' AND i > first AS duplicate,
        stripped <> '' AND i = first AND right(stripped, 1) NOT IN ('.', '!', '?') AS truncated
    FROM seen
), codes AS (
    SELECT *, blank OR duplicate AS gone, CASE WHEN truncated THEN 5 ELSE 0 END AS more FROM coded
), walk(conv_id, i, f, s, u, a) AS (
    SELECT DISTINCT conv_id, 0::BIGINT, repeat('0', 12), NULL::VARCHAR, {_more("repeat('0', 12)", "5", "I")},
        {_more(_more("repeat('0', 12)", "5", "I"), "5", "I")} FROM codes
    UNION ALL
    SELECT conv_id, i, f, s, u1, least(a, {_more("u1", "5", "I")}) FROM (
        SELECT *, least(u, {_more("f", "5", "I")}, {_more("s", "5", "I")}, {_more("a", "5", "I")}) AS u1 FROM (
            SELECT w.conv_id, c.i, {_more("w.f", "2", "D")} AS f,
                least({_more("w.s", "2", "D")},
                    CASE WHEN c.initial = 's' AND NOT c.gone THEN {_more("w.f", "c.more", "K")} END) AS s,
                least({_more("w.u", "2", "D")}, {_step("w.f", "u")}, {_step("w.s", "u")}, {_step("w.a", "u")}) AS u,
                least({_more("w.a", "2", "D")}, {_step("w.u", "a")}) AS a
            FROM walk w JOIN codes c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.i = w.i + 1
        )
    )
), ends AS (
    SELECT conv_id, max_by(least(f, a), i) AS best FROM walk GROUP BY conv_id
), audits AS (
    SELECT conv_id, substr(best, 1, 12)::BIGINT AS cost, substr(best, 13) AS audit FROM ends
), letters AS (
    SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k,
        unnest(string_split(audit, '')) AS letter
    FROM audits
), counted AS (
    SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER w AS i,
        count(*) FILTER (WHERE letter <> 'D') OVER w - 1
            + count(*) FILTER (WHERE letter <> 'D') OVER (PARTITION BY conv_id) AS place
    FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)
), lines AS (
    SELECT l.conv_id, l.k,
        CASE WHEN letter = 'K' THEN c.role WHEN place % 2 = 0 THEN 'user' ELSE 'assistant' END
            || ':' || CASE WHEN letter = 'I' THEN '' ELSE c.text END AS line
    FROM counted l LEFT JOIN codes c
        ON c.conv_id IS NOT DISTINCT FROM l.conv_id AND c.i = l.i AND l.letter <> 'I'
    WHERE letter <> 'D'
), texts AS (
    SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY k)) AS repaired_sha256 FROM lines GROUP BY conv_id
), stats AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
        count(*) FILTER (WHERE truncated) AS truncated,
        count(*) FILTER (WHERE i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM codes GROUP BY conv_id
)
SELECT e.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank,
    coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated,
    coalesce(s.illegal, 0) AS illegal, coalesce(a.cost, 0) AS cost, coalesce(a.audit, '') AS audit,
    coalesce(t.repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e
LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM e.conv_id
"""
