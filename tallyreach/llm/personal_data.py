"""Personal data in texts, by weak supervision.

Patterns propose spans: the strict ones of the base rules, and wider ones for how people also write
such things. Labelers vote on every proposal: the base rule, a check of its form, a gazetteer and the
words before it. Expectation-maximisation learns from the whole corpus how far each vote can be
trusted, without any labelled span, and the proposals so weighted train a naive Bayes span classifier
that also sees the span's shape. Base spans always stay; the classifier adds others.

Everything here is built from DataFrame functions. What comes to the driver are sums for each kind.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreach.llm.common import documents, texts
from tallyreach.sources.storage import scratch_table

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.95
ROUNDS = 12
CONTEXT_CHARS = 30
BLOCK = 64

# The base rules. Loops never give back what they took, as nothing after them could use it; a local
# part is only tried where it begins, or right after the match before.
STRICT = {
    "email": (
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
    ),
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# How the same things are written otherwise: spelled-out signs, the new address format, no plus.
WIDE = {
    "email": (
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)) ?"
        r"[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]++)++"
    ),
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": (
        r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])"
    ),
}
# What a text must hold for a pattern to be worth trying.
SIGNS = {"email": ("@", "(?i)[\\[(]at[\\])]"), "phone": ("+", None)}

# Top-level domains, words that announce a kind, and words that speak against it.
DOMAINS = (
    "com", "org", "net", "edu", "gov", "int", "info", "biz", "io", "eu", "de", "fr", "es", "it",
    "uk", "us", "ch", "at", "nl", "be", "pt", "br", "mx", "ca", "au", "jp", "cn", "in",
)
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write to|kontakt|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|ips|host|server|address|addr|login|from)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|karte|tarjeta|carte|payment)\b",
    "phone": r"(?i)\b(?:tel|phone|call|mobile|cell|fax|telefon|telefono|whatsapp)\b",
}
DOUBTS = r"(?i)(?:\b(?:version|release|token|order|invoice|isbn|serial|build|section)\b|[=#$])"

_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
VOTES = ("v_rule", "v_form", "v_gazetteer", "v_context")
SHAPES = ("f_edge", "f_size", "f_style")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """The check digit of at most 19 digits."""
    reverse = F.reverse(digits)

    def add(total: Column, place: Column) -> Column:
        digit = F.substring(reverse, place, F.lit(1))
        doubled = F.translate(digit, "0123456789", "0246813579")
        value = F.when(place % 2 == 0, doubled).otherwise(digit).try_cast("int")
        return total + F.coalesce(value, F.lit(0))

    places = F.sequence(F.lit(1), F.lit(19))
    return F.aggregate(places, F.lit(0), add) % 10 == 0


def is_valid(kind: str, value: Column) -> Column:
    """Whether a match of the kind's base pattern is one of its base spans."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    digits = _digits(value)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.length(digits).between(14, 19) & passes_luhn(digits)


def _matches(text: Column, pattern: str, sign: str | None, literal: bool) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if sign is None:
        return found
    worth = F.contains(text, F.lit(sign)) if literal else text.rlike(sign)
    return F.when(worth, found).otherwise(F.array().cast("array<string>"))


def with_matches(frame: DataFrame, name: str, pattern: str, sign: str | None, literal: bool) -> DataFrame:
    """Add ``name``: an array of value and start (in code points, from 0) of the pattern's matches.

    The text between two matches tells how far they are apart. Distances are summed in blocks, so that
    a text with very many matches takes little more than its length.
    """
    found, steps, sums, before = (f"{name} {part}" for part in ("found", "steps", "sums", "before"))
    frame = frame.withColumn(found, _matches(F.col("text"), pattern, sign, literal))
    gaps = F.split(F.col("text"), pattern, -1)
    # The step before a match: the gap before it and the match before that.
    step = lambda gap, at: F.length(gap) + F.coalesce(F.length(F.get(found, at - 1)), F.lit(0))
    frame = frame.withColumn(
        steps,
        F.when(F.size(found) > 0, F.slice(F.transform(gaps, step), F.lit(1), F.size(found))),
    )
    add = lambda total, value: total + value
    total_of = lambda values: F.aggregate(values, F.lit(0), add)
    block_numbers = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int"))
    frame = frame.withColumn(
        sums,
        F.when(
            F.size(found) > 0,
            F.transform(block_numbers, lambda b: total_of(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))),
        ),
    )
    frame = frame.withColumn(
        before, F.transform(sums, lambda _, b: total_of(F.slice(sums, F.lit(1), b)))
    )

    def placed(value: Column, at: Column) -> Column:
        block = F.floor(at / BLOCK).cast("int")
        inside = total_of(F.slice(steps, block * BLOCK + 1, at - block * BLOCK + 1))
        return F.struct(value.alias("value"), (F.get(before, block) + inside).alias("start"))

    return frame.withColumn(name, F.transform(found, placed)).drop(found, steps, sums, before)


def _vote(yes: Column, no: Column | None = None) -> Column:
    against = F.lit(0) if no is None else F.when(no, -1).otherwise(0)
    return F.when(yes, 1).otherwise(against).cast("int")


def _gazetteer(kind: str, value: Column) -> Column:
    if kind == "email":
        known = F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1)).isin(*DOMAINS)
        return _vote(known, ~known)
    if kind == "card":  # the first digits that issuers use
        issued = _digits(value).rlike("^(?:4|5[1-5]|2[2-7]|3[4-7]|6)")
        return _vote(issued, ~issued)
    if kind == "phone":  # no country or area code begins with a zero
        return _vote(_digits(value).rlike("^[1-9]"), _digits(value).rlike("^0"))
    return _vote(value.rlike(r"^(?:[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])\."), value.rlike(r"^0"))


def _form(kind: str, value: Column, wide: bool) -> Column:
    if not wide:
        return _vote(is_valid(kind, value), ~is_valid(kind, value))
    if kind == "phone":
        return _vote(F.length(_digits(value)) == 10)
    return _vote(value.rlike(r"[\[(.]") if kind == "email" else value.rlike("[A-Fa-f]"))


def _proposal(kind: str, wide: bool, text: Column, value: Column, start: Column) -> Column:
    """A span with the votes on it and what its shape is."""
    end = start + F.length(value)
    first = F.greatest(start - CONTEXT_CHARS, F.lit(0))
    before = F.substring(text, first + 1, start - first)
    after = F.substring(text, end + 1, F.lit(1))
    base = F.lit(False) if wide else is_valid(kind, value)
    edge = before.rlike(r"[\p{L}\p{N}]$").cast("int") + 2 * after.rlike(r"^[\p{L}\p{N}]").cast("int")
    return F.struct(
        start.alias("start"),
        F.lit(KINDS.index(kind)).alias("kind"),
        end.alias("end"),
        base.alias("base"),
        _vote(base).alias("v_rule"),
        _form(kind, value, wide).alias("v_form"),
        _gazetteer(kind, value).alias("v_gazetteer"),
        _vote(before.rlike(CUES[kind]), before.rlike(DOUBTS)).alias("v_context"),
        edge.alias("f_edge"),
        F.least(F.floor(F.length(value) / 6), F.lit(5)).cast("int").alias("f_size"),
        (value.rlike(r"[\x20()]").cast("int") + 2 * value.rlike("-").cast("int")).alias("f_style"),
    )


def _proposer(kind: str, wide: bool) -> Callable[[Column], Column]:
    return lambda match: _proposal(kind, wide, F.col("text"), match["value"], match["start"])


def proposals(docs: DataFrame) -> DataFrame:
    """doc_id and the array ``spans`` of all proposed spans, a row for each row of ``docs``."""
    frame = texts(docs)
    parts = []
    for wide, patterns in ((False, STRICT), (True, WIDE)):
        for kind, pattern in patterns.items():
            name = f"{kind} {wide}"
            sign = SIGNS.get(kind, (None, None))[wide]
            frame = with_matches(frame, name, pattern, sign, literal=not wide)
            parts.append(F.transform(name, _proposer(kind, wide)))
    return frame.select("doc_id", F.concat(*parts).alias("spans"))


def _by_value(kind: Column, column: Column, table: dict[tuple[int, int], float]) -> Column:
    """The number that ``table`` has for a kind and a value, 0 where it has none."""
    chosen = F.lit(0.0)
    for (of_kind, value), number in table.items():
        chosen = F.when((kind == of_kind) & (column == value), number).otherwise(chosen)
    return chosen


def _odds(of: Callable[[str], Column], model: dict) -> Column:
    """The log odds that a span is personal data."""
    total = _by_value(of("kind"), F.lit(0), {(k, 0): v for k, v in model["prior"].items()})
    for name, table in model["values"].items():
        total = total + _by_value(of("kind"), of(name), table)
    return total


def _fitted(patterns: DataFrame, chance: Column, names: tuple[str, ...]) -> dict:
    """Naive Bayes log odds from patterns that are personal data with a chance, add-one smoothed."""
    sums = [
        F.struct(
            F.lit(name).alias("name"), F.col(name).alias("value")
        )
        for name in ("kind", *names)
    ]
    rows = (
        patterns.withColumn("chance", chance)
        .select("kind", "n", "chance", F.explode(F.array(*sums)).alias("at"))
        .groupBy("kind", "at.name", "at.value")
        .agg(F.sum(F.col("n") * F.col("chance")).alias("yes"), F.sum("n").alias("all"))
        .collect()
    )
    totals = {r["kind"]: (r["yes"], r["all"] - r["yes"]) for r in rows if r["name"] == "kind"}
    values: dict[str, dict[tuple[int, int], float]] = {name: {} for name in names}
    for r in rows:
        if r["name"] != "kind":
            yes, no = totals[r["kind"]]
            values[r["name"]][r["kind"], r["value"]] = math.log((r["yes"] + 1) / (yes + 3)) - math.log(
                (r["all"] - r["yes"] + 1) / (no + 3)
            )
    prior = {kind: math.log((yes + 1) / (no + 1)) for kind, (yes, no) in totals.items()}
    return {"prior": prior, "values": values}


def train(spans: DataFrame, rounds: int = ROUNDS) -> dict:
    """Log odds of the span classifier, learned from all proposals.

    Proposals are counted by their votes and shape, of which there are a few thousand at most. A first
    guess follows the sum of the votes; then reliabilities and chances are estimated in turns.
    """
    columns = ("kind", *VOTES, *SHAPES)
    patterns = scratch_table(
        spans.select(F.explode("spans").alias("span"))
        .groupBy(*[F.col(f"span.{name}").alias(name) for name in columns])
        .agg(F.count("*").alias("n")),
        "span-patterns",
    )
    chance = F.lit(0.0)
    for name in VOTES:
        chance = chance + F.col(name)
    chance = 1 / (1 + F.exp(-2 * chance))
    for _ in range(rounds):
        model = _fitted(patterns, chance, VOTES)
        chance = 1 / (1 + F.exp(-_odds(F.col, model)))
    return _fitted(patterns, chance, (*VOTES, *SHAPES))


def _as_text(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts and places of personal data, a row for each row of ``docs``.

    ``n_email`` to ``n_phone`` count the base spans, ``base_sha256`` is the digest of their list, and
    ``spans`` lists them with those that the classifier adds (chance of at least 0.95, touching no base
    span of their kind). A list has kind:start:end by start and then kind, in code points, the end
    exclusive. NULL and empty texts have no spans. Rows without an id and repeated rows are treated
    like others. A corpus without proposals, or an empty table, trains nothing and adds nothing. Other
    columns are ignored. Texts are searched as a whole, however long.
    """
    proposed = scratch_table(proposals(docs), "proposals")
    odds = train(proposed)
    enough = math.log(ACCEPT / (1 - ACCEPT))
    place = lambda s: F.struct(s["start"], s["kind"], s["end"])
    split = proposed.withColumn("base", F.filter("spans", lambda s: s["base"]))

    def is_added(span: Column) -> Column:
        touched = F.exists(
            "base",
            lambda b: (b["kind"] == span["kind"]) & (b["start"] < span["end"]) & (span["start"] < b["end"]),
        )
        return ~span["base"] & (_odds(lambda name: span[name], odds) >= enough) & ~touched

    split = split.withColumns(
        {
            "base_list": F.array_sort(F.transform("base", place)),
            "added": F.transform(F.filter("spans", is_added), place),
        }
    )

    def count_of(at: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == at)).cast("long")

    counts = [count_of(at).alias(f"n_{kind}") for at, kind in enumerate(KINDS)]
    return split.select(
        "doc_id",
        *counts,
        F.sha2(_as_text(F.col("base_list")), 256).alias("base_sha256"),
        _as_text(F.array_sort(F.concat("base_list", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def op5_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return personal_data(documents(spark, sf))
