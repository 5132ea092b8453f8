"""A Merkle manifest of a table of documents, with a witness for each.

Leaves are numbered within their language by range partition and cut into aligned blocks of 2**LEVELS.
A block is one stream of appends: a leaf opens a subtree, two neighbours of the same height close to one,
and all that lie below get the other's digest attached to their witness. So a witness grows with every
sibling that is completed, and nothing but the open subtrees of one block is kept. Block roots are appended
likewise as leaves of the level above, until a language has one node; the languages' nodes are the leaves
of one last tree. A document's witness is that of its block, then that of the block's root, and so on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreach.llm.common import crc_sql, documents
from tallyreach.llm.ranks import group_of, numbered
from tallyreach.sources.storage import scratch_table

LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# In a witness: how the node at a level is joined with its sibling.
LONE, SIBLING_LEFT, SIBLING_RIGHT = 0, 1, 2
DIGEST = 32


def digest(*parts: bytes) -> bytes:
    """SHA-256 of the parts' lowercase hex texts, one after the other."""
    return hashlib.sha256("".join(part.hex() for part in parts).encode()).digest()


@dataclass
class Subtree:
    height: int
    node: bytes
    first: int
    end: int


class Forest:
    """Open subtrees of the leaves appended so far, and every leaf's witness up to its subtree's root."""

    def __init__(self):
        self.open: list[Subtree] = []
        self.witnesses: list[bytearray] = []

    def _extend(self, tree: Subtree, kind: int, sibling: bytes = b"") -> None:
        entry = bytes([kind]) + sibling
        for place in range(tree.first, tree.end):
            self.witnesses[place] += entry

    def _close_two(self) -> None:
        right, left = self.open.pop(), self.open.pop()
        self._extend(left, SIBLING_RIGHT, right.node)
        self._extend(right, SIBLING_LEFT, left.node)
        joined = digest(left.node, right.node)
        self.open.append(Subtree(left.height + 1, joined, left.first, right.end))

    def _pair(self) -> bool:
        return len(self.open) > 1 and self.open[-1].height == self.open[-2].height

    def append(self, node: bytes) -> None:
        place = len(self.witnesses)
        self.witnesses.append(bytearray())
        self.open.append(Subtree(0, node, place, place + 1))
        while self._pair():
            self._close_two()

    def finish(self, height: int | None) -> bytes:
        """The root: of this height, or where it is None, of the first at which one node is left."""
        while len(self.open) > 1 or (height is not None and self.open[0].height < height):
            if self._pair():
                self._close_two()
            else:
                last = self.open[-1]
                self._extend(last, LONE)
                last.node, last.height = digest(last.node), last.height + 1
        return self.open[0].node


def entries(witness: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(witness):
        kind = witness[at]
        end = at + 1 + (DIGEST if kind != LONE else 0)
        yield kind, witness[at + 1 : end]
        at = end


def fold(node: bytes, witness: bytes) -> bytes:
    """The root that ``node`` and its siblings give."""
    for kind, sibling in entries(witness):
        if kind == SIBLING_LEFT:
            node = digest(sibling, node)
        elif kind == SIBLING_RIGHT:
            node = digest(node, sibling)
        else:
            node = digest(node)
    return node


def leaf(n_chars: Column | None = None) -> Column:
    """The digest of a document: all fields by their length in bytes and their value."""
    given = {"n_chars": n_chars} if n_chars is not None else {}

    def field(name: str) -> Column:
        value = given.get(name, F.col(name)).cast("string")
        return F.when(value.isNull(), "-").otherwise(
            F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        )

    return F.unhex(F.sha2(F.concat(*map(field, FIELDS)), 256))


def _closed(levels: int):
    """Nodes sorted by group and rank, whole blocks in a task, with witness and the block's root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held, key, height = Forest(), [], None, None

        def block() -> pa.RecordBatch:
            top = forest.finish(height)
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            # The block's first row has its root.
            return pa.RecordBatch.from_arrays(
                [
                    *rows.columns,
                    pa.array([bytes(w) for w in forest.witnesses], pa.binary()),
                    pa.array([top] + [None] * (rows.num_rows - 1), pa.binary()),
                ],
                names=[*rows.schema.names, "witness", "top"],
            )

        for batch in batches:
            groups, ranks, sizes, nodes = (
                batch.column(c).to_pylist() for c in ("grp", "rank", "size", "node")
            )
            start = 0
            for at, (group, rank, size, node) in enumerate(zip(groups, ranks, sizes, nodes)):
                own = (group, rank >> levels)
                if own != key:
                    if at > start:
                        held.append(batch.slice(start, at - start))
                    if held:
                        yield block()
                    forest, held, key, start = Forest(), [], own, at
                    height = levels if size > 1 << levels else None
                forest.append(node)
            if batch.num_rows > start:
                held.append(batch.slice(start))
        if held:
            yield block()

    return run


def closed(nodes: DataFrame, name: str, levels: int) -> DataFrame:
    """``nodes`` (grp, rank, size, node and others) with witness and, one row a block, the root ``top``."""
    block = F.shiftright("rank", levels)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields)
    ordered = nodes.repartition("grp", block).sortWithinPartitions("grp", "rank")
    return scratch_table(
        ordered.mapInArrow(_closed(levels), f"{schema}, witness binary, top binary"), name
    )


def forest_of(nodes: DataFrame, name: str, height: int) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """The rows of ``nodes`` with the witness up to their block's root, the witnesses of the block roots
    up to their group's root (grp, block, above; None where every group is one block), and the groups' roots
    (grp, root)."""
    size = F.ceil(F.col("size") / (1 << height))
    levels = [closed(nodes, f"{name}-0", height)]
    roots = []
    while True:
        tops = levels[-1].filter("top IS NOT NULL")
        roots.append(tops.filter(size == 1).select("grp", F.col("top").alias("root")))
        rest = tops.filter(size > 1).select(
            "grp", F.shiftright("rank", height).alias("rank"), size.alias("size"), F.col("top").alias("node")
        )
        if rest.isEmpty():
            break
        levels.append(closed(rest, f"{name}-{len(levels)}", height))
    above = None
    for level in reversed(levels[1:]):
        own = level.select("grp", F.col("rank").alias("block"), "witness")
        if above is not None:
            higher = above.withColumnRenamed("block", "higher").withColumnRenamed("above", "rest")
            own = (
                own.withColumn("higher", F.shiftright("block", height))
                .join(higher, ["grp", "higher"], "left")
                .withColumn("witness", F.concat("witness", F.coalesce("rest", F.lit(b""))))
            )
        above = own.select("grp", "block", F.col("witness").alias("above"))
    found = roots[0]
    for more in roots[1:]:
        found = found.unionAll(more)
    return levels[0], above, found


def manifest(docs: DataFrame, tampered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, changed, witness, subroot and root (binary) of each row of ``docs``.

    A row's leaf is the digest of its doc_id, source, lang, n_chars and text. Leaves of a language go
    by doc_id (NULL first), rows that share one by their leaf, and every two neighbours become one
    node, a last one without neighbour its own digest, until one is left: the subroot. The subroots
    go by language (NULL first, then by their UTF-8 bytes) and give the root in the same way. A
    witness has the siblings on the way to the root, from below. ``changed`` is the leaf with
    ``tampered`` in place of n_chars, NULL where that is NULL. NULL and empty texts differ; a text of any length
    is hashed whole. Repeated rows are leaves of their own. An empty table gives no rows; columns other
    than the five are ignored.
    """
    tampered = F.lit(None) if tampered is None else tampered
    leaves = docs.select(
        "doc_id",
        group_of(F.col("lang")).alias("grp"),
        leaf().alias("node"),
        F.when(tampered.isNotNull(), leaf(tampered)).alias("changed"),
        # Spreads rows that are the same in everything.
        F.monotonically_increasing_id().alias("salt"),
    )
    ranked = numbered(leaves, ["doc_id", "node", "salt"], "leaves").drop("salt")
    rows, above, subroots = forest_of(ranked, "tree", levels)
    subroots = scratch_table(subroots, "subroots")
    langs = numbered(
        subroots.select(F.lit("").alias("grp"), F.col("grp").alias("lang"), F.col("root").alias("node")),
        ["lang"],
        "langs",
    )
    top, top_above, root = forest_of(langs, "top", levels)
    root = root.select(F.col("root").alias("root"))
    if top_above is not None:
        top = (
            top.withColumn("block", F.shiftright("rank", levels))
            .join(top_above.drop("grp"), "block")
            .withColumn("witness", F.concat("witness", "above"))
        )
    ends = top.select(
        F.col("lang").alias("grp"), F.col("node").alias("subroot"), F.col("witness").alias("last")
    ).crossJoin(F.broadcast(root))  # one row
    if above is None:
        rows = rows.withColumn("above", F.lit(b""))
    else:
        rows = rows.withColumn("block", F.shiftright("rank", levels)).join(above, ["grp", "block"], "left")
    return rows.join(ends, "grp").select(
        "doc_id",
        F.col("node").alias("leaf"),
        "changed",
        F.concat("witness", F.coalesce("above", F.lit(b"")), "last").alias("witness"),
        "subroot",
        "root",
    )


VERIFIED_SCHEMA = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
    "folded_root string, verified boolean"
)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [field.split()[0] for field in VERIFIED_SCHEMA.split(", ")]
    for batch in batches:
        leaves, changed, witnesses, subroots, roots = (
            batch.column(c).to_pylist() for c in ("leaf", "changed", "witness", "subroot", "root")
        )
        folded = [fold(c or own, w) for own, c, w in zip(leaves, changed, witnesses)]
        proofs = [digest(*(sibling for _, sibling in entries(w))) for w in witnesses]
        texts = lambda column: pa.array([value.hex() for value in column], pa.string())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                *map(texts, (leaves, subroots, roots, proofs, folded)),
                pa.array([a == b for a, b in zip(folded, roots)], pa.bool_()),
            ],
            names=names,
        )


def verified(manifest: DataFrame) -> DataFrame:
    """The digests of :func:`manifest` as texts, and whether each (changed) leaf still gives the root."""
    return manifest.mapInArrow(_verified, VERIFIED_SCHEMA)


def op13_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = F.when(hit, F.col("n_chars") + 1)
    return verified(manifest(documents(spark, sf), tampered))


OP13_SQL = f"""
WITH RECURSIVE fields AS (
    SELECT doc_id, lang, n_chars, doc_id::VARCHAR AS d,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
            || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') AS front,
        coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS middle,
        coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS other,
        coalesce(strlen(text) || ':' || text, '-') AS back
    FROM documents
), crcs AS (
    SELECT *, {crc_sql('d')} AS c FROM fields
), leaves AS (
    SELECT doc_id, lang, sha256(front || middle || back) AS leaf,
        CASE WHEN coalesce(c % 7 = 0, false)
            THEN sha256(front || other || back) ELSE sha256(front || middle || back) END AS start
    FROM crcs
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank
    FROM leaves
), below(lang, level, nodes) AS (
    SELECT lang, 0, list(leaf ORDER BY rank) FROM ranked GROUP BY lang
    UNION ALL
    SELECT lang, level + 1, list_transform(
        range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))
    )
    FROM below WHERE len(nodes) > 1
), subroots AS (
    SELECT lang, level AS height, nodes[1] AS subroot,
        row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS rank
    FROM below WHERE len(nodes) = 1
), over_all(level, nodes) AS (
    SELECT 0, list(subroot ORDER BY rank) FROM subroots
    UNION ALL
    SELECT level + 1, list_transform(
        range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))
    )
    FROM over_all WHERE len(nodes) > 1
), top AS (
    SELECT max(level) AS height, max(nodes[1]) FILTER (WHERE len(nodes) = 1) AS root FROM over_all
), steps AS (
    SELECT lang, level, nodes FROM below WHERE len(nodes) > 1
    UNION ALL
    SELECT s.lang, s.height + o.level, o.nodes
    FROM subroots s CROSS JOIN over_all o WHERE len(o.nodes) > 1
), walk(id, level, place, node, proof) AS (
    SELECT struct_pack(a := lang, b := rank), 0, rank, start, '' FROM ranked
    UNION ALL
    SELECT w.id, w.level + 1, p.place // 2,
        sha256(CASE WHEN p.place % 2 = 1 THEN coalesce(s.nodes[p.place], '') || w.node
            ELSE w.node || coalesce(s.nodes[p.place + 2], '') END),
        w.proof || coalesce(s.nodes[CASE WHEN p.place % 2 = 1 THEN p.place ELSE p.place + 2 END], '')
    FROM walk w
    JOIN subroots r ON r.lang IS NOT DISTINCT FROM w.id.a
    JOIN steps s ON s.lang IS NOT DISTINCT FROM w.id.a AND s.level = w.level
    CROSS JOIN LATERAL (SELECT CASE WHEN w.level = r.height THEN r.rank ELSE w.place END AS place) p
), ends AS (
    SELECT id, max_by(node, level) AS folded_root, max_by(proof, level) AS proof FROM walk GROUP BY id
)
SELECT k.doc_id, k.leaf, r.subroot, t.root, sha256(e.proof) AS proof_sha256, e.folded_root,
    e.folded_root = t.root AS verified
FROM ranked k
JOIN ends e ON e.id.a IS NOT DISTINCT FROM k.lang AND e.id.b = k.rank
JOIN subroots r ON r.lang IS NOT DISTINCT FROM k.lang
CROSS JOIN top t
"""
