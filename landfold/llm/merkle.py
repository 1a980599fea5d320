"""Merkle manifest of a dataset: a postorder append log of hashes, from which proofs are read by position.

Every document is a leaf. The leaves of a language, in ascending order of doc_id, make a binary tree, and the roots of the
languages' trees make another. A tree is written as a log in postorder: a node follows its children as soon as both are
there. Builders take aligned runs of 2^BLOCK nodes and write what these complete; the roots of the runs are the next tier's
nodes, until one is left. No builder waits for another, as a node's place in the log follows from its level, its number and
the count of leaves alone:

    m = (number + 1) * 2^level leaves lie before the node's end; m leaves complete 2m - popcount(m) nodes, of which the last
    trailing_zeros(m) - level are the node's ancestors. A node that no full run of leaves makes is written at the log's end.

The same rule gives the places of a node's siblings, so that a proof is read out of the log without its tree: each run reads
its stretch of the log, and what lies above the run is read once for all its leaves.

Defined results: null fields are hashed as `-`; a null language has a tree of its own, before all others; null doc_ids come
first; rows that share a doc_id follow in the order of their leaves, and rows alike in all follow one another; texts are
hashed whole; a lone leaf is its tree's root, a lone tree's root the root of all, with an empty proof where both hold; other
columns, of whatever name, play no part; an empty table has no root and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landfold.llm.common import staged, table

#: Levels that a builder completes: 2^BLOCK nodes go in, one comes out.
BLOCK = 9
#: Rows of a range of leaves, and up to how many (tree, range) rows are broadcast.
RANGE_ROWS, BROADCAST_SPANS = 500_000, 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LOG = "tree binary, level int, number bigint, position bigint, digest string, doc_id bigint, tampered string"
PATH = "tree binary, number bigint, path array<string>, subroot string"


def leaf_column(changed: dict[str, Column] | None = None) -> Column:
    """The hash of a row's fields, each as byte count, colon and value."""
    parts = []
    for name in FIELDS:
        value = (changed or {}).get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def tree_key(lang: str = "lang") -> Column:
    """A key that sorts a null language first and the others by their bytes."""
    value = F.col(lang).cast("string")
    return F.when(value.isNull(), F.lit(b"")).otherwise(F.concat(F.lit(b"\x01"), value.cast("binary")))


def hashed(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    return (n - 1).bit_length()


def position(level: int, number: int, n: int) -> int:
    """A node's place in the log of a tree with n leaves."""
    m = (number + 1) << level
    zeros = (m & -m).bit_length() - 1
    if m <= n:
        return 2 * m - m.bit_count() - 1 - (zeros - level)
    return 2 * n - n.bit_count() + level - (n & -n).bit_length()


# --- places of the leaves


def numbered(leaves: DataFrame, *order: str) -> DataFrame:
    """Rows with their number within their tree and the tree's size n: sorted once in ranges over all trees, so that a tree
    of any size spreads, with a row a tree and range to add up."""
    rows = leaves.withColumn("_row", F.monotonically_increasing_id())
    ranges = max(int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")), leaves.count() // RANGE_ROWS + 1)
    keys = ["tree", *order, "_row"]
    dealt = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    dealt = staged(dealt.drop("_row").withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "merkle-order")
    spans = dealt.groupBy("tree", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
    own = W.partitionBy("tree")
    before = F.sum("_size").over(own.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    spans = staged(spans.select("tree", "_range", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_size").over(own).alias("n")), "merkle-spans")
    if spans.count() <= BROADCAST_SPANS:
        spans = F.broadcast(spans)
    placed = dealt.join(spans, ["tree", "_range"])
    return placed.withColumn("number", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_first", "_before", "_range")


# --- builders


def _builder(tier: int, block: int):
    """One aligned run of nodes of level tier * block: appends each node that is completed."""
    base = tier * block

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("number").to_pydict()
        tree, n = rows["tree"][0], rows["n"][0]
        top, first = min(height(n), base + block), rows["number"][0]
        log: list[tuple] = []
        open_ends: list[tuple[int, int, str]] = []  # left siblings that wait: level, number, digest

        def append(level: int, number: int, digest: str, row: int | None = None) -> None:
            if tier == 0 or level > base:
                known = (rows["doc_id"][row], rows["tampered"][row]) if row is not None else (None, None)
                log.append((tree, level, number, position(level, number, n), digest, *known))

        def rise(level: int, number: int, digest: str, last: bool) -> None:
            """Completes what a node completes; the tree's last node, all that is above it in this run."""
            while level < top:
                if number & 1:
                    _, _, left = open_ends.pop()
                    digest = hashed([left, digest])
                elif last:
                    digest = hashed([digest])
                else:
                    open_ends.append((level, number, digest))
                    return
                level, number = level + 1, number >> 1
                append(level, number, digest)

        ends = (n - 1 >> base) - first  # where the tree's last node of this level would be
        for k, digest in enumerate(rows["digest"]):
            append(base, first + k, digest, k)
            rise(base, first + k, digest, k == ends)
        columns = list(zip(*log, strict=True)) if log else [[] for _ in range(7)]
        return pa.table([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)

    return build


_TYPES = [pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
_NAMES = ["tree", "level", "number", "position", "digest", "doc_id", "tampered"]


def append_logs(leaves: DataFrame, block: int = BLOCK) -> list[DataFrame]:
    """The logs of all trees, tier by tier: leaves (tree, n, number, digest, doc_id, tampered) in, LOG rows out."""
    sizes = leaves.groupBy("tree").agg(F.first("n").alias("n"))
    tallest = leaves.agg(F.max("n")).first()[0] or 0
    tiers, rows = [], leaves
    while tallest and (not tiers or height(tallest) > block * len(tiers)):
        tier = len(tiers)
        run = rows.withColumn("_run", F.shiftright("number", block)).groupBy("tree", "_run")
        tiers.append(staged(run.applyInArrow(_builder(tier, block), LOG), f"merkle-log-{tier}"))
        # A node at the upper level of its run goes on; trees that have ended there don't.
        done = tiers[-1].where(F.col("level") == block * (tier + 1))
        rows = done.join(sizes.where(F.col("n") > F.lit(1 << min(62, block * (tier + 1)))), "tree")
    return tiers


# --- proofs


def _reader(tier: int, block: int, proofs: bool):
    """One run's stretch of the log: siblings by position, then those above the run, which its path row has. A path entry
    is the side and the digest of a sibling, or empty where a node has none."""
    base = tier * block

    def read(rows: pa.Table) -> pa.Table:
        rows = rows.to_pydict()
        n, tree = max(x for x in rows["n"] if x is not None), rows["tree"][0]
        at = {p: d for p, d in zip(rows["position"], rows["digest"], strict=True) if p is not None}
        above = next((k for k, p in enumerate(rows["path"]) if p is not None), None)
        path, subroot = ([], None) if above is None else (rows["path"][above], rows["subroot"][above])
        out: list[tuple] = []
        for k, level in enumerate(rows["level"]):
            if level != base or rows["position"][k] is None:
                continue
            own, number = [], rows["number"][k]
            for up in range(base, min(height(n), base + block)):
                at_level, last = number >> (up - base), (n - 1) >> up
                beside = at_level ^ 1
                own.append("" if beside > last else ("L" if at_level & 1 else "R") + at[position(up, beside, n)])
            whole = own + path
            if not proofs:
                out.append((tree, number, whole, subroot))
                continue
            folds = [folded(d, whole) for d in (rows["digest"][k], rows["tampered"][k] or rows["digest"][k])]
            out.append((rows["doc_id"][k], rows["digest"][k], subroot, hashed([e[1:] for e in whole]), *folds))
        columns = list(zip(*out, strict=True)) if out else [[] for _ in (range(6) if proofs else range(4))]
        types, names = (_PROOF_TYPES, _PROOF_NAMES) if proofs else (_PATH_TYPES, _PATH_NAMES)
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return read


_PATH_TYPES, _PATH_NAMES = [pa.binary(), pa.int64(), pa.list_(pa.string()), pa.string()], ["tree", "number", "path", "subroot"]
_PROOF_NAMES = ["doc_id", "leaf", "subroot", "proof_sha256", "honest_root", "folded_root"]
_PROOF_TYPES = [pa.int64(), *[pa.string()] * 5]
PROOF = "doc_id bigint, leaf string, subroot string, proof_sha256 string, honest_root string, folded_root string"


def folded(digest: str, path: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for entry in path:
        digest = hashed([entry[1:], digest] if entry[:1] == "L" else [digest, entry[1:]])
    return digest


def read_paths(tiers: list[DataFrame], sizes: DataFrame, above: DataFrame, proofs: bool, block: int = BLOCK) -> DataFrame:
    """Goes down the tiers of trees. sizes: tree, n; above: tree, number 0, path and subroot, of what lies over each tree.
    Returns the leaves' proofs, or their paths."""
    found = None
    for tier in range(len(tiers) - 1, -1, -1):
        # A stretch has the run's nodes below its own root; that root is among the nodes of the next tier.
        low = tiers[tier].where(F.col("level") < block * (tier + 1))
        low = low.withColumn("_run", F.expr(f"shiftright(number, {block} - (level - {tier * block}))")).join(sizes, "tree")
        if tier:
            entered = tiers[tier - 1].where(F.col("level") == block * tier).withColumn("_run", F.shiftright("number", block)).join(sizes, "tree")
            low = low.unionByName(entered.where(F.col("n") > F.lit(1 << block * tier)))
        # A tree that ends in this tier begins here with what is above it; the others with what the next tier has found.
        begins = above.join(sizes, "tree").where(F.col("n") <= F.lit(1 << min(62, block * (tier + 1))))
        if tier:
            begins = begins.where(F.col("n") > F.lit(1 << block * tier))
        paths = begins.select("tree", "number", "path", "subroot", "n")
        if found is not None:
            paths = paths.unionByName(found.join(sizes, "tree"))
        marked = paths.withColumnRenamed("number", "_run")
        run = low.unionByName(marked, allowMissingColumns=True).groupBy("tree", "_run")
        last = tier == 0 and proofs
        found = staged(run.applyInArrow(_reader(tier, block, last), PROOF if last else PATH), f"merkle-paths-{tier}")
    return found


@dataclass
class Manifest:
    """The logs of the languages' trees and of the tree over them."""

    tiers: list[DataFrame]
    sizes: DataFrame
    forest: list[DataFrame]
    forest_size: DataFrame
    subroots: DataFrame
    root: str | None

    def log(self) -> DataFrame:
        """All nodes of the languages' trees; a tree's positions are gapless from 0."""
        first, *rest = self.tiers
        for more in rest:
            first = first.unionByName(more)
        return first.select("tree", "position", "level", "number", "digest")

    def proofs(self) -> DataFrame:
        """Of each leaf: subroot, hash of its proof, and the roots that it and its tampered version fold to."""
        over = read_paths(self.forest, self.forest_size, self._top(), proofs=False)
        above = self.subroots.select(F.col("tree"), F.col("number"), F.col("digest").alias("subroot"))
        above = above.join(over.select("number", "path"), "number").select("tree", F.lit(0).cast("bigint").alias("number"), "path", "subroot")
        return read_paths(self.tiers, self.sizes, staged(above, "merkle-above"), proofs=True)

    def _top(self) -> DataFrame:
        empty = F.array().cast("array<string>")
        return self.forest_size.select("tree", F.lit(0).cast("bigint").alias("number"), empty.alias("path"), F.lit(None).cast("string").alias("subroot"))


def roots(tiers: list[DataFrame], sizes: DataFrame) -> DataFrame:
    """The highest node of each tree: tree, digest."""
    found = None
    for tier in tiers:
        own = tier.groupBy("tree").agg(F.max_by("digest", "level").alias("digest"), F.max("level").alias("level"))
        found = own if found is None else found.unionByName(own)
    return found.groupBy("tree").agg(F.max_by("digest", "level").alias("digest")).join(sizes, "tree")


def build(docs: DataFrame, tampered: Column | None = None) -> Manifest:
    """tampered: a second leaf for some rows, null for the others; it is no part of the tree."""
    leaf = docs.select(
        tree_key().alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"), leaf_column().alias("digest"),
        (F.lit(None).cast("string") if tampered is None else tampered).alias("tampered"))
    leaves = staged(numbered(staged(leaf, "merkle-leaves"), "doc_id", "digest"), "merkle-placed")
    sizes = staged(leaves.groupBy("tree").agg(F.count("*").alias("n")), "merkle-sizes")
    tiers = append_logs(leaves)
    if not tiers:
        return Manifest([], sizes, [], sizes, sizes, None)
    tops = roots(tiers, sizes).select(F.lit(b"").alias("tree"), F.col("tree").alias("_lang"), "digest", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("tampered"))
    subroots = staged(numbered(staged(tops, "merkle-subroots"), "_lang"), "merkle-subroots")
    forest = append_logs(subroots.drop("_lang"))
    forest_size = staged(subroots.groupBy("tree").agg(F.count("*").alias("n")), "merkle-sizes")
    root = roots(forest, forest_size).first()["digest"]
    return Manifest(tiers, sizes, forest, forest_size, subroots.select(F.col("_lang").alias("tree"), "number", "digest"), root)


def tampered_leaf() -> Column:
    """Where 7 divides the doc_id's CRC-32: the leaf with one more in n_chars."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return F.when(hit, leaf_column({"n_chars": F.col("n_chars").cast("bigint") + 1}))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = build(table(spark, sf_dir, "documents"), tampered_leaf())
    if manifest.root is None:
        return spark.createDataFrame([], "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    root = F.lit(manifest.root)
    return manifest.proofs().select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


QUERIES: dict[str, Callable] = {"op11_merkle_manifest": op11_merkle_manifest}

_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_HASH = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
#: CRC-32 of a decimal number: digits go in one by one, and eight steps of a bit follow each (-1).
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, (c & 1) * 3988292384) END))"""
ORACLE_SQL = {
    "op11_merkle_manifest": f"""
        WITH RECURSIVE leaves AS (
            SELECT doc_id, lang, {_HASH.format(n='n_chars')} AS leaf, {_HASH.format(n='(n_chars + 1)')} AS bad, {_CRC} % 7 = 0 AS hit,
                   row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n
            FROM documents),
        trees(lang, level, k, h, n) AS (
            SELECT lang, 0, k, leaf, n FROM leaves
            UNION ALL
            SELECT lang, max(level) + 1, k // 2, sha256(string_agg(h, '' ORDER BY k)), (max(n) + 1) // 2 FROM trees WHERE n > 1 GROUP BY lang, k // 2),
        tops AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k, count(*) OVER () AS n FROM trees WHERE n = 1),
        forest(level, k, h, n) AS (
            SELECT 0, k, h, n FROM tops
            UNION ALL
            SELECT max(level) + 1, k // 2, sha256(string_agg(h, '' ORDER BY k)), (max(n) + 1) // 2 FROM forest WHERE n > 1 GROUP BY k // 2),
        heights AS (SELECT lang, max(level) AS height FROM trees GROUP BY lang),
        sides AS (
            SELECT l.doc_id, t.level AS level, t.k AS k, t.h AS h
            FROM leaves l JOIN trees t ON t.lang IS NOT DISTINCT FROM l.lang AND t.n > 1 AND t.k = xor(l.k >> t.level, 1)
            UNION ALL
            SELECT l.doc_id, e.height + f.level, f.k, f.h
            FROM leaves l JOIN heights e ON e.lang IS NOT DISTINCT FROM l.lang JOIN tops p ON p.lang IS NOT DISTINCT FROM l.lang
            JOIN forest f ON f.n > 1 AND f.k = xor(p.k >> f.level, 1)),
        proofs AS (SELECT doc_id, sha256(string_agg(h, '' ORDER BY level)) AS proof FROM sides GROUP BY doc_id),
        fold(doc_id, level, ends, h) AS (
            SELECT doc_id, 0, (SELECT max(height) FROM heights e WHERE e.lang IS NOT DISTINCT FROM leaves.lang) + (SELECT max(level) FROM forest),
                   CASE WHEN hit THEN coalesce(bad, leaf) ELSE leaf END FROM leaves
            UNION ALL
            SELECT f.doc_id, f.level + 1, f.ends, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN s.k % 2 = 0 THEN s.h || f.h ELSE f.h || s.h END)
            FROM fold f LEFT JOIN sides s ON s.doc_id = f.doc_id AND s.level = f.level WHERE f.level < f.ends),
        root AS (SELECT h FROM forest WHERE n = 1)
        SELECT l.doc_id, l.leaf, p.h AS subroot, r.h AS root, coalesce(proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
        FROM leaves l JOIN tops p ON p.lang IS NOT DISTINCT FROM l.lang CROSS JOIN root r LEFT JOIN proofs USING (doc_id)
        JOIN fold f ON f.doc_id = l.doc_id AND f.level = f.ends""",
}
