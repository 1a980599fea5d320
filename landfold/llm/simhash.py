"""SimHash near-dedup with bit-sliced comparison.

Fingerprints: 64 bits from the XXH64 hashes of word 3-shingles. Equal fingerprints are first folded into one row. Two
fingerprints within 3 bits of each other agree in at least one of four 16-bit bands, and within the other 48 bits in at
least one of four 12-bit parts, so each fingerprint is dealt out under 16 keys of 28 bits and any link meets under one of
them. The rows under a key (or many small keys packed together) form a block; its bits are stored as vertical planes, and
a carry-save counter per lane holds the distances of a query to all lanes at once. A query is abandoned as soon as all of
its lanes have passed the radius. A key with very many rows is dealt out over pairs of chunks, which compares all its
pairs over many tasks. Only a spanning set of links leaves a block, and components are found by star contraction.

Defined results: a null text counts as empty; a text without words has fingerprint zero and is linked like any other; texts
are read whole, whatever their length; rows that share a doc_id are each returned, and so are repeated rows; a null doc_id is
returned and never becomes a component id unless all are null; other columns, of whatever name, play no part in the links and
are handed on by keep_one(); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landfold.llm.common import staged, table, text_of
from landfold.operators.graph import components

RADIUS = 3
SHINGLE = 3
#: Small keys are packed into blocks of about so many rows; a key with over HOT_KEY rows is dealt out in chunks of CHUNK.
BLOCK, HOT_KEY, CHUNK = 1024, 8192, 4096
FULL = np.uint64(0xFFFF_FFFF_FFFF_FFFF)


def fingerprint_bytes(text: bytes) -> int:
    """The fingerprint of one text, given in UTF-8."""
    from xxhash import xxh64_digest

    words = text.lower().split()  # bytes: lower-cases A-Z only, splits at the six ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (np.concatenate([[0], ends[:-1] + 1])[:n]).tolist()
    ends = ends[-n:].tolist()
    hashes = b"".join([xxh64_digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)])
    ones = np.zeros(64, np.int64)
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    for k in range(0, n, 65_536):
        ones += np.unpackbits(rows[k : k + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        found = np.array([fingerprint_bytes(texts[k].as_buffer().to_pybytes()) for k in range(len(texts))], np.uint64)
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found.view(np.int64))], [*names, "fp"])


def fingerprints(docs: DataFrame, with_digest: bool = False) -> DataFrame:
    """doc_id, if asked for the text's SHA-256 as digest, and fp, the fingerprint's 64 bits as a bigint."""
    text = text_of().cast("binary")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[F.unhex(F.sha2(text, 256)).alias("digest")] * with_digest, text.alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id bigint" + ", digest binary" * with_digest + ", fp bigint")


def within(queries: np.ndarray, planes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """queries: uint64 fingerprints; planes: (64, words) uint64, the lanes' bits from the highest down. Returns a
    (queries, words) array of uint64, a bit for each lane within the radius.

    Carry-save: each plane adds one bit to a counter of two bits a lane (more for a larger radius), and what is carried
    out of it stays set. A query whose lanes are all carried out is dropped from the rest of the planes.
    """
    bits = radius.bit_length()
    if radius != (1 << bits) - 1:
        raise ValueError("the counters hold a radius of 1, 3, 7, ...")
    alive = np.arange(len(queries))
    ones = np.unpackbits(queries.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(bool)
    count = [np.zeros((len(queries), planes.shape[1]), np.uint64) for _ in range(bits)]
    over = np.zeros_like(count[0])
    out = np.zeros_like(over)
    for b in range(64):
        carry = planes[b][None, :] ^ np.where(ones[:, b], FULL, np.uint64(0))[:, None]
        for c in count:
            c ^= carry  # the sum bit; what was set in both carries on
            carry &= ~c
        over |= carry
        if b >= 8 and b % 8 == 7:
            going = (over != FULL).any(axis=1)
            if not going.any():
                return out
            if going.mean() < 0.6:
                alive, ones, over, count = alive[going], ones[going], over[going], [c[going] for c in count]
    out[alive] = ~over
    return out


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(64, words) bit planes, padded with lanes of zeros."""
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).T
    padded = np.zeros((64, -(-len(fps) // 64) * 64), np.uint8)
    padded[:, : len(fps)] = bits
    return np.packbits(padded, axis=1).view(">u8").astype(np.uint64)


def spanning_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all of fps (distinct, uint64) that links within the radius connect; positions (member, root)."""
    n, planes = len(fps), planes_of(fps)
    root = np.arange(n)
    for k in range(0, n, 256):
        near = within(fps[k : k + 256], planes)
        q, word = np.nonzero(near)
        if not len(q):
            continue
        lanes = np.unpackbits(near[q, word].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        hit, bit = np.nonzero(lanes)
        a, b = q[hit] + k, word[hit] * 64 + bit
        a, b = a[b < n], b[b < n]
        pairs = np.stack([np.minimum(root[a], root[b]), np.maximum(root[a], root[b])])
        pairs = np.unique(pairs[:, pairs[0] < pairs[1]], axis=1)
        for x, y in pairs.T.tolist():
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            root[max(x, y)] = min(x, y)
        while (root != root[root]).any():
            root = root[root]
    return [(i, int(r)) for i, r in enumerate(root) if i != r]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key. Runs of one key stay together; short runs are packed into blocks."""
    held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def links(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        starts, sizes = starts[sizes > 1], sizes[sizes > 1]
        block: list[np.ndarray] = []
        rows = 0
        found: list[tuple[int, int]] = []

        def close() -> None:
            own = np.unique(np.concatenate(block)).view(np.uint64)
            found.extend((int(own[i].view(np.int64)), int(own[r].view(np.int64))) for i, r in spanning_links(own))

        for s, size in zip(starts.tolist(), sizes.tolist(), strict=True):
            block.append(fps[s : s + size])
            rows += size
            if rows >= BLOCK:
                close()
                block, rows = [], 0
        if block:
            close()
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        keys = np.concatenate([held_key, batch.column("key").to_numpy()])
        fps = np.concatenate([held_fp, batch.column("fp").to_numpy()])
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))  # the last run may go on
        yield from links(keys[:cut], fps[:cut]) if cut else ()
        held_key, held_fp = keys[cut:], fps[cut:]
    if len(held_key):
        yield from links(held_key, held_fp)


def _keys():
    """16 keys: band i (16 bits) with part j (12 bits) of the other 48 bits."""
    out = []
    for i in range(4):
        band = F.shiftrightunsigned("fp", 48 - 16 * i).bitwiseAND(F.lit(0xFFFF))
        low_bits = 48 - 16 * i
        high = F.shiftrightunsigned("fp", low_bits + 16) if i else F.lit(0)
        low = F.col("fp").bitwiseAND(F.lit((1 << low_bits) - 1))
        rest = F.shiftleft(high.cast("bigint"), low_bits).bitwiseOR(low)
        for j in range(4):
            part = F.shiftrightunsigned(rest, 36 - 12 * j).bitwiseAND(F.lit(0xFFF))
            out.append(F.shiftleft(F.lit(i * 4 + j).cast("bigint"), 28) + F.shiftleft(band, 12) + part)
    return F.array(*out)


def links(distinct_fps: DataFrame) -> DataFrame:
    """Links (a, b) that span the components of distinct fingerprints (fp)."""
    keyed = distinct_fps.select("fp", F.explode(_keys()).alias("key"))
    hot = staged(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_KEY), "hot-keys")
    rows = keyed
    if not hot.isEmpty():
        # Each row meets every chunk of its key once: the pairs of chunks are blocks of their own.
        cold = keyed.join(hot.hint("merge"), "key", "left_anti").select("fp", "key")
        chunks = F.ceil(F.col("n") / CHUNK).cast("int")
        own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
        dealt = keyed.join(hot.hint("merge"), "key").select("fp", "key", own.alias("c"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("o"))
        pair = F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o"))
        rows = cold.unionByName(dealt.select("fp", pair.alias("key")))
    dealt = rows.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_links, "a bigint, b bigint")


def fingerprint_roots(rows: DataFrame, *first) -> DataFrame:
    """One row per distinct fingerprint: fp, root (the component's least fingerprint), and aggregates over the fingerprint's
    rows."""
    distinct_fps = staged(rows.groupBy("fp").agg(*first), "distinct-fingerprints")
    roots = components(links(distinct_fps.select("fp")))
    placed = distinct_fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return staged(placed.withColumn("root", F.coalesce("root", "fp")), "fingerprint-roots")


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id that links reach)."""
    rows = staged(fingerprints(docs), "fingerprints")
    placed = fingerprint_roots(rows, F.min("doc_id").alias("first_id"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = staged(placed.join(least, "root").select("fp", "component_id"), "fingerprint-classes")
    # Both sides are exchanged, so that the adaptive planner can split a very common fingerprint.
    return rows.join(classes.hint("merge"), "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component: that with its smallest doc_id (a null one comes last), of rows that share it that with the
    least digest of its text, and of rows alike in both any one. Rows are told apart by doc_id and digest together, so that
    unlike texts under one doc_id, or without any, each stay or go with their own component."""
    rows = staged(fingerprints(docs, with_digest=True), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "digest")
    placed = fingerprint_roots(rows, F.min(first).alias("first"))
    kept = placed.groupBy("root").agg(F.min("first").alias("first"))
    keys = {"_lf_none": F.col("first.none"), "_lf_id": F.col("first.id"), "_lf_digest": F.col("first.digest")}
    kept = staged(kept.select(*[c.alias(k) for k, c in keys.items()]), "kept-documents")
    marked = docs.withColumns({"_lf_none": F.col("doc_id").isNull(), "_lf_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), "_lf_digest": F.unhex(F.sha2(text_of().cast("binary"), 256))})
    joined = marked.join(kept.hint("merge"), [*keys], "left_semi")
    # The join has sorted by these keys already.
    return joined.withColumn("_lf_n", F.row_number().over(W.partitionBy(*keys).orderBy("_lf_id"))).where("_lf_n = 1").drop("_lf_n", *keys)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable] = {"op3_simhash_near_dedup": op3_simhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}
