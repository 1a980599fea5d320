"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text's paragraphs are its lines, a line being cut after the first sentence end or blank behind each MOST bytes. Each
paragraph's digest goes into one cell of each of HASHES sub-tables: a cell adds counts, and digests and their check values
by exclusive or. Sketches of two versions subtract cell by cell; what they share is gone, and peeling recovers the digests
that differ: a cell that holds one digest, as its check value says, gives it away, and taking it out of its other cells lays
further ones bare. Where that ends before the cells are empty, it is tried again with sketches GROWTH times as large, until
all differing digests are out. The likeness of two texts is the share of paragraphs that both have, of those that either
has, repeats counted (Jaccard); it follows from the number of recovered digests, and is exact.

Defined results: a null text is empty; texts without a paragraph are wholly alike, and not alike any other; a text of one
paragraph is wholly like or unlike another; the fingerprint is the sketch of the least size in hexadecimal and depends on
the text alone; texts are read whole. Documents follow one another by doc_id, null ids first, those of one id by the hash of
their text; after the last comes the first, so that a table of one document compares it with itself. Other columns, of
whatever name, play no part; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landfold.llm.common import scratch, table, text_of

#: Cells of the least sketch, sub-tables, growth on failure.
CELLS, HASHES, GROWTH = 24, 3, 4
#: Bytes after which a line is cut at the next sentence end, or beyond twice as many at the next blank.
MOST = 96
#: Cells of the sketches that are peeled together, bytes of a range of documents.
TOGETHER, RANGE_BYTES = 1 << 20, 128 << 20
_PARAGRAPH = re.compile(rb"[^\n]{0,%d}[^\n.!?]{0,%d}[^\n.!?\x20]*[.!?]*" % (MOST, MOST))


def paragraphs(text: bytes) -> list[bytes]:
    return [p for p in _PARAGRAPH.findall(text) if p and not p.isspace()]


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser; digests are spread anew for each purpose and size."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD1342543DE82EF95 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The paragraphs' digests of all texts, and where each text's begin. A repeated paragraph gets another digest for each
    repeat, so that a text is a set."""
    from xxhash import xxh64_intdigest

    found = [[xxh64_intdigest(p) for p in paragraphs(t)] for t in texts]
    starts = np.cumsum([0, *map(len, found)])
    flat = np.fromiter((d for f in found for d in f), np.uint64, starts[-1])
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    order = np.lexsort((flat, owner))
    same = np.concatenate([[False], (np.diff(owner[order]) == 0) & (flat[order][1:] == flat[order][:-1])]) if len(flat) else np.zeros(0, bool)
    run = np.arange(len(flat)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(flat))))
    again = order[run > 0]
    flat[again] = _mixed(flat[again] ^ _mixed(run[run > 0].astype(np.uint64), 5), 6)
    return flat, starts


class Sketches:
    """A sketch a row, each of `cells` cells."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count = np.zeros(n * cells, np.int64)
        self.digest, self.check = np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint32)

    def places(self, owner: np.ndarray, digest: np.ndarray) -> list[np.ndarray]:
        own = np.uint64(self.cells // HASHES)
        return [owner * self.cells + k * int(own) + (_mixed(digest, self.cells * HASHES + k) % own).astype(np.int64) for k in range(HASHES)]

    @staticmethod
    def checks(digest: np.ndarray) -> np.ndarray:
        return (_mixed(digest, 1) >> np.uint64(32)).astype(np.uint32)

    def add(self, owner: np.ndarray, digest: np.ndarray, sign: np.ndarray | int) -> None:
        check = self.checks(digest)
        for at in self.places(owner, digest):
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.digest, at, digest)
            np.bitwise_xor.at(self.check, at, check)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.n, self.cells)
        out.count, out.digest, out.check = self.count - other.count, self.digest ^ other.digest, self.check ^ other.check
        return out

    def peeled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Takes digests out until none is bare. Returns owner, digest and sign of those taken out, and which sketches are
        empty now."""
        out: list[tuple[np.ndarray, ...]] = []
        look = np.flatnonzero(np.abs(self.count) == 1)
        for _ in range(self.cells + 1):
            look = look[np.abs(self.count[look]) == 1]
            look = look[self.checks(self.digest[look]) == self.check[look]]
            if not len(look):
                break
            owner, digest = look // self.cells, self.digest[look]
            order = np.lexsort((digest, owner))
            owner, digest, look = owner[order], digest[order], look[order]
            first = np.concatenate([[True], (np.diff(owner) != 0) | (digest[1:] != digest[:-1])])
            owner, digest, sign = owner[first], digest[first], self.count[look[first]]
            self.add(owner, digest, -sign)
            out.append((owner, digest, sign))
            look = np.unique(np.concatenate(self.places(owner, digest)))
        left = ((self.count != 0) | (self.digest != 0) | (self.check != 0)).reshape(self.n, self.cells).any(1)
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), ~left
        return *(np.concatenate(x) for x in zip(*out, strict=True)), ~left

    def written(self) -> list[str]:
        """Each sketch in hexadecimal: of each cell the count (16 bits), digest (64) and check value (32)."""
        kind = np.dtype([("count", ">u2"), ("digest", ">u8"), ("check", ">u4")])
        rows = np.zeros((self.n, self.cells), kind)
        for name, values in (("count", self.count & 0xFFFF), ("digest", self.digest), ("check", self.check)):
            rows[name] = values.reshape(self.n, self.cells)
        return [r.tobytes().hex() for r in rows]


def taken(flat: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The digests of some texts, and the number of each one's text among those."""
    sizes = np.diff(starts)[which]
    before = np.cumsum(sizes) - sizes
    return np.repeat(np.arange(len(which)), sizes), flat[np.repeat(starts[which] - before, sizes) + np.arange(sizes.sum())]


def sketched(flat: np.ndarray, starts: np.ndarray, which: np.ndarray, cells: int) -> Sketches:
    out = Sketches(len(which), cells)
    out.add(*taken(flat, starts, which), 1)
    return out


def differing(flat: np.ndarray, starts: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """For pairs of texts: how many digests differ, the cells that it took, and the digests: pair, digest, 1 on the left
    and -1 on the right."""
    n, took, found = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64), []
    sizes = np.diff(starts)
    todo, cells = np.arange(len(left)), CELLS
    while len(todo):
        failed, room = [], max(1, TOGETHER // cells)
        for k in range(0, len(todo), room):
            own = todo[k : k + room]
            rest = sketched(flat, starts, left[own], cells).minus(sketched(flat, starts, right[own], cells))
            owner, digest, sign, done = rest.peeled()
            # Far beyond the digests that there are, a failure is one of the hashes: such a pair is compared by its sets.
            beyond = ~done & (cells > 64 * (sizes[left[own]] + sizes[right[own]] + 1))
            for at in np.flatnonzero(beyond):
                a, b = (flat[starts[x[own[at]]] : starts[x[own[at]] + 1]] for x in (left, right))
                more = np.concatenate([np.setdiff1d(a, b), np.setdiff1d(b, a)])
                keep = owner != at
                owner, digest = np.append(owner[keep], np.full(len(more), at)), np.append(digest[keep], more)
                sign = np.append(sign[keep], np.where(np.isin(more, a), 1, -1))
            done |= beyond
            good = done[owner]
            n[own] = np.where(done, np.bincount(owner, minlength=len(own)), 0)
            took[own] = cells
            found.append((own[owner[good]], digest[good], sign[good]))
            failed.append(own[~done])
        todo, cells = np.concatenate(failed), cells * GROWTH
    return n, took, tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def likeness(n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared digests of all, from how many differ."""
    return np.where(a + b > 0, (a + b - n) / np.maximum(1, a + b + n), 1.0)


def edited(text: str, following: str) -> str:
    """The second half, floor of its code points, gives way to as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, cells_edited bigint, cells_next bigint"


def compared(ids: list, texts: list[str], followers: list[str] | None = None) -> pa.RecordBatch:
    """RESULT rows of texts: each with its follower, or with the next one of the list, whose last then only follows."""
    n = len(ids)
    nexts = texts[1:] if followers is None else followers
    changed = [edited(t, f).encode() for t, f in zip(texts[:n], nexts, strict=True)]
    flat, starts = digests([t.encode() for t in texts] + changed + [f.encode() for f in followers or []])
    own = np.arange(n)
    new = len(texts) + own
    after = own + 1 if followers is None else len(texts) + n + own
    sizes = np.diff(starts)
    (d_new, c_new, _), (d_next, c_next, _) = differing(flat, starts, own, new), differing(flat, starts, own, after)
    columns = [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in changed], pa.string()),
        pa.array(sketched(flat, starts, own, CELLS).written(), pa.string()), pa.array(sketched(flat, starts, new, CELLS).written(), pa.string()),
        pa.array(likeness(d_new, sizes[own], sizes[new]), pa.float64()), pa.array(likeness(d_next, sizes[own], sizes[after]), pa.float64()), pa.array(c_new), pa.array(c_next),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])


def _in_slices(batches: Iterator[pa.RecordBatch], most: int = 8 << 20, rows_most: int = 2000) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for rows in batches:
        for doc_id, text in zip(rows.column("doc_id"), rows.column("text"), strict=True):
            ids.append(doc_id.as_py())
            texts.append(text.as_py())
            size += len(texts[-1])
            if size > most or len(ids) >= rows_most:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Each document compared with its edited text and with the next document: texts move once, in ranges of doc_id; the
    last document of each range, a row a range, meets the first one of the next."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    found = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), found // RANGE_BYTES + 1)
    rows = rows.withColumns({"hash": F.xxhash64("text"), "row_no": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange(ranges, "doc_id", "hash", "row_no").sortWithinPartitions("doc_id", "hash", "row_no").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, ends = TaskContext.get().partitionId(), None, []
        empty = [pa.nulls(2, f.type) for f in _RESULT_ARROW]
        for ids, texts in _in_slices(batches):
            if last is None:
                ends = [(ids[0], texts[0])]
            else:
                ids, texts = [last[0], *ids], [last[1], *texts]
            last = ids.pop(), texts[-1]
            if ids:
                done = compared(ids, texts)
                yield pa.RecordBatch.from_arrays([*done.columns, pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.bool_()), pa.nulls(len(ids), pa.string())], _PARTED)
        if last is not None:
            ends.append(last)
            empty[0] = pa.array([e[0] for e in ends], pa.int64())
            yield pa.RecordBatch.from_arrays([*empty, pa.array([part] * 2, pa.int32()), pa.array([True, False]), pa.array([e[1] for e in ends], pa.string())], _PARTED)

    path = scratch(docs.sparkSession, "fingerprints")
    dealt.mapInArrow(run, f"{RESULT}, part int, head boolean, text string").write.option("compression", "zstd").parquet(path)
    staged_rows = docs.sparkSession.read.schema(f"{RESULT}, part int, head boolean, text string").parquet(path)
    # Two rows a range: which range comes next is found without the texts.
    parts = staged_rows.where("head").select("part")
    order = W.orderBy("part")
    nexts = parts.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(W.partitionBy())).alias("next_part"))
    heads = staged_rows.where("head").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    tails = staged_rows.where("NOT head").select("part", "doc_id", "text").join(nexts, "part").join(heads, "next_part").select("doc_id", "text", "next_text")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k in range(rows.num_rows):
                row = rows.slice(k, 1).to_pydict()
                yield compared(row["doc_id"], row["text"], row["next_text"])

    names = [c.split()[0] for c in RESULT.split(", ")]
    return staged_rows.where("head IS NULL").select(*names).unionByName(tails.mapInArrow(close, RESULT))


_RESULT_ARROW = [pa.field(c.split()[0], {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]]) for c in RESULT.split(", ")]
_PARTED = [*(f.name for f in _RESULT_ARROW), "part", "head", "text"]


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_neighbours(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable] = {"op13_fingerprints": op13_fingerprints}
ORACLE_SQL: dict[str, str] = {}
