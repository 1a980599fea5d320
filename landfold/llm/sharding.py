"""Sharding by histogram sort: shards of near-equal bytes in the order of doc_id.

Splitters are sought by counting exact bytes: a first histogram over the keys' leading bits shows in which cell each
target (k-th part of all bytes) falls; only these cells are counted again, with finer cells, until a cell is a single key
or weighs no more than the tolerance. A key is the doc_id and, behind it, a hash of the text, so that rows that share a
doc_id, or have none, are split like any others. Each shard is cut the same way into pieces of at most PIECE_BYTES, so that
a task sorts a piece and not a shard. Then documents are exchanged once, by piece; the slot is the number of rows in earlier
pieces of the shard plus the place within the piece.

Only DataFrame functions. Defined results: the size of a row is its text's UTF-8 bytes (null: none) plus 8; law `bytes`: a
row goes to shard floor(shards * bytes of all smaller keys / all bytes); a null doc_id sorts first; rows that share a doc_id
are in the order of the XXH64 of their texts; rows alike in both are one key and stay together; an empty table gives no
rows; of copies of a text each goes where its doc_id lies. Columns of any name are handed on: the operator's own are
_lf_shard and _lf_slot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landfold.llm.common import staged, table, text_of

SHARDS = 24
#: Bytes of a piece; MOST_PARTS pieces at most over all shards, as the driver holds their borders, beyond which they grow.
PIECE_BYTES, MOST_PARTS = 128 << 20, 4096
#: Bits of the first and of each further histogram: at most 4,096 rows, and 64 for each splitter still sought, come back.
FIRST_BITS, NEXT_BITS = 12, 6
SIGN, WORD = 1 << 63, 1 << 64
KEYS = ["_lf_key", "_lf_hash"]


def row_size(text: str = "text") -> Column:
    return F.octet_length(text_of(text)).cast("bigint") + 8


def _keys() -> dict[str, Column]:
    """The two words of a key, as signed numbers in the order of the key."""
    return {"_lf_key": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-SIGN)), "_lf_hash": F.xxhash64(text_of())}


def _cell(shift: int) -> list[Column]:
    """What is left of a key (both words as unsigned numbers) without its last `shift` of 128 bits: two words."""
    high, low = (F.col(c).bitwiseXOR(F.lit(-SIGN)) for c in KEYS)
    zero = F.lit(0).cast("bigint")
    if shift >= 64:
        return [F.shiftrightunsigned(high, shift - 64) if shift < 128 else zero, zero]
    return [high, F.shiftrightunsigned(low, shift)]


def _number(high: int, low: int, shift: int) -> int:
    return high % WORD if shift >= 64 else (high % WORD) << (64 - shift) | low % WORD


def _words(cell: int, shift: int) -> tuple[int, int]:
    high, low = (cell, 0) if shift >= 64 else divmod(cell, 1 << (64 - shift))
    return tuple(w - WORD if w >= SIGN else w for w in (high, low))


def splitters(rows: DataFrame, parts: int, tolerance: float = 0.0) -> list[int]:
    """rows: _lf_key, _lf_hash, _lf_size. For j in 1 .. parts - 1 the least key with at least j / parts of all bytes below it,
    as an unsigned number of 128 bits (2^128 lies above all keys). With a tolerance, a cell of at most that share of a
    part's bytes isn't cut any further: the splitter is then its end."""
    total, low, high = rows.agg(F.sum("_lf_size"), F.min("_lf_key"), F.max("_lf_key")).first()
    if not total:
        return [1 << 128] * (parts - 1)
    low, high = low + SIGN, high + SIGN
    shift = 64
    while (high >> (shift - 64)) - (low >> (shift - 64)) >= 1 << FIRST_BITS:
        shift += 1
    key, found = F.struct(*KEYS), {}
    # (first bits of an open cell) -> (bytes below it, its targets)
    open_cells: dict[int, tuple[int, list[int]]] = {-1: (0, list(range(1, parts)))}
    width = None
    while open_cells:
        inside = rows
        if width is not None:
            wanted = rows.sparkSession.createDataFrame([_words(c, width) for c in open_cells], "_lf_h bigint, _lf_l bigint")
            at = _cell(width)
            # At most one cell for each splitter: a list that the driver made.
            inside = rows.withColumns({"_lf_h": at[0], "_lf_l": at[1]}).join(F.broadcast(wanted), ["_lf_h", "_lf_l"], "left_semi")
        at = _cell(shift)
        counted = inside.groupBy(at[0].alias("h"), at[1].alias("l")).agg(F.sum("_lf_size").alias("n"), F.min(key).alias("first"), F.max(key).alias("last")).collect()
        groups: dict[int, list[tuple[int, int, int | None]]] = {}
        for h, l, n, first, last in counted:
            cell = _number(h, l, shift)
            only = (first[0] + SIGN) << 64 | (first[1] + SIGN) if first == last else None
            groups.setdefault(-1 if width is None else cell >> (width - shift), []).append((cell, n, only))
        after: dict[int, tuple[int, list[int]]] = {}
        for outer, (below, targets) in open_cells.items():
            inner = sorted(groups[outer])
            k, upto = 0, below
            for j in targets:  # ascending
                while k < len(inner) and (upto + inner[k][1]) * parts <= j * total and upto * parts < j * total:
                    upto += inner[k][1]
                    k += 1
                if k == len(inner):  # the next key after this cell
                    found[j] = (inner[-1][0] + 1) << shift
                elif upto * parts >= j * total:
                    found[j] = inner[k][0] << shift
                elif inner[k][2] is not None:  # a single key
                    found[j] = inner[k][2] + 1
                elif inner[k][1] * parts <= tolerance * total:
                    found[j] = (inner[k][0] + 1) << shift
                else:
                    after.setdefault(inner[k][0], (upto, []))[1].append(j)
        open_cells, width = after, shift
        shift = max(0, shift - NEXT_BITS)
    return [found[j] for j in range(1, parts)]


def piece_of(cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most the row's key: among every 64th, then among the 64 from there on."""
    cuts = [c for c in cuts if c < 1 << 128]
    if not cuts:
        return F.lit(0)
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(KEYS)])

    def literal(some: list[int]) -> Column:
        high, low = ([w - SIGN for w in ws] for ws in zip(*[divmod(c, WORD) for c in some], strict=True))
        as_longs = lambda ws: F.array(*[F.lit(w).cast("bigint") for w in ws])
        return F.arrays_zip(as_longs(high).alias("k0"), as_longs(low).alias("k1"))

    def upto(border: Column) -> Column:
        return F.size(F.filter(border, lambda c: F.struct(c["k0"], c["k1"]) <= key))

    block = upto(literal(cuts[::64]))
    within = F.get(F.array(*[literal(cuts[k : k + 64]) for k in range(0, len(cuts), 64)]), block - 1)
    return F.when(block == 0, 0).otherwise((block - 1) * 64 + upto(within)).cast("int")


def shard_documents(docs: DataFrame, shards: int = SHARDS, piece_bytes: int = PIECE_BYTES, tolerance: float = 0.0) -> DataFrame:
    """docs with _lf_shard and _lf_slot."""
    narrow = staged(docs.select(*[c.alias(k) for k, c in _keys().items()], row_size().alias("_lf_size")), "shard-sizes")
    total = narrow.agg(F.sum("_lf_size")).first()[0] or 0
    pieces = max(1, min(-(-total // (shards * piece_bytes)), MOST_PARTS // shards))
    cuts = splitters(narrow, shards * pieces, tolerance)
    piece = staged(narrow.select(piece_of(cuts).alias("piece")).groupBy("piece").agg(F.count("*").alias("n")), "shard-pieces")
    counts = dict(piece.collect())  # a number for each piece
    offsets, upto = [], 0
    for k in range(shards * pieces):
        upto = 0 if k % pieces == 0 else upto
        offsets.append(upto)
        upto += counts.get(k, 0)
    number = F.col("_lf_piece")
    # A piece is a partition, so that no task sorts two of them.
    placed = docs.withColumns(_keys()).withColumn("_lf_piece", piece_of(cuts)).repartitionById(shards * pieces, "_lf_piece")
    place = F.row_number().over(W.partitionBy("_lf_piece").orderBy(*KEYS))
    slot = F.get(F.array(*[F.lit(x).cast("bigint") for x in offsets]), number) + place - 1
    return placed.withColumns({"_lf_slot": slot, "_lf_shard": F.floor(number / pieces).cast("int")}).drop("_lf_piece", *KEYS)


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """One folder for each shard, rows in the order of their slots."""
    shard_documents(docs, **options).write.partitionBy("_lf_shard").parquet(path)


def op9_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", row_size().alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), F.col("_lf_shard").alias("shard"), F.col("_lf_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable] = {"op9_byte_shards": op9_byte_shards}
#: DuckDB has no CRC-32, so the queries' SQL can't be given; tests hold the query against a brute-force version.
ORACLE_SQL: dict[str, str] = {}
