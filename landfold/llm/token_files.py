"""Token-ID output: Arrow files of fixed-size-list batches.

Documents are dealt into ranges of doc_id and sorted, each task encodes its range and writes one shard, an Arrow file in
the random-access format whose record batches hold equal-length sequences (`input_ids`: fixed-size list of uint16 or
uint32) and masks (`mask`: fixed-size list of uint8, a bit for each id, highest first, 0 where the last sequence is padded).
A sequence and its mask are views of the mapped file, without a copy. Beside it lies an index file of the shard's documents (doc_id, start in the shard, n_tokens).

Files get a name of their own for each attempt of a task, and only the manifest that the successful attempts return names
files; what a lost or repeated attempt leaves behind is never read. Shards lie in the shared folder and are written and
read through pyarrow's file systems.

Defined results: a null text counts as empty, a document without tokens has the end id alone; texts are encoded whole,
whatever their length; rows that share a doc_id follow each other in the order of the XXH64 of their text, so that they too
are dealt out over tasks, and repeated rows follow each other; null ids come first; other columns, of whatever name, play no
part; an empty table writes no shard and gives no rows.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landfold.llm.bpe import ODD_BLANKS, Memory, slices, vocabulary_path, word_splitter
from landfold.llm.common import scratch, staged, table, text_of

END_ID = 2
CACHE_WORDS = 550_000
SHARD_BYTES = 128 << 20  # of text in a shard
SEQUENCE, BATCH = 2048, 128  # ids in a sequence, sequences in a record batch
MANIFEST = "shard int, tokens_path string, index_path string, n_documents bigint, n_tokens bigint"


def file_system(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + uri
    return fs.FileSystem.from_uri(uri)


class Encoder:
    """The tokenizers library over words, each distinct word encoded once.

    The vocabulary drops white space and cuts texts into words before anything else, so that a text's ids are those of its
    words in order; many new words go to the library as one text. A text with a special token's string or an unusual blank
    goes to it as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        self.special = [t.content for t in self.own.get_added_tokens_decoder().values()]
        self.width = np.dtype("<u2" if self.own.get_vocab_size() <= 1 << 16 else "<u4")
        self.words_of = word_splitter()
        suffix = self.own.model.end_of_word_suffix
        self.ends_word = np.array([bool(suffix) and (self.own.id_to_token(i) or "").endswith(suffix) for i in range(self.own.get_vocab_size())])
        self.pieces, self.words = Memory(CACHE_WORDS), Memory(CACHE_WORDS)

    def encode_words(self, words: list[str]) -> None:
        text = " ".join(words)
        ids = np.array(self.own.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.width)  # ids without offsets
        data, size = ids.tobytes(), self.width.itemsize
        last = np.flatnonzero(self.ends_word[ids]) + 1  # a word's last token is one with a word end
        if len(last) != len(words):
            last = np.searchsorted(np.array(self.own.encode(text, add_special_tokens=False).word_ids), np.arange(len(words)), side="right")
        ends = (last * size).tolist()
        start = 0
        for word, end in zip(words, ends, strict=True):
            self.words.now[word] = data[start:end]
            start = end

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        whole = [any(s in t for s in self.special) or any(b in t for b in ODD_BLANKS) for t in texts]
        split = [[] if w else t.split() for t, w in zip(texts, whole, strict=True)]
        lists = {p: self.words_of(p) for p in self.pieces.missing(set().union(*split))}
        new = [*self.words.missing({w for ws in lists.values() for w in ws})]
        if new:
            self.encode_words(new)
        for p, ws in lists.items():
            self.pieces.now[p] = self.words.now[ws[0]] if len(ws) == 1 else b"".join([self.words.now[w] for w in ws])
        look = self.pieces.now.__getitem__
        return [np.array(self.own.encode(t, add_special_tokens=False).ids, self.width).tobytes() if w else b"".join(map(look, ps)) for t, w, ps in zip(texts, whole, split, strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class ShardWriter:
    """Fills sequences and writes them out a record batch at a time."""

    def __init__(self, sink, width: np.dtype, sequence: int = SEQUENCE, batch: int = BATCH):
        if sequence % 8:
            raise ValueError("a sequence has a multiple of 8 ids")
        self.kind = pa.from_numpy_dtype(width)
        self.schema = pa.schema([("input_ids", pa.list_(self.kind, sequence)), ("mask", pa.list_(pa.uint8(), sequence // 8))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.width, self.sequence, self.room, self.held, self.n = width, sequence, sequence * batch, bytearray(), 0

    def add(self, ids: bytes) -> None:
        self.held += ids
        self.n += len(ids) // self.width.itemsize
        size = self.room * self.width.itemsize
        while len(self.held) >= size:
            self._write(np.frombuffer(bytes(self.held[:size]), self.width))
            del self.held[:size]

    def _write(self, ids: np.ndarray) -> None:
        padded = -len(ids) % self.sequence
        values = pa.array(np.concatenate([ids, np.zeros(padded, self.width)]), self.kind)
        mask = pa.array(np.packbits(np.concatenate([np.ones(len(ids), bool), np.zeros(padded, bool)])))
        lists = [pa.FixedSizeListArray.from_arrays(x, n) for x, n in ((values, self.sequence), (mask, self.sequence // 8))]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._write(np.frombuffer(bytes(self.held), self.width))
        self.writer.close()


class ShardReader:
    """Random access to a shard: sequences by number, ids by position. Local files are mapped, not read."""

    def __init__(self, uri: str):
        from pyarrow import fs

        system, path = file_system(uri)
        self.source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.sequence = self.file.schema.field("input_ids").type.list_size
        self.batches: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.per_batch = len(self._batch(0)[0]) if self.file.num_record_batches else 0

    def _batch(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.batches:
            if len(self.batches) > 64:
                self.batches = {}
            batch = self.file.get_batch(k)
            self.batches[k] = tuple(batch.column(c).flatten().to_numpy(zero_copy_only=True).reshape(batch.num_rows, -1) for c in ("input_ids", "mask"))
        return self.batches[k]

    def example(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequence n and its mask, a bit for each id, as views."""
        ids, mask = self._batch(n // self.per_batch)
        return ids[n % self.per_batch], mask[n % self.per_batch]

    def ids(self, start: int, n: int) -> np.ndarray:
        """The ids at positions start to start + n of the shard."""
        room, parts = self.per_batch * self.sequence, []
        while n > 0:
            ids = self._batch(start // room)[0].reshape(-1)[start % room : start % room + n]
            parts.append(ids)
            start, n = start + len(ids), n - len(ids)
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, np.uint16)])


def write_shards(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, sequence: int = SEQUENCE, batch: int = BATCH) -> DataFrame:
    """Writes the shards; returns their manifest, in which shards are in ascending order of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, end, shard = encoder(path), None, TaskContext.get().partitionId()
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex[:8]}"
        tokens = index = None
        index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        for rows in batches:
            for part, texts in slices(rows):
                if tokens is None:
                    sinks = [system.open_output_stream(f"{base}/{name}.{x}.arrow") for x in ("tokens", "index")]
                    tokens, index, n_documents = ShardWriter(sinks[0], own.width, sequence, batch), pa.ipc.new_file(sinks[1], index_schema), 0
                    end = np.array([end_id], own.width).tobytes()
                starts, sizes = [], []
                for ids in own.encode_batch(texts):
                    starts.append(tokens.n)
                    tokens.add(ids + end)
                    sizes.append(tokens.n - starts[-1])
                index.write_batch(pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=index_schema))
                n_documents += len(texts)
        if tokens is not None:
            tokens.close()
            index.close()
            for sink in sinks:
                sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f"{folder}/{name}.tokens.arrow"]), pa.array([f"{folder}/{name}.index.arrow"]), pa.array([n_documents], pa.int64()), pa.array([tokens.n], pa.int64())], ["shard", "tokens_path", "index_path", "n_documents", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_bytes // SHARD_BYTES + 1)
    dealt = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    return staged(dealt.mapInArrow(run, MANIFEST), "token-manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """Reads every document's ids back from the shards: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in rows.to_pylist():
                reader = ShardReader(row["tokens_path"])
                system, path = file_system(row["index_path"])
                with system.open_input_file(path) as source:
                    index = pa.ipc.open_file(source)
                    for k in range(index.num_record_batches):
                        part = index.get_batch(k)
                        starts, sizes = part.column("start").to_numpy(), part.column("n_tokens").to_numpy()
                        crcs = [zlib.crc32(reader.ids(s, n).astype("<u4").tobytes()) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(starts + row["base"], pa.int64()), part.column("n_tokens"), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row a shard: the running total over them is small.
    base = F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    placed = staged(manifest.withColumn("base", F.coalesce(base, F.lit(0)).cast("bigint")), "token-shards")
    shards = max(1, placed.count())
    spread = placed.select("shard", "tokens_path", "index_path", "base").repartition(shards)
    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    return read_documents(write_shards(table(spark, sf_dir, "documents"), vocabulary_path(), folder))


QUERIES: dict[str, Callable] = {"op10_token_files": op10_token_files}
ORACLE_SQL: dict[str, str] = {}
