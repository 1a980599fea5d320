"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Features are hashed into 2^18 places: words (lower case), pairs of neighbouring words, the words' shapes (runs of upper
case, lower case and digits, and signs as they are, each run of whatever length one sign) and pairs of shapes; a pair of the same word twice has one place for all
words. Each family's counts are divided by its size, so that a text's length plays no part. A score is a sparse dot product,
the bias plus the sum of the weights at a text's n-grams.

Training reads at most TRAIN_ROWS labelled rows, those with the smallest hashes of their doc_id among those not held out;
the bound is a parameter of train(). Their n-grams are made where the texts are; only these sparse vectors meet in one
task, as the updates are sequential. Scoring reads all rows, and whole texts.

Defined results: a null text counts as empty and has the bias's score; labels of a doc_id given more than once count by
majority; of documents that share a labelled doc_id the least text is learned from; without labels every score is 0.5; rows
that share a doc_id, and repeated rows, are each scored; a null doc_id is not held out and never learned from; columns of any
name but _lf_score are handed on; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landfold.llm.bpe import slices
from landfold.llm.common import staged, table, text_of

PLACES = 1 << 18
TRAIN_ROWS, EPOCHS, THRESHOLD, FOLDS = 8000, 2, 0.3, 5
#: Of the updates: learning rate, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-3
CACHE_WORDS = 250_000
BIAS, TWICE = 0, 1  # two places of their own
_RUNS = re.compile(r"(.)\1+", re.S)


def shape(word: str) -> str:
    out = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return _RUNS.sub(r"\1", out)


class Features:
    """Words to places, remembered for each distinct word."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.word, self.shape = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)

    def learn(self, words: set[str]) -> None:
        """Makes all of words known; those of earlier calls are forgotten where there is no room for the new ones. What is
        asked for together is known together, even where that alone passes the bound."""
        from xxhash import xxh64_intdigest

        new = {w for w in words if w not in self.known}  # a difference with keys() would go through all of these
        if new and len(self.known) + len(new) > CACHE_WORDS:
            self.clear()
            new = words
        n = len(self.known)
        room = len(self.word)
        while room < n + len(new):
            room *= 2
        if room > len(self.word):
            self.word, self.shape = np.resize(self.word, room), np.resize(self.shape, room)
        for k, w in enumerate(new, n):
            self.known[w] = k
            self.word[k] = xxh64_intdigest(w.lower(), 1)
            self.shape[k] = xxh64_intdigest(shape(w), 2)

    def places(self, words: list[str]) -> list[np.ndarray]:
        """The places of each family's n-grams."""
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        w, s = self.word[at], self.shape[at]
        pair = w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        form = s[:-1] * np.uint64(0xD6E8FEB86659FD93) + s[1:] * np.uint64(0xA0761D6478BD642F)
        found = [2 + (x >> np.uint64(40)).astype(np.int64) % (PLACES - 2) for x in (w, pair, s, form)]
        found[1][w[:-1] == w[1:]] = TWICE
        return found

    def lists(self, texts: list[str]) -> list[list[str]]:
        """The words of texts, all of them known until the next call."""
        split = [t.split() for t in texts]
        self.learn({w for ws in split for w in ws})
        return split

    def each(self, texts: Iterable[str]) -> Iterator[list[np.ndarray]]:
        """places() of each text; only one text's words are in use at a time."""
        for t in texts:
            yield self.places(self.lists([t])[0])


class Ftrl:
    """Per-coordinate updates; a weight is worked out from its sums when it is needed."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(PLACES), np.zeros(PLACES)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def update(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - step * w
        self.n[at] += g * g


def sparse(families: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places and their values, the bias among them."""
    at = np.concatenate([[BIAS], *families])
    value = np.concatenate([[1.0], *[np.full(len(f), 1 / max(1, len(f))) for f in families]])
    places, back = np.unique(at, return_inverse=True)
    return places, np.bincount(back, value)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """order, label and the sparse vector of each text."""
    features = Features()
    for batch in batches:
        for part, texts in slices(batch):
            found = [sparse(f) for f in features.each(texts)]
            yield pa.RecordBatch.from_arrays([part.column("order"), part.column("label"), pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))], ["order", "label", "places", "amounts"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model, rows = Ftrl(), []
    for batch in batches:
        for k, label in enumerate(batch.column("label").to_pylist()):
            rows.append((batch.column("places")[k].values.to_numpy(), batch.column("amounts")[k].values.to_numpy(), label))
    for _ in range(EPOCHS):
        for at, value, label in rows:
            model.update(at, value, label)
    weights = model.weights(np.arange(PLACES)).astype("<f4")
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()])], ["weights"])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """The weights, PLACES of them (1 MB). labels: doc_id, quality."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    sample = usable.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label")).withColumn("order", F.xxhash64("doc_id"))
    sample = staged(sample.orderBy("order", "doc_id").limit(rows), "labelled-sample")
    # At most `rows` rows are broadcast, and one text is left of each doc_id.
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "order", "label").agg(F.min("text").alias("text"))
    vectors = texts.select("order", "doc_id", "label", "text").mapInArrow(_vectors, "order bigint, label int, places array<int>, amounts array<float>")
    found = vectors.repartition(1).sortWithinPartitions("order").mapInArrow(_fit, "weights binary").collect()
    return np.frombuffer(bytes(found[0][0]), "<f4") if found else np.zeros(PLACES, np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs with _lf_score; texts are read as they are, null as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, w = Features(), shared.value.astype(np.float64)
        for batch in batches:
            for part, texts in slices(batch):
                scores = []
                for families in features.each(t or "" for t in texts):
                    total = w[BIAS] + sum(w[f].sum() / len(f) for f in families if len(f))
                    scores.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], [*part.schema.names, "_lf_score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, `_lf_score` double")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score reaches the threshold."""
    return score(docs, train(docs, labels)).where(F.col("_lf_score") >= THRESHOLD).drop("_lf_score")


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("_lf_score").alias("score"), (F.col("_lf_score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES: dict[str, Callable] = {"op5_quality_model": op5_quality_model}
ORACLE_SQL: dict[str, str] = {}
