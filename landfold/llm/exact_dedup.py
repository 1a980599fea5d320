"""Exact dedup against a persistent digest index, bucketed and sorted by hash.

Documents are reduced to one row per SHA-256 digest (combined before the shuffle, so a text that makes up a third of all
rows is no heavier than any other), compared with the index by a sort-merge anti-join that needs no exchange of the index,
and appended to it: what is new with its doc_id, what is known as a further count. A feed of documents goes in parts, by
descending ranges of doc_id, so that of equal texts the row with the largest doc_id is met first and is the one that stays.

A feed may be run again, after a failure or with other rows: a run that has come to its end leaves a row that says so, and of
each feed only the latest such run counts. compact() removes the rest, merges counts, and leaves one sorted file to a bucket,
in a table of the next generation, which takes over once it is whole.

Defined results: a null text counts as empty; of equal texts the row with the largest doc_id stays, a null doc_id being
the smallest; of rows equal in text and doc_id one stays; a text that another feed has put into the index stays nowhere in
this feed and keeps the earlier doc_id as keep_id; group_size counts all feeds. Texts are hashed whole, whatever their
length. Other columns, of whatever name, play no part. An empty feed gives no rows.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landfold.llm.common import staged, table, text_of

INDEX_SCHEMA = "digest binary, keep_id bigint, n bigint, feed string, run string"
#: Ranges of doc_id in which a feed is taken.
PARTS = 2


#: Feeds up to which the list of their latest runs is broadcast.
BROADCAST_FEEDS = 100_000
#: Ended runs after which the pipeline compacts its index.
COMPACT_AFTER = 4


class DigestIndex:
    """A managed Parquet table of (digest, keep_id, n, feed, run), bucketed and sorted by digest; all rows of a digest that
    count carry the same keep_id, and n adds up to the number of its documents. A row without a digest ends its run."""

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name = spark, name
        #: Each append writes one file for each bucket. The number is fixed when the table is made.
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        whole = [t for t in self.generations() if self._is_whole(t)]
        if not whole:
            self._begin(0, spark.createDataFrame([], INDEX_SCHEMA))
        self._tidy()

    def generations(self) -> list[str]:
        """The tables of this index, oldest first; more than one only where compact() was cut off."""
        return sorted(r.tableName for r in self.spark.sql(f"SHOW TABLES LIKE '{self.name}_g*'").collect())

    def _is_whole(self, name: str) -> bool:
        return any(r.key == "landfold.whole" for r in self.spark.sql(f"SHOW TBLPROPERTIES {name}").collect())

    def _begin(self, generation: int, rows: DataFrame, ended: int = 0) -> None:
        """ended: how many ended runs are in it from the start."""
        name = f"{self.name}_g{generation:09d}"
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._write(rows, name)
        self.spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('landfold.whole' = 'true', 'landfold.ended' = '{ended}')")

    def _tidy(self) -> None:
        """The latest whole generation stays."""
        self.table = [t for t in self.generations() if self._is_whole(t)][-1]
        for other in self.generations():
            if other != self.table:
                self.spark.sql(f"DROP TABLE IF EXISTS {other}")

    def _write(self, rows: DataFrame, name: str) -> None:
        dealt = rows.select("digest", "keep_id", "n", "feed", "run").repartition(self.buckets, "digest")
        dealt.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(name)

    def ended(self) -> DataFrame:
        """Each feed's latest run that came to its end."""
        return self.spark.table(self.table).where("digest IS NULL").groupBy("feed").agg(F.max("run").alias("run"))

    def read(self, feed: str | None = None, run: str | None = None) -> DataFrame:
        """The rows that count: those of each feed's latest ended run; for a run of a feed, its own in place of that."""
        rows, last = self.spark.table(self.table).where("digest IS NOT NULL"), self.ended()
        if feed is not None:
            last = last.where(F.col("feed") != feed).unionByName(self.spark.createDataFrame([(feed, run)], "feed string, run string"))
        last = staged(last, "index-runs")
        return rows.join(F.broadcast(last) if last.count() <= BROADCAST_FEEDS else last, ["feed", "run"], "left_semi")

    def append(self, rows: DataFrame) -> None:
        self._write(rows, self.table)

    def end(self, feed: str, run: str) -> None:
        """Says that a run is complete; until then its rows count for itself alone."""
        self._write(self.spark.createDataFrame([(None, None, 0, feed, run)], INDEX_SCHEMA), self.table)

    def runs(self) -> int:
        """Runs that have ended since the last compact()."""
        told = {r.key: r.value for r in self.spark.sql(f"SHOW TBLPROPERTIES {self.table}").collect()}
        return self.spark.table(self.table).where("digest IS NULL").count() - int(told["landfold.ended"])

    def compact(self) -> None:
        """One row for each digest and feed, of the feed's latest ended run, in one sorted file for each bucket."""
        live = self.read().groupBy("digest", "feed", "run").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        ends = self.ended().select(F.lit(None).cast("binary").alias("digest"), "feed", "run", F.lit(None).cast("bigint").alias("keep_id"), F.lit(0).cast("bigint").alias("n"))
        ends = staged(ends, "index-ends")
        self._begin(int(self.table.rsplit("_g", 1)[1]) + 1, live.unionByName(ends), ends.count())
        self._tidy()

    def drop(self) -> None:
        for name in self.generations():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def digest_column(text: str = "text") -> Column:
    return F.unhex(F.sha2(text_of(text).cast("binary"), 256))


def _ranges(rows: DataFrame, parts: int) -> list[Column]:
    """Conditions that deal doc_ids out into descending ranges of about equal size; nulls are in the last."""
    shares = [k / parts for k in range(parts - 1, 0, -1)]
    cuts = rows.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), 1000)).first()[0] if shares else []
    at, out, above = F.col("doc_id"), [], None
    for cut in dict.fromkeys(cuts or []):
        out.append((at >= cut) if above is None else (at >= cut) & (at < above))
        above = cut
    return [*out, F.lit(True) if above is None else at.isNull() | (at < above)]


def dedup_feed(docs: DataFrame, index: DigestIndex, feed: str, parts: int = PARTS) -> tuple[DataFrame, DataFrame, list[int]]:
    """Adds a feed to the index. Returns its rows (doc_id, digest, row_no); of each new digest the row that stays (digest,
    keep_row); and how many digests of each part the anti-join found new."""
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    rows = staged(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest_column().alias("digest"), F.monotonically_increasing_id().alias("row_no")), "digests")
    stay, news = None, []
    for own in _ranges(rows, parts):
        groups = rows.where(own).groupBy("digest").agg(F.max(F.struct("doc_id", "row_no")).alias("top"), F.count("*").alias("n"))
        groups = staged(groups.select("digest", F.col("top.doc_id").alias("keep_id"), F.col("top.row_no").alias("keep_row"), "n"), "digest-groups")
        earlier = index.read(feed, run).groupBy("digest").agg(F.max("keep_id").alias("earlier_id"))  # no exchange: by bucket
        fresh = groups.join(earlier.hint("merge"), "digest", "left_anti")
        known = groups.join(earlier.hint("merge"), "digest").select("digest", F.col("earlier_id").alias("keep_id"), F.lit(None).cast("bigint").alias("keep_row"), "n")
        verdict = staged(fresh.unionByName(known), "digest-verdicts")
        index.append(verdict.withColumns({"feed": F.lit(feed), "run": F.lit(run)}))
        new = verdict.where("keep_row IS NOT NULL").select("digest", "keep_row")
        news.append(new.count())
        stay = new if stay is None else stay.unionByName(new)
    index.end(feed, run)
    sizes = index.read(feed, run).groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return rows, staged(sizes.join(stay.hint("merge"), "digest", "left"), "digest-sizes"), news


def verdicts(docs: DataFrame, index: DigestIndex, feed: str) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, sizes, _ = dedup_feed(docs, index, feed)
    # Both sides are exchanged here, so that the adaptive planner can split the rows of a very common digest.
    return rows.join(sizes.hint("merge"), "digest").select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("row_no") == F.col("keep_row"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_new(docs: DataFrame, index: DigestIndex, feed: str) -> DataFrame:
    """The rows of docs that stay, with all their columns. The text moves once, by digest and doc_id together, so that the
    copies of a common text spread out."""
    _, sizes, _ = dedup_feed(docs, index, feed)
    stay = sizes.where("keep_row IS NOT NULL").select(F.col("digest").alias("_lf_digest"), F.coalesce("keep_id", F.lit(0)).alias("_lf_id"), F.col("keep_id").isNull().alias("_lf_null"))
    keys = ["_lf_digest", "_lf_id", "_lf_null"]
    marked = docs.withColumns({"_lf_digest": digest_column(), "_lf_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), "_lf_null": F.col("doc_id").isNull()})
    joined = marked.join(stay.hint("merge"), keys, "left_semi")
    # Rows alike in text and doc_id: one stays. The join has sorted by these keys already.
    return joined.withColumn("_lf_n", F.row_number().over(W.partitionBy(*keys).orderBy("_lf_id"))).where("_lf_n = 1").drop("_lf_n", *keys)


def new_index(spark: SparkSession) -> DigestIndex:
    return DigestIndex(spark, f"landfold_digests_{uuid.uuid4().hex[:16]}")


def named_index(spark: SparkSession, purpose: str, sf_dir: str) -> DigestIndex:
    """The lasting index of a purpose over a folder of tables. Without a metastore tables last as long as the application,
    which is then part of the name, so that files of an earlier one don't stand in the way."""
    name = f"landfold_digests_{purpose}_{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    if spark.conf.get("spark.sql.catalogImplementation") == "in-memory":
        name += "_" + "".join(c if c.isalnum() else "_" for c in spark.conf.get("spark.app.id")).lower()
    return DigestIndex(spark, name)


def feed_of(files: list[str]) -> str:
    """A feed's name by the files that it comes from: the same files are the same feed, further ones make another."""
    return hashlib.sha256("\n".join(sorted(files)).encode()).hexdigest()[:16]


def keep_new_of(docs: DataFrame, index: DigestIndex, files: list[str]) -> DataFrame:
    """keep_new() of a feed that comes from these files, compacting the index now and then."""
    kept = staged(keep_new(docs, index, feed_of(files)), "new-texts")
    if index.runs() > COMPACT_AFTER:
        index.compact()
    return kept


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index is this query's own; it goes once the result is written."""
    index = new_index(spark)
    found = staged(verdicts(table(spark, sf_dir, "documents"), index, "documents"), "exact-verdicts")
    index.drop()
    return found


QUERIES: dict[str, Callable] = {"op2_exact_dedup": op2_exact_dedup}
ORACLE_SQL = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
}
