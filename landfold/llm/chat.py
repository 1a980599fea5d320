"""Chat formatting in budgeted windows.

Turns are written as `<|im_start|>role\\ntext<|im_end|>\\n`. Prefix sums of the turns' tokens deal a conversation's turns out
into windows: a turn belongs to the window in which its prefix sum falls, so windows begin and end at turns. Each window
begins with the conversation's system turn (a first turn with role `system`) and with the last turns before it, up to a
limited number of tokens; these are repeated, and not under the loss mask. The mask holds the texts of the assistant's
turns in the one window to which each belongs.

Control strings in texts are escaped reversibly: `<|` becomes `&lt;|`, and an `&` before (any number of `amp;` and) `lt;|`
becomes `&amp;`. In roles `&`, the line end and `<|` are escaped as well.

Only DataFrame functions. A turn costs its UTF-8 bytes, as written, div 4 plus 1. A window's own turns start within STRIDE
tokens; a turn longer than that stays whole. Defined results: null role or text counts as empty; rows are in the order of
turn (null first), then role, then text, and repeated rows are turns of their own; texts of any length stay whole; rows with
a null conv_id form one conversation; other columns, of whatever name, play no part; an empty table gives only what the caller adds. As the digest of a conversation is asked for whole, its turns
meet in one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landfold.llm.common import table

START, END = "<|im_start|>", "<|im_end|>"
STRIDE, HISTORY = 512, 256  # tokens of a window's own turns, and of repeated ones
PROBE = "<|im_end|><|im_start|>assistant ok"


def escaped(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"&((?:amp;)*lt;\|)", "&amp;$1"), F.lit("<|"), F.lit("&lt;|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), r"&amp;((?:amp;)*lt;\|)", "&$1")


def escaped_role(role: Column) -> Column:
    for a, b in (("&", "&amp;"), ("\n", "&#10;"), ("<|", "&lt;|")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def unescaped_role(role: Column) -> Column:
    for a, b in (("&lt;|", "<|"), ("&#10;", "\n"), ("&amp;", "&")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def format_windows(conversations: DataFrame, stride: int = STRIDE, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window, text, n_turns, n_repeated (turns at its start) and loss_spans (start and length
    in code points)."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = W.partitionBy("conv_id")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    rows = rows.withColumns({"idx": F.row_number().over(order), "head": F.length(head), "body": escaped(F.col("text"))})
    rows = rows.withColumn("piece", F.concat(head, "body", F.lit(END + "\n")))
    rows = rows.withColumn("system", (F.col("idx") == 1) & (F.col("role") == "system"))
    rows = rows.withColumn("cost", F.when(F.col("system"), 0).otherwise(F.floor(F.octet_length("piece") / 4) + 1))
    rows = rows.withColumn("at", F.coalesce(F.sum("cost").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("raw", F.floor(F.col("at") / stride))
    rows = rows.withColumn("new", F.coalesce((F.col("raw") != F.lag("raw").over(order)).cast("int"), F.lit(0)))
    rows = rows.withColumn("own", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("last", F.max("own").over(whole))
    reach = F.least("last", F.when(F.col("system"), F.col("last")).otherwise(F.col("own") + F.floor((F.col("at") + history) / stride) - F.col("raw")))
    member = F.struct("idx", "system", "at", "role", "piece", "head", F.length("body").alias("n"), (F.col("window") == F.col("own")).alias("fresh"))
    dealt = rows.withColumn("window", F.explode(F.sequence("own", F.greatest("own", reach))))
    grouped = dealt.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(member)).alias("m"), F.min(F.when(F.col("window") == F.col("own"), F.col("at"))).alias("first_at"))
    grouped = grouped.withColumn("m", F.filter("m", lambda t: t.fresh | t.system | (t.at >= F.col("first_at") - history)))
    ends = F.transform("m", lambda t, k: F.aggregate(F.slice("m", 1, k), F.lit(0), lambda a, x: a + F.length(x.piece)) + t["head"])
    spans = F.filter(F.zip_with("m", ends, lambda t, e: F.struct(e.alias("start"), t.n.alias("length"), (t.fresh & (t.role == "assistant")).alias("loss"))), lambda s: s.loss)
    return grouped.select(
        "conv_id", "window", F.array_join(F.transform("m", lambda t: t.piece), "").alias("text"), F.size("m").alias("n_turns"), F.size(F.filter("m", lambda t: ~t.fresh)).alias("n_repeated"),
        F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.length.alias("length"))).alias("loss_spans"))


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows say of each conversation: conv_id, turns (role, text) without the repeated ones, the texts under the
    loss mask, and the code points written."""
    parts = F.split("text", r"<\|im_end\|>\n")
    own = F.slice(parts, F.col("n_repeated") + 1, F.col("n_turns") - F.col("n_repeated"))

    def turn(part: Column) -> Column:
        body = F.substring(part, F.lit(len(START) + 1), F.length(part))
        at = F.locate("\n", body)
        return F.struct(unescaped_role(F.substring(body, F.lit(1), at - 1)).alias("role"), unescaped(F.substring(body, at + 1, F.length(body))).alias("text"))

    parsed = windows.select("conv_id", F.struct("window", F.transform(own, turn).alias("turns"), F.transform("loss_spans", lambda s: unescaped(F.substring("text", s.start + 1, s.length))).alias("loss"), F.length("text").alias("n")).alias("w"))
    whole = parsed.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    return whole.select("conv_id", F.flatten(F.transform("w", lambda x: x.turns)).alias("turns"), F.flatten(F.transform("w", lambda x: x.loss)).alias("loss"), F.aggregate("w", F.lit(0).cast("bigint"), lambda a, x: a + x.n).alias("formatted_chars"))


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.sql(f"SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '{PROBE}' AS text UNION ALL SELECT -1L, 1L, 'assistant', '{PROBE}'")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return read_back(format_windows(rows)).select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


QUERIES: dict[str, Callable] = {"op6_chat_windows": op6_chat_windows}
ORACLE_SQL = {
    "op6_chat_windows": rf"""
        WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')),
        a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS idx,
            '{START}' || replace(replace(replace(role, '&', '&amp;'), chr(10), '&#10;'), '<|', '&lt;|') || chr(10) || replace(regexp_replace(text, '&((?:amp;)*lt;\|)', '&amp;\1', 'g'), '<|', '&lt;|') || '{END}' || chr(10) AS piece FROM said),
        b AS (SELECT *, idx = 1 AND role = 'system' AS sys, CASE WHEN idx = 1 AND role = 'system' THEN 0 ELSE strlen(piece) // 4 + 1 END AS cost FROM a),
        c AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM b),
        d AS (SELECT *, pos // {STRIDE} AS own, min(pos) OVER (PARTITION BY conv_id, pos // {STRIDE}) AS first_at FROM c),
        w AS (SELECT DISTINCT conv_id, own AS win, first_at AS win_at FROM d),
        members AS (SELECT d.*, win FROM d JOIN w ON w.conv_id = d.conv_id AND (win = own OR win > own AND (sys OR pos >= win_at - {HISTORY}))),
        written AS (SELECT conv_id, sum(length(piece))::BIGINT AS formatted_chars FROM members GROUP BY conv_id),
        told AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256,
            coalesce(string_agg(text, '' ORDER BY idx) FILTER (WHERE role = 'assistant'), '') AS loss FROM d GROUP BY conv_id)
        SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM told JOIN written USING (conv_id)""",
}
