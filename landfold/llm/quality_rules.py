"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each text gets counts; from them come four rates in parts per thousand (or hundredths of a code point). For each language
and source, and for each rate, a sketch counts the documents that pass the base rules per bin, bins being exact below 256
and then 128 to each power of two (a relative error of 1/128 at most); sketches are rows, so they merge by adding counts.
All limits are read from the sketches, in one of two forms:

- fence: the quartiles, and from them outwards a number of times their distance, on both sides;
- tail: above only, the greater of such a fence and of a high quantile plus a part of the mean excess over it, that excess
  being spread over the share of documents that the quantile leaves above it. The fence decides where a rate varies through
  the whole group, the quantile where most documents have 0.

A group's limits are drawn towards those of its language, and these towards those of all documents, by the weights
n / (n + SHRINK) with n the group's documents; there is no size at which the rule changes. A document stays if it passes the
two base rules and no rate leaves its group's range.

Defined results: a null text counts as empty; null lang or source are groups of their own; rows that share a doc_id are each
returned, equal rows alike; a rate whose denominator is 0 is 0; texts of any length are counted whole; other columns, of
whatever name, play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landfold.llm.common import staged, table, text_of

BLANKS, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
#: A window of so many words that is found twice marks its words as repeated.
REPEAT = 8
#: Documents with which a group weighs as much as what it is drawn towards.
SHRINK = 50
#: rate -> (numerator, denominator, scale, form). A form: its kind, the fence's width in distances of the quartiles, and of a
#: tail the quantile in thousandths and quarters of the mean excess.
RATES = {
    "word_length": ("word_chars", "n_words", 100, ("fence", 5)),
    "symbols": ("n_symbols", "word_chars", 1000, ("tail", 3, 900, 1)),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, ("tail", 3, 990, 16)),
    "repeats": ("n_repeat_words", "n_words", 1000, ("tail", 3, 990, 16)),
}
#: Bins are exact below EXACT; from there EXACT / 2 to each power of two.
EXACT_BITS = 8
EXACT, HALF = 1 << EXACT_BITS, 1 << (EXACT_BITS - 1)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
_POWERS = np.random.default_rng(42).integers(1 << 62, size=REPEAT, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of REPEAT words that is found twice or more."""
    n = len(words) - REPEAT + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(REPEAT):
        mixed += ids[k : k + n] * _POWERS[k]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    marked = np.zeros(n, bool)
    seen: dict[tuple, int] = {}
    inside = np.zeros(n, bool)
    inside[1:] |= same
    inside[:-1] |= same
    for at in order[inside].tolist():  # equal hashes: the words themselves decide
        first = seen.setdefault(tuple(words[at : at + REPEAT]), at)
        if first != at:
            marked[first] = marked[at] = True
    spread = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(marked)
    np.add.at(spread, starts, 1)
    np.add.at(spread, starts + REPEAT, -1)
    return int((np.cumsum(spread)[:-1] > 0).sum())


def text_counts(text: bytes) -> tuple[int, ...]:
    """COUNTS of one text, given in UTF-8."""
    words = text.split()
    solid = text.translate(None, BLANKS)
    lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
    return len(words), len(solid.decode()), len(solid) - len(solid.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        found = np.array([text_counts(texts[k].as_buffer().to_pybytes()) for k in range(len(texts))], np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "source")), *(pa.array(found[:, k]) for k in range(len(COUNTS)))], ["doc_id", "lang", "source", *COUNTS])


def counts(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text_of().cast("binary").alias("text"))
    return rows.mapInArrow(_count, "doc_id bigint, lang string, source string, " + ", ".join(f"{c} bigint" for c in COUNTS))


def rate(name: str) -> Column:
    top, bottom, scale, _ = RATES[name]
    return F.expr(f"CASE WHEN {bottom} > 0 THEN {top} * {scale} div {bottom} ELSE 0 END")


def bin_of(value: str) -> Column:
    power = f"(length(bin({value})) - {EXACT_BITS})"
    return F.expr(f"CASE WHEN {value} < {EXACT} THEN {value} ELSE {EXACT} + ({power} - 1) * {HALF} + shiftright({value}, {power}) - {HALF} END")


def bin_start(b: str) -> Column:
    """The least value in a bin."""
    return F.expr(f"CASE WHEN {b} < {EXACT} THEN {b} ELSE shiftleft({HALF}L + ({b} - {EXACT}) % {HALF}, CAST(({b} - {EXACT}) div {HALF} + 1 AS int)) END")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def sketches(counted: DataFrame, group: list[str]) -> DataFrame:
    """(group, rate, bin, n) rows."""
    long = counted.select(*group, F.explode(F.create_map(*[x for r in RATES for x in (F.lit(r), rate(r))])).alias("rate", "_lf_v"))
    return long.groupBy(*group, "rate", bin_of("_lf_v").alias("_lf_b")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, group: list[str]) -> DataFrame:
    """Sketches of coarser groups."""
    return sketch.groupBy(*group, "rate", "_lf_b").agg(F.sum("n").alias("n"))


def _by_rate(value) -> Column:
    """A number that depends on the row's rate."""
    return F.coalesce(*[F.when(F.col("rate") == r, F.lit(value(spec[3]))) for r, spec in RATES.items()])


def limits(sketch: DataFrame, group: list[str]) -> DataFrame:
    """(group, rate, total, low, high) of sketches; a low of 0 excludes nothing."""
    by = W.partitionBy(*group, "rate")
    run = sketch.withColumns({"upto": F.sum("n").over(by.orderBy("_lf_b")), "total": F.sum("n").over(by), "v": bin_start("_lf_b")})
    quantile = lambda k: F.min(F.when(F.col("upto") * 1000 >= F.col("total") * k, F.col("v"))).over(by)
    level = _by_rate(lambda form: form[2] if form[0] == "tail" else 1000)
    run = run.withColumns({"q": quantile(level), "q25": quantile(F.lit(250)), "q75": quantile(F.lit(750))})
    found = run.groupBy(*group, "rate").agg(*[F.first(c).alias(c) for c in ("total", "q", "q25", "q75")], F.sum(F.col("n") * F.greatest(F.col("v") - F.col("q"), F.lit(0))).alias("excess"))
    found = found.withColumns({"quarters": _by_rate(lambda form: form[3] if form[0] == "tail" else 0), "left": 1000 - level, "reach": _by_rate(lambda form: form[1]) * (F.col("q75") - F.col("q25")), "fence": _by_rate(lambda form: form[0] == "fence")})
    margin = F.expr("coalesce(CAST(excess AS decimal(25,0)) * 1000 * quarters div nullif(CAST(total AS decimal(20,0)) * 4 * left, 0), 0)")
    above = F.col("q75") + F.col("reach")
    high = F.when(F.col("fence"), above).otherwise(F.greatest(above, F.col("q") + margin))
    return found.select(*group, "rate", "total", F.when(F.col("fence"), F.greatest(F.col("q25") - F.col("reach"), F.lit(0))).otherwise(0).cast("bigint").alias("low"), high.cast("bigint").alias("high"))


def _keys(counted: DataFrame) -> DataFrame:
    """Language and source as keys in which null is a value."""
    return counted.withColumns({f"{c}_key": F.coalesce(F.concat(F.lit("="), c), F.lit("null")) for c in ("lang", "source")})


def thresholds(counted: DataFrame) -> DataFrame:
    """One row per language and source with documents that pass the base rules: lang_key, source_key, and low_ and high_ of
    each rate."""
    fine = staged(sketches(_keys(counted).where(~base_failed()), ["lang_key", "source_key"]), "rate-sketches")
    own = limits(fine, ["lang_key", "source_key"])
    lang = limits(merged(fine, ["lang_key"]), ["lang_key"]).select("lang_key", "rate", *[F.col(c).alias(f"l_{c}") for c in ("total", "low", "high")])
    every = limits(merged(fine, []), []).select("rate", *[F.col(c).alias(f"a_{c}") for c in ("low", "high")])
    found = own.join(lang, ["lang_key", "rate"]).join(every, "rate")
    for c in ("low", "high"):
        found = found.withColumn(f"l_{c}", F.expr(f"(l_total * l_{c} + {SHRINK} * a_{c}) div (l_total + {SHRINK})"))
        found = found.withColumn(c, F.expr(f"(total * {c} + {SHRINK} * l_{c}) div (total + {SHRINK})"))
    return found.groupBy("lang_key", "source_key").agg(*[F.max(F.when(F.col("rate") == r, F.col(c))).alias(f"{c}_{r}") for r in RATES for c in ("low", "high")])


def judged(docs: DataFrame) -> DataFrame:
    """COUNTS, base_failed and kept for every document."""
    counted = staged(counts(docs), "text-counts")
    found = staged(thresholds(counted), "rate-limits")
    # One row a language and source: broadcast while they are few, else a join whose hot keys the planner splits.
    small = found.limit(5001).count() <= 5000
    joined = _keys(counted).join(F.broadcast(found) if small else found.hint("merge"), ["lang_key", "source_key"], "left")
    passed = F.lit(True)
    for r in RATES:
        passed = passed & rate(r).between(F.col(f"low_{r}"), F.col(f"high_{r}"))
    # A group without limits has only documents that fail the base rules.
    return joined.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & F.coalesce(passed, F.lit(False))})


def op8_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    rates = {r: f"CASE WHEN {b} > 0 THEN {t} * {k} // {b} ELSE 0 END" for r, (t, b, k, _) in RATES.items()}
    long = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rate, {e} AS v FROM passing" for r, e in rates.items())
    by_rate = lambda value: "CASE rate " + " ".join(f"WHEN '{r}' THEN {value(spec[3])}" for r, spec in RATES.items()) + " END"
    level, quarters = by_rate(lambda f: f[2] if f[0] == "tail" else 1000), by_rate(lambda f: f[3] if f[0] == "tail" else 0)
    fence, reach = by_rate(lambda f: f[0] == "fence"), f"{by_rate(lambda f: f[1])} * (q75 - q25)"

    def limits(group: str) -> str:
        w = f"PARTITION BY {group} rate"
        return f"""SELECT {group} rate, total, CASE WHEN {fence} THEN greatest(q25 - {reach}, 0) ELSE 0 END AS low,
            CASE WHEN {fence} THEN q75 + {reach} ELSE greatest(q75 + {reach}, q + coalesce(excess * 1000 * {quarters} // nullif(total * 4 * (1000 - {level}), 0), 0)) END AS high FROM (
            SELECT {group} rate, any_value(total) AS total, any_value(q) AS q, any_value(q25) AS q25, any_value(q75) AS q75, sum(n * greatest(start - q, 0)) AS excess FROM (
            SELECT *, min(CASE WHEN upto * 1000 >= total * {level} THEN start END) OVER ({w}) AS q, min(CASE WHEN upto * 1000 >= total * 250 THEN start END) OVER ({w}) AS q25, min(CASE WHEN upto * 1000 >= total * 750 THEN start END) OVER ({w}) AS q75 FROM (
            SELECT *, sum(n) OVER ({w} ORDER BY b) AS upto, sum(n) OVER ({w}) AS total, CASE WHEN b < {EXACT} THEN b ELSE ({HALF} + (b - {EXACT}) % {HALF}) << ((b - {EXACT}) // {HALF} + 1) END AS start
            FROM (SELECT {group} rate, b, sum(n) AS n FROM fine GROUP BY ALL))) GROUP BY {group} rate)"""

    wide = ", ".join(f"max(CASE WHEN rate = '{r}' THEN {c} END) AS {c}_{r}" for r in RATES for c in ("low", "high"))
    passed = " AND ".join(f"({e}) BETWEEN low_{r} AND high_{r}" for r, e in rates.items())
    drawn = lambda n, own, other: f"({n} * {own} + {SHRINK} * ({other})) // ({n} + {SHRINK})"
    both = ", ".join(drawn("own.total", f"own.{c}", drawn("by_lang.total", f"by_lang.{c}", f"every.{c}")) + f" AS {c}" for c in ("low", "high"))
    return rf"""
        WITH words AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), 1) AS k FROM documents),
        grams AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, gram) AS found FROM (
            SELECT doc_id, k, list(word) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND {REPEAT - 1} FOLLOWING) AS gram FROM words) WHERE len(gram) = {REPEAT}),
        repeated AS (SELECT doc_id, count(DISTINCT k + i) AS n_repeat_words FROM grams, range({REPEAT}) AS r(i) WHERE found > 1 GROUP BY doc_id),
        texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
        counted AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
            len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines FROM texts LEFT JOIN repeated USING (doc_id)),
        based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted), passing AS (SELECT * FROM based WHERE NOT base_failed),
        fine AS (SELECT lang, source, rate, CASE WHEN v < {EXACT} THEN v ELSE {EXACT} + (length(bin(v)) - {EXACT_BITS + 1}) * {HALF} + (v >> (length(bin(v)) - {EXACT_BITS})) - {HALF} END AS b, count(*) AS n FROM ({long}) GROUP BY ALL),
        own AS ({limits("lang, source,")}), by_lang AS ({limits("lang,")}), every AS ({limits("")}),
        drawn AS (SELECT own.lang, own.source, rate, {both} FROM own JOIN by_lang USING (lang, rate) JOIN every USING (rate)),
        limits AS (SELECT lang, source, {wide} FROM drawn GROUP BY lang, source)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({passed}, false) AS kept FROM based LEFT JOIN limits USING (lang, source)"""


QUERIES: dict[str, Callable] = {"op8_adaptive_rules": op8_adaptive_rules}
ORACLE_SQL = {"op8_adaptive_rules": _sql()}
