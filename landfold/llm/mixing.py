"""Mixing sources to target weights: hierarchical budgets over a domain - language - source tree.

A token budget goes down the tree. Among siblings each gets its share by weight, at most what lies below it (its tokens
times the number of epochs); what one can't take goes to its siblings by weight, and only what a whole family can't take
goes on to the family's own siblings, because a family's ceiling is the sum of its members', of those that have a weight.
The shares come in closed form from running sums over one row per node, in whole numbers, so that nothing is lost to rounding;
a family's children are dealt out by ranges, so that one with millions of sources is no burden either.

A leaf with quota q and t tokens is read q div t times in full, and of the next epoch a prefix of q mod t tokens: the
documents in the order of a hash of (seed, epoch, doc_id), then of their texts' hash, as long as their running total stays
within it. The cut is found from histograms of the hash's bits, 64 bins of a leaf and then 64 of the one bin where it falls,
until the bin is small; no task sees a whole leaf, so a source with a third of all rows is no burden.

Only DataFrame functions. Defined results: null domain, lang or source count as 'unknown'; tokens are the text's UTF-8 bytes div 4
plus 1, of the whole text (null text: empty); rows without a doc_id are ordered by their text's hash; rows alike in doc_id and
text go in or stay out together; weights may be fractions, and one of 0 gives nothing (one below 0 is refused); columns of any name are handed on,
as the operator's own begin with _lf_; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landfold.llm.common import staged, table, text_of

LEAF = ["_lf_domain", "_lf_lang", "_lf_source"]
LEVEL_BITS, HASH_BITS = 6, 60
#: What a leaf's documents are ordered by; rows of a bin below which no further histogram is made.
ORDER, BIN_ROWS = ["_lf_hash", "_lf_id", "_lf_text"], 50_000
#: A table of leaves is broadcast up to so many rows, of about 100 bytes each; beyond that it is joined by a shuffle that
#: the adaptive planner can split.
BROADCAST_LEAVES = 2000
WHOLE = "decimal(20,0)"


@dataclass(frozen=True)
class Mixture:
    """Target weights by name, whole numbers or fractions; a name that isn't given has `other`."""

    domain: str = "CASE WHEN source IS NULL THEN 'unknown' WHEN length(source) <= 4 THEN 'web' ELSE 'curated' END"
    domains: dict = field(default_factory=lambda: {"web": 3, "curated": 2})
    langs: dict = field(default_factory=lambda: {"en": 4, "de": 2, "fr": 2, "es": 2})
    sources: dict = field(default_factory=dict)
    other: float = 1
    percent: int = 80  # of the corpus's tokens
    epochs: int = 3
    seed: int = 42


def whole_weights(names: dict, other) -> tuple[dict, int]:
    """Weights, in whole numbers of the same proportions."""
    exact = {k: Fraction(str(v)) for k, v in [*names.items(), (None, other)]}
    if min(exact.values()) < 0:
        raise ValueError("a weight is 0 or more")
    scale = math.lcm(*[v.denominator for v in exact.values()])
    whole = {k: int(v * scale) for k, v in exact.items()}
    shared = math.gcd(*whole.values()) or 1
    whole = {k: v // shared for k, v in whole.items()}
    if max(whole.values()) > 1_000_000_000:
        raise ValueError("weights are too unlike or too finely graded")
    return whole, whole.pop(None)


def _weight(names: dict, column: str, other) -> Column:
    known, rest = whole_weights(names, other)
    found = F.lit(rest)
    for name, weight in known.items():
        found = F.when(F.col(column) == name, weight).otherwise(found)
    return found.cast("bigint")


def _with_leaf(docs: DataFrame, mix: Mixture) -> DataFrame:
    return docs.withColumns({"_lf_domain": F.coalesce(F.expr(mix.domain), F.lit("unknown")), "_lf_lang": F.coalesce("lang", F.lit("unknown")), "_lf_source": F.coalesce("source", F.lit("unknown")),
                             "_lf_tokens": F.floor(F.octet_length(text_of()) / 4).cast("bigint") + 1, "_lf_text": F.xxhash64(text_of())})


def _with_running(rows: DataFrame, family: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows: with _lf_part, ranges of the order. Adds for each sum its total over the family (_lf_all_) and what comes before the
    row (_lf_pre_): a range's own running sum, and what the family has in earlier ranges. No task has a whole family."""
    held = rows.groupBy(*family, "_lf_part").agg(*[F.sum(c).alias(f"_lf_sum_{n}") for n, c in sums.items()])
    whole = W.partitionBy(*family) if family else W.partitionBy(F.lit(0))  # a row for each range
    earlier = whole.orderBy("_lf_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = held.select(*family, "_lf_part", *[F.sum(f"_lf_sum_{n}").over(whole).alias(f"_lf_all_{n}") for n in sums], *[F.coalesce(F.sum(f"_lf_sum_{n}").over(earlier), F.lit(0)).alias(f"_lf_off_{n}") for n in sums])
    own = W.partitionBy(*family, "_lf_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = rows.join(offsets, [*family, "_lf_part"])
    return placed.withColumns({f"_lf_pre_{n}": F.col(f"_lf_off_{n}") + F.coalesce(F.sum(c).over(own), F.lit(0)) for n, c in sums.items()})


def share(nodes: DataFrame, family: list[str], name: str) -> DataFrame:
    """nodes: one row per child with cap, weight and the family's budget. Adds quota."""
    whole = lambda c: F.col(c).cast(WHOLE)
    order = ["_lf_ratio", name]
    ranked = nodes.withColumn("_lf_ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf"))))
    ranked = staged(ranked.repartitionByRange(*family, *order).withColumn("_lf_part", F.spark_partition_id()), "mix-children")
    first = _with_running(ranked, family, order, {"cap": F.col("cap"), "weight": F.col("weight")})
    rest = F.col("_lf_all_weight") - F.col("_lf_pre_weight")
    full = (F.col("weight") > 0) & (whole("cap") * rest.cast(WHOLE) <= whole("weight") * (whole("budget") - whole("_lf_pre_cap")))
    filled = staged(first.select(*ranked.columns, full.alias("_lf_full")), "mix-filled")
    second = _with_running(filled, family, order, {"taken": F.when(F.col("_lf_full"), F.col("cap")).otherwise(0), "open": F.when(F.col("_lf_full"), 0).otherwise(F.col("weight"))})
    second = second.withColumns({"_lf_left": F.col("budget") - F.col("_lf_all_taken"), "_lf_upto": F.col("_lf_pre_open") + F.when(F.col("_lf_full"), 0).otherwise(F.col("weight"))})
    upto = "CAST(_lf_left AS decimal(20,0)) * CAST({} AS decimal(18,0)) div nullif(_lf_all_open, 0)"
    part = F.expr(upto.format("_lf_upto")) - F.expr(upto.format("(_lf_upto - weight)"))
    quota = F.when(F.col("_lf_full"), F.col("cap")).when(F.col("weight") > 0, F.coalesce(part, F.lit(0))).otherwise(0)
    return second.select(*nodes.columns, quota.cast("bigint").alias("quota"))


def leaf_quotas(leaves: DataFrame, mix: Mixture) -> DataFrame:
    """leaves: LEAF columns and tokens. Returns them with quota, full (whole epochs) and part (tokens of the next)."""
    weights = dict(zip(LEAF, (mix.domains, mix.langs, mix.sources), strict=True))
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * mix.percent / 100).cast("bigint").alias("budget"))
    # Ceilings bottom up: what has no weight can't take anything, and so adds nothing to its family's ceiling.
    caps, below = {}, leaves.withColumn("cap", F.col("tokens") * mix.epochs)
    for depth in (3, 2, 1):
        level = below.withColumn("weight", _weight(weights[LEAF[depth - 1]], LEAF[depth - 1], mix.other))
        caps[depth] = level.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(0))
        below = caps[depth].groupBy(*LEAF[: depth - 1]).agg(F.sum("cap").alias("cap"))
    level = share(caps[1].crossJoin(F.broadcast(total)), [], LEAF[0])  # a single row
    for depth in (2, 3):
        above = level.select(*LEAF[: depth - 1], F.col("quota").alias("budget"))
        level = share(caps[depth].join(above, LEAF[: depth - 1]), LEAF[: depth - 1], LEAF[depth - 1])
    return level.select(*LEAF, "quota", F.expr("quota div tokens").alias("full"), F.expr("quota % tokens").alias("part"))


def _order_key(seed: int) -> Column:
    """60 bits of a hash of seed, epoch and doc_id; without a doc_id, of the text's hash."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("_lf_text").cast("string")))
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_lf_full").cast("string"), own).cast("binary"))
    return F.conv(F.substring(mixed, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def _by_leaf(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows joined to their leaf's line of a plan, whose columns get a prefix, as rows may have columns of any name."""
    plan = plan.withColumnsRenamed({c: f"_lf_{c}" for c in plan.columns if not c.startswith("_lf_")})
    small = plan.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    return rows.join(F.broadcast(plan) if small else plan.hint("merge"), LEAF)


def _keyed(rows: DataFrame, mix: Mixture) -> DataFrame:
    """Rows with their place in the order: hash, doc_id, and the text's hash."""
    return rows.withColumns({"_lf_hash": _order_key(mix.seed), "_lf_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))})


def plan_mixture(docs: DataFrame, mix: Mixture) -> tuple[DataFrame, DataFrame]:
    """The narrow rows (doc_id, leaf, tokens), and one row per leaf: quota, full, and the last (hash, id) of the prefix."""
    rows = staged(_with_leaf(docs, mix).select("doc_id", *LEAF, "_lf_tokens", "_lf_text"), "mix-rows")
    leaves = rows.groupBy(*LEAF).agg(F.sum("_lf_tokens").alias("tokens"))
    plan = staged(leaf_quotas(leaves, mix), "mix-quotas")
    partial = staged(_keyed(_by_leaf(rows, plan.where("part > 0")), mix).select(*LEAF, *ORDER, "_lf_tokens", "_lf_part"), "mix-order")
    inside, edge, level, small = partial.withColumn("base", F.lit(0).cast("bigint")), None, 0, False
    while not small and level < HASH_BITS // LEVEL_BITS:
        level += 1
        binned = inside.withColumn("_lf_bin", F.shiftright("_lf_hash", HASH_BITS - level * LEVEL_BITS))
        bins = binned.groupBy(*LEAF, "_lf_bin").agg(F.sum("_lf_tokens").alias("n"), F.count("*").alias("rows"), F.first("_lf_part").alias("part"), F.first("base").alias("base"))
        upto = F.col("base") + F.sum("n").over(W.partitionBy(*LEAF).orderBy("_lf_bin"))  # at most 64 rows a leaf
        bins = bins.withColumn("upto", upto).withColumn("base", F.col("upto") - F.col("n"))
        edge = staged(bins.where((F.col("base") <= F.col("part")) & (F.col("upto") > F.col("part"))).select(*LEAF, "_lf_bin", "base", "rows"), "mix-edges")
        small = (edge.agg(F.max("rows")).first()[0] or 0) <= BIN_ROWS
        inside = binned.drop("base").join(edge.drop("rows"), [*LEAF, "_lf_bin"])
    # Rows that tie in all three go together, and are added up before they meet.
    tied = inside.groupBy(*LEAF, *ORDER).agg(F.sum("_lf_tokens").alias("_lf_tokens"), F.first("_lf_part").alias("_lf_part"), F.first("base").alias("base"))
    running = F.sum("_lf_tokens").over(W.partitionBy(*LEAF).orderBy(*ORDER))
    last = tied.withColumn("upto", F.col("base") + running).where("upto <= _lf_part").groupBy(*LEAF).agg(F.max(F.struct(*ORDER)).alias("last"))
    cuts = plan.join(edge.drop("base", "rows"), LEAF, "left").join(last, LEAF, "left")
    before = F.shiftleft(F.col("_lf_bin").cast("bigint"), HASH_BITS - level * LEVEL_BITS) - 1
    most = F.lit((1 << 63) - 1)
    return rows, staged(cuts.select(*LEAF, "quota", "full", F.coalesce("last._lf_hash", before, F.lit(-1)).alias("last_hash"), F.coalesce("last._lf_id", most).alias("last_id"), F.coalesce("last._lf_text", most).alias("last_text")), "mix-cuts")


def with_copies(rows: DataFrame, cuts: DataFrame, mix: Mixture) -> DataFrame:
    """Adds _lf_copies, how often a row is in the mixture; rows have LEAF and doc_id."""
    placed = _keyed(_by_leaf(rows, cuts), mix)
    last = F.struct("_lf_last_hash", "_lf_last_id", "_lf_last_text")
    inside = F.struct(*ORDER) <= last
    return placed.withColumn("_lf_copies", F.col("_lf_full") + inside.cast("bigint"))


def mix_documents(docs: DataFrame, mix: Mixture) -> DataFrame:
    """The mixture: each document as often as it was chosen, with its own columns."""
    _, cuts = plan_mixture(docs, mix)
    chosen = with_copies(_with_leaf(docs, mix), cuts, mix).where("_lf_copies > 0")
    return chosen.withColumn("_lf_n", F.explode(F.sequence(F.lit(1).cast("bigint"), "_lf_copies"))).select(*docs.columns)


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = Mixture()
    rows, cuts = plan_mixture(table(spark, sf_dir, "documents"), mix)
    return with_copies(rows, cuts, mix).select("doc_id", F.col("_lf_domain").alias("domain"), F.col("_lf_lang").alias("lang"), F.col("_lf_source").alias("source"), F.col("_lf_tokens").alias("n_tokens"), F.col("_lf_quota").alias("leaf_quota"), F.col("_lf_copies").alias("copies"))


def _share_sql(name: str, nodes: str, family: str, child: str) -> str:
    group = f"PARTITION BY {family}" if family else ""
    keep = f"{family}, {child}" if family else child
    return f"""
        {name}_r AS (SELECT *, CASE WHEN weight > 0 THEN cap::DOUBLE / weight ELSE 'inf'::DOUBLE END AS ratio FROM ({nodes})),
        {name}_o AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before,
            sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS rest FROM {name}_r WINDOW o AS ({group} ORDER BY ratio, {child})),
        {name}_f AS (SELECT *, weight > 0 AND cap::HUGEINT * rest <= weight * (budget::HUGEINT - before) AS filled FROM {name}_o),
        {name}_l AS (SELECT *, budget - coalesce(sum(CASE WHEN filled THEN cap END) OVER ({group}), 0)::HUGEINT AS remaining,
            sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ({group})::HUGEINT AS opened,
            sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ({group} ORDER BY ratio, {child} ROWS UNBOUNDED PRECEDING)::HUGEINT AS upto FROM {name}_f),
        {name} AS (SELECT {keep}, cap, (CASE WHEN filled THEN cap WHEN weight > 0 THEN coalesce(remaining * upto // nullif(opened, 0) - remaining * (upto - weight) // nullif(opened, 0), 0) ELSE 0 END)::BIGINT AS quota FROM {name}_l)"""


_MIX = Mixture()
_CASE = lambda col, names: "CASE " + " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in names.items()) + f" ELSE {_MIX.other} END"
QUERIES: dict[str, Callable] = {"op1_mixture": op1_mixture}
ORACLE_SQL = {
    "op1_mixture": f"""
        WITH docs AS (SELECT doc_id, {_MIX.domain} AS domain, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, strlen(coalesce(text, '')) // 4 + 1 AS n_tokens FROM documents),
        leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * {_MIX.epochs} AS cap FROM docs GROUP BY ALL),
        total AS (SELECT floor(sum(tokens) * {_MIX.percent} / 100)::BIGINT AS budget FROM leaves),
        {_share_sql("d", f"SELECT domain, sum(cap)::BIGINT AS cap, (SELECT budget FROM total) AS budget, {_CASE('domain', _MIX.domains)} AS weight FROM leaves GROUP BY domain", "", "domain")},
        {_share_sql("l", f"SELECT leaves.domain, lang, sum(leaves.cap)::BIGINT AS cap, any_value(d.quota) AS budget, {_CASE('lang', _MIX.langs)} AS weight FROM leaves JOIN d USING (domain) GROUP BY leaves.domain, lang", "domain", "lang")},
        {_share_sql("s", "SELECT leaves.domain, leaves.lang, source, leaves.cap, l.quota AS budget, 1 AS weight FROM leaves JOIN l USING (domain, lang)", "domain, lang", "source")},
        plan AS (SELECT domain, lang, source, quota, quota // tokens AS whole, quota % tokens AS part FROM s JOIN leaves USING (domain, lang, source)),
        keyed AS (SELECT docs.*, quota, whole, part, ('0x' || substr(md5(concat_ws(':', '{_MIX.seed}', whole, doc_id)), 1, 15))::UBIGINT AS h FROM docs JOIN plan USING (domain, lang, source)),
        run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id) AS upto FROM keyed)
        SELECT doc_id, domain, lang, source, n_tokens, quota AS leaf_quota, whole + (CASE WHEN part > 0 AND upto <= part THEN 1 ELSE 0 END) AS copies FROM run""",
}
