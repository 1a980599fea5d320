"""What copies move through shuffles, with the whole results."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from landfold.operators import graph

SMOKE = "/root/testdata/sf0.001"


def shuffled(spark, action):
    """What action returns, with the rows and bytes that its stages wrote to shuffles."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm

    def stages():
        sc.listenerBus().waitUntilEmpty()
        quantiles = spark.sparkContext._gateway.new_array(jvm.double, 0)
        found = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, quantiles, jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): (s.shuffleWriteRecords(), s.shuffleWriteBytes()) for s in (found.apply(k) for k in range(found.size()))}

    before = max(stages(), default=(-1, 0))
    result = action()
    new = [v for k, v in stages().items() if k > before]
    return result, sum(v[0] for v in new), sum(v[1] for v in new)


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """Folders with the orders once and eight times, in copies that have the boxes and projects of the first."""
    out = {}
    for n in (1, 8):
        d = out[n] = tmp_path_factory.mktemp(f"copies{n}")
        for t in Path(SMOKE).iterdir():
            if t.name != "orders.parquet":
                (d / t.name).symlink_to(t)
        orders = spark.read.parquet(f"{SMOKE}/orders.parquet").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        orders = orders.withColumns({"o_orderkey": F.col("o_orderkey") + F.col("_k") * 400_000, "o_custkey": F.col("o_custkey") + F.col("_k") * 400_000}).drop("_k")
        orders.coalesce(1).write.parquet(f"{d}/orders.parquet")
    return out


@pytest.mark.parametrize("name", ["fn32_block_closing", "gr02_growth_blocks"])
def test_blocks_of_copies_move_no_more(spark, copies, name):
    """Eight times the features in the same boxes: the same blocks, from no more shuffled rows."""
    found = {n: shuffled(spark, lambda d=d: queries()[name](spark, str(d)).drop("members").collect()) for n, d in copies.items()}
    assert sorted(map(str, found[1][0])) == sorted(map(str, found[8][0])) and found[1][0]
    assert found[8][1] <= 1.5 * found[1][1]


def test_pairs_of_copies_are_not_shuffled(spark, copies):
    """Pairs grow with the square of the copies, what is shuffled with the copies alone."""
    found = {n: shuffled(spark, lambda d=d: queries()["join03_distance_barrier_pairs"](spark, str(d)).count()) for n, d in copies.items()}
    n = spark.read.parquet(f"{SMOKE}/orders.parquet").count()
    assert found[8][0] == 64 * found[1][0] + 28 * n  # of each old pair 64, and all pairs among a feature's copies
    assert found[8][1] <= 1.5 * 8 * found[1][1]


def test_pairs_of_one_list_move_once(spark):
    """Members of a shape, here from one partition, move once: as a list to the task that writes their pairs out."""
    rng = random.Random(3)
    ids = rng.sample(range(1 << 62), 30_000)
    frame = spark.createDataFrame([(i, 0, 10 * (k % 10), 0, 10 * (k % 10) + 5, 5) for k, i in enumerate(ids)], "id bigint, k int, minx int, miny int, maxx int, maxy int").coalesce(1)
    shapes = graph.alike(frame, "id", ["k"], graph.BOX)
    own = shapes.select(F.col("id").alias("a"), F.col("id").alias("b"))
    rows, _, moved = shuffled(spark, lambda: graph.of_members(own, frame, "id", shapes, ["k", *graph.BOX]).count())
    assert rows == 10 * 3000 * 2999 // 2
    assert moved <= 10 * len(ids)  # of 8 bytes each


def test_members_of_several_lists(spark, monkeypatch):
    """Shapes with many lists, with connectors: each pair once, turned where it is one of unlike shapes."""
    monkeypatch.setattr(graph, "LISTED", 4)
    members = {0: [1, 8, 12, 13, 20, 21, 22, 29, 30, 31, 40], 1: [2, 3, 9, 14, 23, 24], 2: [5], 3: [6, 7]}
    frame = spark.createDataFrame([(i, s, s) for s, of in members.items() for i in of], "id bigint, k int, shape int")
    shapes = graph.alike(frame, "id", ["k"], ["shape"])
    links = [(1, 1), (1, 2), (2, 2), (5, 5), (2, 5), (6, 6)]
    pairs = spark.createDataFrame([(a, b, 10.0 * a, 1.0, 10.0 * b, 2.0) for a, b in links], "a bigint, b bigint, x1 double, y1 double, x2 double, y2 double")
    got = [tuple(r) for r in graph.of_members(pairs, frame, "id", shapes, ["k", "shape"]).select("a", "b", "x1", "y1", "x2", "y2").collect()]
    of = {min(v): v for v in members.values()}
    want = []
    for s, t in links:
        for a in of[s]:
            for b in of[t]:
                if s == t and a < b or s != t:
                    ends = (10.0 * s, 1.0, 10.0 * t, 2.0)
                    want.append((a, b, *ends) if a < b else (b, a, *ends[2:], *ends[:2]))
    assert sorted(got) == sorted(want)


def exploded(df):
    """Rows that the explodes of a frame's last stage gave."""

    def rows(plan):
        kind = plan.getClass().getSimpleName()
        if kind in ("AdaptiveSparkPlanExec", "ResultQueryStageExec"):
            return rows(plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan())
        own = plan.metrics().apply("numOutputRows").value() if kind == "GenerateExec" else 0
        below = plan.children()
        return own + sum(rows(below.apply(k)) for k in range(below.size()))

    return rows(df._jdf.queryExecution().executedPlan())


def test_pairs_come_by_pieces_of_lists(spark):
    """A list's pairs aren't all held before the first of them goes on."""
    frame = spark.range(3000).select("id", F.lit(1).alias("k"), F.lit("x").alias("shape"))
    shapes = graph.alike(frame, "id", ["k"], ["shape"])
    own = shapes.select(F.col("id").alias("a"), F.col("id").alias("b"))
    pairs = graph.of_members(own, frame, "id", shapes, ["k", "shape"])
    first = pairs.limit(1)
    assert len(first.collect()) == 1 and 0 < exploded(first) <= 3 * 64 * 64
    whole = pairs.agg(F.count("*"), F.countDistinct("a", "b"), F.min(F.col("b") - F.col("a"))).first()
    assert tuple(whole) == (3000 * 2999 // 2, 3000 * 2999 // 2, 1)


def test_distances_of_polygons_are_compiled_and_rounded_once(spark):
    """No method of a stage is longer than the JVM compiles (8,000 bytes), and nothing is rounded for each pair of copies."""
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        frame = spark.createDataFrame([(k, 1, [[{"x": 9.0 * k, "y": 0.0}, {"x": 9.0 * k + 3, "y": 1.0}, {"x": 9.0 * k, "y": 5.0}]]) for k in range(5)], "id bigint, k int, rings array<array<struct<x: double, y: double>>>")
        links = graph.ring_links(graph.alike(frame, "id", ["k"], ["rings"]), "id", ["k"], 10)
        assert sorted((r.a, r.b, r.distance) for r in links.collect()) == [(k, k + 1, 6.0) for k in range(4)]
        code = links._jdf.queryExecution().debug().codegenToSeq()
        lengths = [code.apply(k)._3().maxMethodCodeSize() for k in range(code.size())]
        assert lengths and max(lengths) <= 8000
    finally:
        spark.conf.set(name, before)
    found = queries()["join03_polygon_distance"](spark, SMOKE)
    assert "round(" not in found._jdf.queryExecution().optimizedPlan().toString()
