"""Operators against plain Python on small random tables, with a group that holds most rows."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from snapline.operators import joins, ordering, quantiles, reshape, topn


@pytest.fixture(scope="module")
def plays(spark):
    random.seed(3)
    data = []
    for i in range(1200):
        key = "hot" if i % 3 else random.choice(["a", "b", None])
        value = None if i % 17 == 0 else round(random.uniform(-5, 5), 3)
        data.append((key, random.randrange(3), i, value))
    return spark.createDataFrame(data, "k string, s int, id int, v double"), data


def groups(data):
    out = {}
    for row in data:
        out.setdefault(row[0], []).append(row)
    return {k: sorted(g, key=lambda r: (-r[1], -r[2])) for k, g in out.items()}


def numbered(df):
    df = df.withColumn("c", F.floor(F.col("id") / 64))
    return ordering.positions(
        df, ["k"], ordering.desc_last("s", "id"), ["s", "c"], ordering.desc_last("s", "c"), "pos"
    )


def test_positions_in_chunks(plays):
    df, data = plays
    got = {(r.k, r.id): r.pos for r in numbered(df).collect()}
    want = {(k, r[2]): i + 1 for k, g in groups(data).items() for i, r in enumerate(g)}
    assert got == want


def test_running_total_in_chunks(plays):
    df, data = plays
    df = df.withColumn("one", F.lit(2)).withColumn("c", F.floor(F.col("id") / 100))
    out = ordering.running_total(
        df, ["k"], ordering.desc_last("s", "id"), ["s", "c"], ordering.desc_last("s", "c"), "one", "t"
    )
    got = {(r.k, r.id): r.t for r in out.collect()}
    want = {(k, r[2]): 2 * (i + 1) for k, g in groups(data).items() for i, r in enumerate(g)}
    assert got == want


@pytest.mark.parametrize("width, frame", [(5, (-2, 2)), (10, (-4, 5)), (25, (-12, 12)), (50, (-24, 25))])
def test_frames(width, frame):
    assert ordering.centered_frame(width) == frame


def test_rolling_mean_across_blocks(plays):
    df, data = plays
    widths = {"w5": 5, "w10": 10, "w25": 25, "w50": 50}
    out = ordering.rolling_mean(numbered(df), ["k"], "v", widths, "pos", block=40)
    got = {(r.k, r.id): r for r in out.collect()}
    assert len(got) == len(data) == out.count()
    for k, g in groups(data).items():
        for i, r in enumerate(g):
            for name, w in widths.items():
                lo, hi = ordering.centered_frame(w)
                seen = [x[3] for x in g[max(0, i + lo): i + hi + 1] if x[3] is not None]
                want = statistics.fmean(seen) if seen else None
                have = got[k, r[2]][name]
                assert have is None and want is None or have == pytest.approx(want, abs=1e-9)


def test_rolling_mean_rejects_a_short_block(plays):
    with pytest.raises(ValueError):
        ordering.rolling_mean(numbered(plays[0]), ["k"], "v", {"w": 50}, "pos", block=20)


def test_name_codes(spark, rows):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "name string")
    assert rows(ordering.name_codes(df, "name", "code")) == [("a", 1), ("a", 1), ("b", 2), ("c", 3), (None, None)]


@pytest.mark.parametrize("head", ["the same beginning of every name ", ""])
def test_name_codes_of_many_names(spark, head):
    names = [f"{head}{i * 7919 % 5000:05d}"[::1 if head else -1] for i in range(5000)]
    df = spark.createDataFrame([(n,) for n in [*names, *names[:50]]], "name string").repartition(7)
    codes = ordering.name_codes(df, "name", "code")
    assert {r["name"]: r["code"] for r in codes.collect()} == {n: i for i, n in enumerate(sorted(names), 1)}
    assert "Window" not in codes._jdf.queryExecution().executedPlan().toString()


def test_sorted_positions_with_one_large_group(spark):
    random.seed(6)
    data = [("hot" if i % 5 else random.choice(["a", None]), random.choice([None, 1.0, 2.0, random.random()]), f"n{i:05d}") for i in range(4000)]
    df = spark.createDataFrame(data, "k string, x double, n string").repartition(5)
    got = {r["n"]: r["pos"] for r in ordering.sorted_positions(df, ["k"], [F.col("x").asc_nulls_last(), F.col("n").asc()], "pos").collect()}
    for k in ("hot", "a", None):
        line = sorted((r for r in data if r[0] == k), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in line] == list(range(1, len(line) + 1))
    assert ordering.sorted_positions(df.limit(0), ["k"], [F.col("n").asc()], "pos").collect() == []


def test_natural_join_matches_null_keys(spark, rows):
    a = spark.createDataFrame([(1, None), (2, "x")], "k int, t string")
    b = spark.createDataFrame([(None, 10), ("x", 20), ("y", 30)], "t string, w int")
    assert rows(joins.natural_join(a, b), "k", "t", "w") == [(1, None, 10), (2, "x", 20)]
    assert rows(joins.natural_join(a, b, "full"), "k", "t", "w") == [(1, None, 10), (2, "x", 20), (None, "y", 30)]
    assert rows(joins.natural_join(a, b, "right"), "k", "t", "w") == [(1, None, 10), (2, "x", 20), (None, "y", 30)]
    with pytest.raises(ValueError):
        joins.natural_join(a, b.select("w"))


def test_natural_join_suffixes(spark):
    a = spark.createDataFrame([(1, 2)], "k int, v int")
    assert joins.natural_join(a, a, keys=["k"]).columns == ["k", "v.x", "v.y"]


def test_natural_join_stays_an_equi_join(spark):
    a = spark.range(10).selectExpr("id as k", "id as v")
    b = spark.range(10).selectExpr("id as k", "id as w")
    plan = joins.natural_join(a.hint("merge"), b)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "NestedLoop" not in plan


def test_salted_join_keeps_every_row(plays, spark):
    df, data = plays
    small = spark.createDataFrame([("hot", 1), ("a", 2), (None, 3)], "k string, w int")
    for how, keep in (("left", data), ("inner", [r for r in data if r[0] != "b"])):
        got = sorted((r.id, r.w) for r in joins.salted_join(df, small, ["k"], ["id"], how, salts=5).collect() if r.w is not None)
        want = sorted((r[2], {"hot": 1, "a": 2, None: 3}[r[0]]) for r in data if r[0] != "b")
        assert got == want
        assert joins.salted_join(df, small, ["k"], ["id"], how, salts=5).count() == len(keep)
    with pytest.raises(ValueError):
        joins.salted_join(df, small, ["k"], ["id"], "full")


def test_left_join_to_a_heavy_detail(plays, spark, rows):
    df, data = plays
    left = spark.createDataFrame([("hot", 1), ("a", 2), (None, 3), ("nobody", 4), ("nobody", 4)], "k string, w int")
    got = rows(joins.left_join_detail(left, df, ["k"]), "k", "w", "id")
    want = rows(joins.natural_join(left, df, "left", ["k"]), "k", "w", "id")
    assert got == want and len(got) > 800
    plan = joins.left_join_detail(left, df, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Union" not in plan
    assert joins.heavy_keys(df, ["k"], 0.4) == [("hot",)]


def test_left_join_detail_without_heavy_keys(spark, rows):
    df = spark.createDataFrame([(i % 100, i) for i in range(300)], "k int, id int")
    left = spark.createDataFrame([(5, "a"), (500, "b"), (None, "c")], "k int, w string")
    got = joins.left_join_detail(left, df, ["k"])
    assert rows(got, "k", "w", "id") == rows(joins.natural_join(left, df, "left", ["k"]), "k", "w", "id")
    # Keys that are not heavy are not copied.
    assert "sequence" not in got._jdf.queryExecution().optimizedPlan().toString() or joins.heavy_keys(df, ["k"])
    nothing = joins.left_join_detail(left, df.limit(0), ["k"])
    assert nothing.count() == 3


def test_best_first_with_many_equal_scores(spark):
    random.seed(4)
    data = [(g, random.choice([-2.0, -2.0, None, 1.25, round(random.uniform(-2, 9), 2)]), f"n{i:04d}") for g in "gh" for i in range(200)]
    df = spark.createDataFrame(data, "g string, x double, n string")
    got = {(r.g, r.n): r.pos for r in ordering.best_first(df, ["g"], "x", ["n"], "pos", prefix=3).collect()}
    for g in "gh":
        line = sorted((r for r in data if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        assert [got[g, r[2]] for r in line] == list(range(1, 201))


def test_top_n_keeps_ties_and_drops_null(spark, rows):
    df = spark.createDataFrame(
        [("a", 3), ("a", 3), ("a", 1), ("a", None), ("b", 2), ("b", 1)], "g string, w int"
    )
    assert rows(topn.top_n(df, 1, "w", ["g"])) == [("a", 3), ("a", 3), ("b", 2)]
    assert rows(topn.top_n(df, 3, "w")) == [("a", 3), ("a", 3), ("b", 2)]
    assert rows(topn.last_rows(df, "w", ["g"])) == [("a", 3), ("a", 3), ("b", 2)]


def test_top_n_cuts_before_the_shuffle(spark, rows):
    df = spark.range(10_000).selectExpr("id % 3 as g", "id as w")
    assert "WindowGroupLimit" in topn.top_n(df, 2, "w", ["g"])._jdf.queryExecution().executedPlan().toString()
    for k in (2, 2000):
        plan = topn.top_n(df, k, "w")._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject" in plan and "Window" not in plan
    # All rows tied: they are filtered where they are.
    tied = topn.top_n(spark.range(50).selectExpr("id", "1.0 as w"), 3, "w")
    assert tied.count() == 50
    assert rows(topn.top_n(spark.createDataFrame([(1, None), (2, None)], "a int, w double"), 1, "w")) == []


@pytest.mark.parametrize("cell", [0.25, 3.0, 1000.0])
def test_quantiles_equal_percentile(plays, cell):
    df, _ = plays
    probs = {"a": 0.025, "b": 0.2, "c": 0.5, "d": 0.975, "lo": 0.0, "hi": 1.0}
    got = {r.k: r for r in quantiles.grouped_quantiles(df, ["k"], "v", probs, cell).collect()}
    want = {
        r.k: r
        for r in df.groupBy("k").agg(F.count("v").alias("n"), *[F.percentile("v", p).alias(n) for n, p in probs.items()]).collect()
    }
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert got[k].n == r.n
        for n in probs:
            assert got[k][n] == pytest.approx(r[n], abs=1e-9)


def test_density_integrates_to_one_and_takes_flat_groups(spark):
    random.seed(1)
    data = [("n", random.gauss(0, 1)) for _ in range(3000)] + [("flat", 2.0)] * 5
    df = spark.createDataFrame(data, "g string, x double")
    out = quantiles.density_curve(df, ["g"], "x", 0.01, points=128).collect()
    curve = sorted((r.x, r.density) for r in out if r.g == "n")
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(curve, curve[1:]))
    assert area == pytest.approx(1, abs=0.02)
    peak = max(d for _, d in curve)
    assert peak == pytest.approx(0.3989, abs=0.04)
    assert all(r.n == 5 for r in out if r.g == "flat")



def test_reshape(spark, rows):
    df = spark.createDataFrame([(1, "a", None, "c")], "number int, qb string, RB_1 string, te string")
    long = reshape.wide_to_long(df, ["qb", "rb_", "te"], "slot", "label")
    assert rows(long) == [(1, "RB_1", None), (1, "qb", "a"), (1, "te", "c")]
    nested = reshape.nest_rows(long, ["number"], ["slot", "label"], "data")
    assert nested.count() == 1 and rows(reshape.unnest_rows(nested, "data")) == rows(long)
    assert rows(reshape.with_keys(df.select("number"), "slate", 3)) == [(1, 1), (1, 2), (1, 3)]


def test_detail_with_group_means(spark, rows):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", None), ("b", "z", 4.0)], "g string, n string, v double")
    out = reshape.with_group_means(df, "g", ["n"], ["v"])
    assert rows(out) == [
        ("detail", "a", "x", 1.0), ("detail", "a", "y", None), ("detail", "b", "z", 4.0),
        ("mean", "a", None, 1.0), ("mean", "b", None, 4.0),
    ]


def test_checkpoint_folder_comes_from_the_session(spark, tmp_path):
    from snapline.session import cut_lineage, parallelism

    before = spark.range(5).selectExpr("id * 2 as x")
    after = cut_lineage(before)
    assert sorted(r.x for r in after.collect()) == [0, 2, 4, 6, 8]
    assert "Range" not in after._jdf.queryExecution().optimizedPlan().toString()
    assert parallelism(spark) >= 4


def test_detail_is_shuffled_once_for_an_ordering(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(1000).selectExpr("nullif(id % 7, 3) as g", "cast(id % 5 as string) as c", "id")
        numbered = ordering.positions(df, ["g"], [F.col("id")], ["c"], [F.col("c")], "n")
        plan = numbered._jdf.queryExecution().executedPlan().toString()
        # One exchange of the detail; the others carry one row per group, chunk and task.
        detail = [x for x in plan.split("\n") if "Exchange" in x]
        assert len(detail) <= 4 and plan.count("+- Window") + plan.count("- Window") <= 4
        assert numbered.selectExpr("count(*)", "max(n)").first()[0] == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_binned_density_is_close_to_the_kernel_sum(spark):
    draw = random.Random(12)
    values = [round(draw.gauss(0, 3), 2) for _ in range(400)] + [1.0] * 60
    df = spark.createDataFrame([("a", v) for v in values], "g string, x double")
    rows_ = quantiles.density_curve(df, ["g"], "x", 0.01).collect()
    q = statistics.quantiles(values, n=4, method="inclusive")
    band = 0.9 * min(statistics.stdev(values), (q[2] - q[0]) / 1.34) * len(values) ** -0.2
    bound = 0.25 * (max(values) - min(values)) / 256 / band**2
    for r in rows_:
        exact = sum(math.exp(-0.5 * ((r.x - v) / band) ** 2) for v in values) / (len(values) * band * math.sqrt(2 * math.pi))
        assert abs(r.density - exact) <= bound
    assert len(rows_) == 64


@pytest.mark.parametrize("k", [1500, 2000])
def test_top_of_groups_beyond_the_group_limit(spark, k):
    random.seed(k)
    data = [("hot" if i % 4 else random.choice(["a", None]), random.choice([None, round(random.gauss(0, 1e6), 1), float(random.randrange(40)), 1e-9 * i]), i) for i in range(9000)]
    df = spark.createDataFrame(data, "g string, x double, id long").repartition(6)
    got = sorted(r["id"] for r in topn.top_n(df, k, "x", ["g"]).collect())
    want = []
    for g in ("hot", "a", None):
        line = sorted((r[1] for r in data if r[0] == g and r[1] is not None), reverse=True)
        kth = line[min(k, len(line)) - 1]
        want += [r[2] for r in data if r[0] == g and r[1] is not None and r[1] >= kth]
    assert got == sorted(want) and len(want) >= k
    plan = topn.top_n(df, k, "x", ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
