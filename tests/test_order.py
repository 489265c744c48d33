import math
import random

import pytest
from pyspark.sql import functions as F

from qanat.operators import order, retrieve


@pytest.fixture(scope="module")
def values():
    rng = random.Random(9)
    odd = [0.0, -0.0, 1.0, -1.0, 5e-324, 1e-323, -5e-324, 1.7e308, -1.7e308, math.inf, -math.inf, math.nan, 2.0**52 + 1, 2.0**52 + 2, 0.1, 0.1 + 2**-56]
    rows = [("odd", x) for x in odd * 3] + [("even", float(i)) for i in range(1, 101)] + [("same", 7.5)] * 40 + [("one", 3.0), ("none", None)]
    rows += [(None, rng.uniform(-1e6, 1e6)) for _ in range(700)] + [("wide", rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300)) for _ in range(700)]
    rows += [("near", 1 + rng.randrange(1 << 40) * 2**-52) for _ in range(700)] + [("near", None)]
    rng.shuffle(rows)
    return rows


def plain(own, q, kind):
    s = sorted(own, key=lambda x: (math.isnan(x), x))
    n = len(s)
    if kind == "lower":
        return s[math.floor(q * (n - 1))]
    if kind == "clipped":
        return s[min(n - 1, math.floor(n * q))]
    a, share = math.floor(q * (n - 1)), q * (n - 1) - math.floor(q * (n - 1))
    low, high = s[a], s[min(n - 1, math.ceil(q * (n - 1)))]
    return low if share == 0 or low == high else low * (1 - share) + high * share


def same(a, b):
    return a == b or math.isnan(a) and math.isnan(b)


def test_order_statistics_equal_sorting(spark, values):
    rows = spark.createDataFrame(values, "g string, x double").repartition(3)
    wanted = {f"{kind}_{int(100 * q)}": (q, kind) for q in (0.0, 0.5, 0.95, 1.0) for kind in ("interpolated", "clipped", "lower")}
    got = {r["g"]: r for r in order.order_statistics(rows, ["g"], "x", {n: getattr(order, kind)(q) for n, (q, kind) in wanted.items()}).collect()}
    groups = {}
    for g, x in values:
        if x is not None:
            groups.setdefault(g, []).append(x)
    assert set(got) == set(groups)
    for g, own in groups.items():
        for name, (q, kind) in wanted.items():
            assert same(got[g][name], plain(own, q, kind)), (g, name)


def test_three_percentiles(spark):
    rows = spark.range(1, 101).select(F.col("id").alias("x"))
    got = order.order_statistics(rows, [], "x", {"a": order.interpolated(0.95), "b": order.clipped(0.95), "c": order.lower(0.95)}).head()
    assert math.isclose(got["a"], 95.05) and (got["b"], got["c"]) == (96, 95)
    assert order.order_statistics(rows.limit(0), [], "x", {"a": order.lower(0.5)}).collect() == []


def test_a_group_of_all_rows_stays_spread(spark):
    """No step sorts a group or holds more than CELLS counts of one."""
    rows = spark.range(200_000).select(F.lit("hot").alias("g"), F.rand(3).alias("x"))
    got = order.order_statistics(rows, ["g"], "x", {"m": order.lower(0.5)}).head()["m"]
    assert got == sorted(r["x"] for r in rows.collect())[99_999]


def test_places_are_gapless_and_keep_tied_rows_whole(spark):
    rng = random.Random(2)
    keys = [rng.choice([5, 5, 5, None, *range(50)]) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, k int").repartition(5)
    numbered, total = order.placed(rows, [F.asc_nulls_first("k")])
    got = sorted((tuple(r) for r in numbered.select("place", "k", "id").collect()))
    assert total == 3000 and [g[0] for g in got] == list(range(3000)) and sorted(g[2] for g in got) == list(range(3000))
    assert [g[1] for g in got] == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert order.placed(rows.limit(0), [F.col("k")])[1] == 0


def test_no_step_of_places_lies_in_one_task(spark):
    numbered, _ = order.placed(spark.range(1000).toDF("k"), [F.col("k")])
    assert "SinglePartition" not in numbered._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("n", "total"), [(7, 40), (40, 7), (1, 5), (5, 5), (3, 0)])
def test_subsets_by_place(spark, n, total):
    rows = spark.range(total).select((F.col("id") * 3).alias("k"))
    assert sorted(r["k"] for r in retrieve.even_subset(rows, "k", n).collect()) == sorted({3 * (i * total // n) for i in range(n) if total})
    assert {r["k"]: r["side"] for r in retrieve.alternate(rows, "k").collect()} == {3 * i: "live" if i % 2 else "reference" for i in range(total)}
    assert sorted(r["k"] for r in retrieve.part_of(rows, "k", 2).collect()) == [3 * i for i in range(2, total)]
    assert sorted(r["k"] for r in retrieve.part_of(rows, "k", 1, 3).collect()) == [3 * i for i in range(1, min(total, 4))]
