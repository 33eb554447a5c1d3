"""Halos, places and thinning by blocks against windows over whole histories."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import halo, ranks, series


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    out = [(1, start + timedelta(minutes=rng.randrange(60 * 24 * 12)), k) for k in range(1_500)]  # a hot entity
    out += [(2, start + timedelta(days=3 * k), 10_000 + k) for k in range(8)]  # blocks of one row each
    out += [(3, start, 20_000 + k) for k in range(5)] + [(4, start + timedelta(hours=23, minutes=59), 30_000), (4, start + timedelta(days=1), 30_001)]
    return spark.createDataFrame([(e, t, k, float(k % 97)) for e, t, k in out], "e long, ts timestamp_ntz, id long, v double")


@pytest.mark.parametrize("unit", ["day", "hour"])
def test_halo_gives_the_windows_of_the_whole(rows, unit):
    got = halo.inside(series.sliding_median_mad(halo.with_rows_before(rows, ["e"], "ts", "id", 6, unit), ["e", halo.BLOCK], ["ts", "id"], "v", 7))
    want = series.sliding_median_mad(rows, ["e"], ["ts", "id"], "v", 7)
    key = lambda df: sorted((r["id"], r["win_median"], r["win_mad"]) for r in df.collect())
    assert [x for x in key(got) if x[1] is not None] == [x for x in key(want) if x[1] is not None]
    most = halo.with_rows_before(rows, ["e"], "ts", "id", 6, unit).groupBy("e", halo.BLOCK).count().agg(F.max("count")).first()[0]
    assert most < 200  # of 1,500 rows of one entity


@pytest.mark.parametrize("unit", ["day", "hour"])
def test_episodes_and_spans_by_block(rows, unit):
    keyed = lambda df: sorted((r["id"], r["episode"]) for r in df.collect())
    assert keyed(halo.sessionized(rows, ["e"], "ts", "id", 1_800, unit=unit)) == keyed(series.sessionize(rows, ["e"], "ts", "id", 1_800))
    assert sorted(map(tuple, halo.most_in_span(rows, ["e"], "ts", 7_200, unit=unit).collect())) == sorted(map(tuple, series.most_in_span(rows, ["e"], "ts", 7_200).collect()))


def test_points_between(spark, rows):
    spans = rows.groupBy("e").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).withColumn("span", F.col("e") * 10)
    more = spans.select("e", F.col("lo").alias("lo"), F.col("lo").alias("hi"), (F.col("span") + 1).alias("span"))
    both = spans.select("e", "lo", "hi", "span").union(more).union(spark.createDataFrame([(9, datetime(2024, 1, 1), datetime(2024, 2, 1), 90)], "e long, lo timestamp_ntz, hi timestamp_ntz, span long"))
    want = {r["span"]: r["n"] for r in both.join(rows, "e", "left").groupBy("span").agg(F.count_if((F.col("ts") >= F.col("lo")) & (F.col("ts") <= F.col("hi"))).alias("n")).collect()}
    assert {r["span"]: r["n"] for r in ranks.points_between(both, rows, ["e"], "span", "lo", "hi", "ts").collect()} == want


def test_quantiles_of_few_groups(spark):
    rng = np.random.default_rng(2)
    data = {"a": rng.integers(0, 50, 5_000).astype(float).tolist(), "b": rng.normal(size=2_001).tolist(), None: [3.0], "c": [1.0, 2.0]}
    df = spark.createDataFrame([(k, v) for k, x in data.items() for v in x] + [("d", None), ("a", None)], "k string, v double").withColumn("n_of", F.lit(1))
    got = {r["k"]: r for r in ranks.quantiles(df, ["k"], "v", {"q0": 0.0, "q1": 0.1, "q5": 0.5, "q9": 0.99, "q10": 1.0}, parts=16).collect()}
    assert set(got) == set(data)
    for k, x in data.items():
        assert got[k]["n"] == len(x)
        assert [got[k][c] for c in ("q0", "q1", "q5", "q9", "q10")] == pytest.approx(np.quantile(x, [0, 0.1, 0.5, 0.99, 1]).tolist())


def test_pages_cover_everything(spark, rows):
    order = [F.desc("v"), "id"]
    w = Window.orderBy(*order)
    want = [r["id"] for r in rows.withColumn("n", F.row_number().over(w)).orderBy("n").collect()]
    got = []
    for number in (1, 2, 3):
        page, about = ranks.page(rows, order, number, 600, {"early": F.col("id") < 1_500}, parts=7)
        got += [(r["place"], r["id"]) for r in page.orderBy("place").collect()]
        assert tuple(about.first()) == (len(want), 1_500)
    assert got == list(enumerate(want, 1))
    assert ranks.page(rows, order, 9, 600)[0].count() == 0
    assert ranks.page(rows.limit(0), order, 1, 10)[0].count() == 0
