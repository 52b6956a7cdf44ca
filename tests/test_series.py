"""Time-series features and anomalies against pandas, with blocks far smaller than the entities."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from brindle.operators import anomaly as A
from brindle.operators import registry as G
from brindle.operators import series as S


def frame(spark, entities=("hot", "cold", None), sizes=(700, 40, 25), holes=0.5):
    rng = np.random.default_rng(7)
    rows = []
    for e, n in zip(entities, sizes):
        for i in range(n):
            v = None if rng.random() < holes else float(rng.normal(100, 10))
            rows.append((e, f"2024-01-01 00:00:{i % 60:02d}" if e == "tie" else str(pd.Timestamp("2023-01-01") + pd.Timedelta(hours=i * 7)), i, v))
    df = spark.createDataFrame(rows, "e string, t string, i int, v double").withColumn("t", F.col("t").cast("timestamp"))
    pdf = pd.DataFrame(rows, columns=["e", "t", "i", "v"])
    return df.repartition(6), pdf


def close(got, expected):
    got, expected = np.array(got, dtype=float), np.array(expected, dtype=float)
    assert np.allclose(got, expected, equal_nan=True)


def by_entity(out, column):
    rows = out.select("e", "i", column).toPandas().sort_values("i")
    return {k if isinstance(k, str) else None: g[column].tolist() for k, g in rows.groupby("e", dropna=False)}


def test_positions_lags_and_rolling(spark):
    df, pdf = frame(spark, holes=0.2)
    lags = S.lag_features(df, ["e"], "t", "v", block=40)
    rolled = S.rolling_features(df, ["e"], "t", "v", block=40)
    for e, g in pdf.groupby("e", dropna=False):
        e, v = (e if isinstance(e, str) else None), g["v"].astype(float)
        assert by_entity(lags, "pos")[e] == list(range(len(v)))
        for k in (1, 7, 30):
            close(by_entity(lags, f"lag_{k}")[e], v.shift(k))
        close(by_entity(rolled, "rolling_mean_30")[e], v.rolling(30, min_periods=1).mean())
        close(by_entity(rolled, "rolling_std_7")[e], v.rolling(7, min_periods=1).std())


def test_pct_change_over_long_gaps(spark):
    df, pdf = frame(spark, holes=0.9)
    out = S.pct_change(df, ["e"], "t", "v", block=5)
    for e, g in pdf.groupby("e", dropna=False):
        e, v = (e if isinstance(e, str) else None), g["v"].astype(float).ffill()
        close(by_entity(out, "pct_change")[e], v / v.shift(1) - 1)


def test_trend_directions(spark):
    series = {
        "up": [100.0 + 5 * i for i in range(20)], "down": [100.0 - 3 * i for i in range(20)], "flat": [7.0] * 20,
        "wild": [1.0, 100.0] * 10, "four": [1.0, 2.0, 3.0, 4.0], "five": [1.0, 2.0, 3.0, 4.0, 5.0], "one": [1.0], "zero": [0.0] * 6,
    }
    rows = [(e, i, v) for e, vs in series.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "e string, i int, v double").withColumn("t", F.expr("date_add(date'2024-01-01', i)"))
    fit = {r["e"]: r for r in S.trend_summary(S.trend_fit(df, ["e"], "t", "v")).collect()}
    expected = {"up": "increasing", "down": "decreasing", "flat": "stable", "wild": "volatile", "four": "unknown", "five": "increasing",
                "one": "unknown", "zero": "stable"}
    assert {e: r["direction"] for e, r in fit.items()} == expected
    assert abs(fit["up"]["slope"] - 5) < 1e-9 and abs(fit["up"]["r2"] - 1) < 1e-9
    assert fit["four"]["summary"].startswith("Insufficient data")


def test_change_points(spark):
    values = [10.0, 11.0, 10.0, 11.0, 10.0, 11.0, 10.0, 50.0, 10.0, 11.0, 10.0, 11.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "e string, i int, v double")
    df = df.withColumn("t", F.expr("date_add(date'2024-01-01', i)"))
    assert [r["pos"] for r in S.change_points(df, ["e"], "t", "v").collect()] == [7]
    assert S.change_points(df, ["e"], "t", "v", exclude_current=False).count() == 0
    assert S.change_points(df.filter("i < 9"), ["e"], "t", "v").count() == 0


def test_zscore_keeps_the_first_column_and_skips_constants(spark):
    rows = [(i, 1.0, float(i % 5), float(i % 3)) for i in range(200)] + [(200, 1.0, 500.0, 900.0), (201, 1.0, 2.0, 900.0)]
    df = spark.createDataFrame(rows, "id int, c double, a double, b double")
    hits = {r["id"]: r["column"] for r in A.anomaly_zscore(df, ["id"], ["c", "a", "b"]).collect()}
    assert hits == {200: "a", 201: "b"}


def test_forest_finds_planted_outliers(spark):
    rng = np.random.default_rng(11)
    rows = [(i, *map(float, rng.normal(0, 1, 3))) for i in range(2000)]
    rows += [(2000 + i, *map(float, rng.normal(0, 1, 3) + 12)) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double").repartition(4)
    scored = A.forest_scores(df, ["id"], ["a", "b", "c"])
    found = scored.filter("anomaly")
    assert abs(found.count() / 2040 - 0.1) < 0.01
    assert found.filter("id >= 2000").count() == 40
    again = A.forest_scores(df.repartition(7), ["id"], ["a", "b", "c"])
    gap = scored.alias("x").join(again.alias("y"), "id").agg(F.max(F.abs(F.col("x.score") - F.col("y.score")))).first()[0]
    assert gap < 1e-9


def test_forest_on_few_rows(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(30)], "id int, a double")
    assert A.forest_scores(df, ["id"], ["a"]).count() == 30


def test_registry(spark):
    def candidate(std, when):
        return spark.createDataFrame([({"std_score": std}, "abc", "", when)], "metrics map<string,double>, training_data_hash string, model_path string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))

    r = G.empty_registry(spark)
    for std, when in ((0.10, "2024-01-01"), (0.104, "2024-02-01"), (0.2, "2024-03-01")):
        r = G.register(r, candidate(std, when))
    state = [(x["version"], x["is_active"]) for x in r.orderBy("created_at").collect()]
    assert state == [("v1_abc", False), ("v2_abc", False), ("v3_abc", True)]
    back = {x["version"]: x["is_active"] for x in G.rollback(r, "v1_abc").collect()}
    assert back == {"v1_abc": True, "v2_abc": False, "v3_abc": False}
    same = {x["version"]: x["is_active"] for x in G.rollback(r, "v9").collect()}
    assert same["v3_abc"]
