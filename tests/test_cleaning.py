"""Names, types, roles, imputation and quantiles on literal frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import predicates as P
from brindle.operators import models as M
from brindle.operators import schema as S
from brindle.operators.quantiles import exact_quantiles
from brindle.plans.spec import QuerySpec, alias_columns, listing_columns, resolve_term, run_spec


@pytest.mark.parametrize("good, fraction, expected", [
    (79, False, "STRING"), (80, False, "STRING"), (81, False, "DOUBLE"), (100, False, "BIGINT"), (100, True, "DOUBLE"),
])
def test_numeric_share(spark, good, fraction, expected):
    rows = [(i, f"{i}.5" if fraction else str(i)) if i < good else (i, "x") for i in range(100)]
    df = spark.createDataFrame(rows, "i int, v string")
    assert S.type_map(S.infer_types(df, "i"))["v"] == expected


def test_all_values_decide_unless_a_sample_is_asked_for(spark):
    rows = [(i, str(i)) for i in range(100)] + [(i, "x") for i in range(100, 500)]
    df = spark.createDataFrame(rows, "i int, v string").repartition(7)
    assert S.type_map(S.infer_types(df))["v"] == "STRING"
    assert S.type_map(S.infer_types(df, "i", sample=100))["v"] == "BIGINT"
    late = spark.createDataFrame([(i, str(i)) for i in range(150)] + [(150, "150.75")], "i int, v string")
    assert S.type_map(S.infer_types(late))["v"] == "DOUBLE" and "Sort" not in S.infer_types(late)._jdf.queryExecution().toString()
    keys = spark.createDataFrame([("9007199254740993",), ("7.9",), ("x",)], "v string")
    assert [r["v"] for r in S.coerce_values(keys, {"v": "BIGINT"}).collect()] == [9007199254740993, 7, None]


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], ["Count", "a b", "a-b", "a.b", " Plain "])
    once = S.normalize_columns(df)
    assert once.columns == ["col_count", "a_b", "a_b_2", "a_b_3", "plain"]
    assert S.normalize_columns(once).columns == once.columns


def test_coercion(spark):
    df = spark.createDataFrame([("1.7",), ("-1.7",), ("x",), ("nan",), (None,), ("1e30",)], "v string")
    whole = [r[0] for r in df.select(S.coerce(F.col("v"), "BIGINT")).collect()]
    assert whole == [1, -1, None, None, None, None]
    assert [r[0] for r in df.select(S.coerce(F.col("v"), "DOUBLE")).collect()] == [1.7, -1.7, None, None, None, 1e30]


@pytest.mark.parametrize("values, fails", [(["a"], True), (["yes", "no"], False), (["a", "b", "c"], True)])
def test_binary_target_needs_two_values(spark, values, fails):
    df = spark.createDataFrame([(v,) for v in values], "y string")
    if fails:
        with pytest.raises(ValueError):
            M.binary_target(df, "y")
    else:
        assert sorted(r["label"] for r in M.binary_target(df, "y").collect()) == [0, 1]


def test_numeric_and_text_flags(spark):
    df = spark.createDataFrame([("Yes", 1), ("no", 0), (None, None), ("CHURNED", 2)], "s string, n int")
    assert [tuple(r) for r in df.select(P.target_flag(df, "s"), P.target_flag(df, "n")).collect()] == [
        (True, True), (False, False), (False, False), (True, False)
    ]


def test_safe_predicate_refuses(spark):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    assert P.safe_predicate(df, "missing", "=", 1) is None
    assert P.safe_predicate(df, "n", "BETWEEN", 1) is None
    assert P.safe_predicate(df, "n", "IN", 1) is None
    assert df.filter(P.safe_predicate(df, "s", "=", "a' OR '1'='1")).count() == 0


def test_impute(spark):
    rows = [("1", "b"), ("3", "a"), (None, None), ("x", "b"), ("2", "a"), (None, "c")]
    df = spark.createDataFrame(rows, "n string, c string")
    out = S.impute(df, ["n"], (), ["c"])
    assert sorted((r["n"], r["c"]) for r in out.collect()) == [(1.0, "b"), (2.0, "a"), (2.0, "b"), (2.0, "c"), (3.0, "a")]


@pytest.mark.parametrize("kind", ["uniform", "heavy", "skewed"])
def test_quantiles_narrow_to_the_exact_value(spark, kind):
    rng = np.random.default_rng(1)
    values = {
        "uniform": rng.random(30_000), "heavy": np.where(rng.random(30_000) < 0.4, 5.0, rng.normal(5, 1, 30_000)),
        "skewed": rng.lognormal(0, 4, 30_000),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    found = exact_quantiles(df, ["v"], probs, small=200)["v"]
    assert np.allclose(found, np.quantile(values, probs), rtol=1e-12, atol=0)


def test_terms():
    columns = ["customer_id", "gender", "tenure_months", "monthly_charges", "total_charges", "churn_label"]
    assert resolve_term(columns, "Gender") == "gender"
    assert resolve_term(columns, "total charges") == "total_charges"
    assert alias_columns(columns)["tenure"] == "tenure_months"
    assert resolve_term(columns, "nothing like it") is None


def test_spec_needs_a_column(spark):
    df = spark.createDataFrame([(1,)], "n int")
    with pytest.raises(ValueError):
        run_spec(df, QuerySpec(agg="AVG"))
    assert listing_columns(df) == ["n"]


def test_split_is_exact_and_repeatable(spark):
    df = spark.range(5003).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    first = M.split_stratified(df, ["id"], "y")
    counts = {(r["y"], r["is_train"]): r["count"] for r in first.groupBy("y", "is_train").count().collect()}
    assert counts == {(0, True): 3602, (0, False): 900, (1, True): 401, (1, False): 100}
    again = M.split_stratified(df.repartition(13), ["id"], "y")
    assert first.exceptAll(again).isEmpty()


def test_auc_with_ties(spark):
    rng = np.random.default_rng(3)
    score, label = rng.integers(0, 40, 2000) / 40, rng.integers(0, 2, 2000)
    df = spark.createDataFrame([(float(s), int(y)) for s, y in zip(score, label)], "s double, y int")
    gaps = score[label == 1][:, None] - score[label == 0][None, :]
    expected = ((gaps > 0) + 0.5 * (gaps == 0)).mean()
    assert abs(M.auc(df, "y", "s").first()[0] - expected) < 1e-12
    assert M.auc(df.filter("y = 1"), "y", "s").first()[0] == 0.5


def test_unseen_category_gets_zero(spark):
    train = spark.createDataFrame([("b",), ("c",), (None,)], "c string")
    tables = {"c": M.label_table(train, "c")}
    new = spark.createDataFrame([("c",), ("zzz",), (None,)], "c string")
    coded = {r["c"]: r["c_encoded"] for r in M.encode_labels(new, ["c"], tables).collect()}
    assert coded == {"c": 2, "zzz": 0, None: 0}


def test_a_look_at_the_first_letters_decides_as_a_cast_does(spark):
    import random

    rnd = random.Random(6)
    texts = ["".join(rnd.choices("0123456789+-.eE: \t\x00naifNIyTdD/x", k=rnd.randrange(0, 9))) for _ in range(4000)]
    texts += ["nan", "NaN", "inf", "-Infinity", "+inf", "Infinity", "1e-5", "123e-5", "1234-5", "2024-01-05", "12:30", "0x1p-3", "1d", ".5", "5.", "-", "", " 7 ", "\t7", "٣", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.trim("t").try_cast("double")
    assert df.filter(~S.number_of(F.col("t")).eqNullSafe(plain)).collect() == []
    whole = F.coalesce(F.trim("t").try_cast("bigint"), F.when(~F.isnan(plain), plain).try_cast("bigint"))
    assert df.filter(~S.coerce(F.col("t"), "BIGINT").eqNullSafe(whole)).collect() == []
    assert df.filter(~S.coerce(F.col("t"), "DOUBLE").eqNullSafe(F.when(~F.isnan(plain), plain))).collect() == []


def test_kinds_of_typed_columns_need_no_texts(spark):
    rows = [(i, float(i), None if i % 2 else "2024-03-0%d" % (i % 9 + 1), "a" if i % 2 else "Jan 3", i % 2 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "row int, amount double, day string, word string, flag boolean").withColumn("at", F.timestamp_seconds(F.col("row")))
    df = df.withColumn("none", F.lit(None).cast("timestamp")).withColumn("spelled", F.lit("3 Feb 2024"))
    kinds = {r.column: r.kind for r in S.semantic_types(df, "row").collect()}
    assert kinds == {"amount": "numeric", "day": "timestamp", "word": "categorical", "flag": "categorical", "at": "timestamp", "none": "numeric", "spelled": "timestamp"}
