"""Fits against plain Python: trees are walked node by node, measures counted pair by pair, path lengths searched by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from brindle.functions.numbers import RECOMMENDATIONS
from brindle.operators import anomaly as A
from brindle.operators import models as M
from brindle.operators import registry as G
from brindle.operators.stats import chart_importance

SCHEMA = "id int, kind string, size double, noise double, outcome string, rate double"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    out = []
    for i in range(240):
        kind, size, noise = rnd.choice(["a", "b", "c", None]), rnd.choice([None, rnd.uniform(0, 10)]), rnd.random()
        hit = (size or 0) + (4 if kind == "b" else 0) + 3 * rnd.random() > 7
        out.append((i, kind, size, noise, "Yes" if hit else "No", 10 * (size or 0) + (25 if kind == "a" else 0) + noise))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


CODES = {"Unknown": 0, "a": 1, "b": 2, "c": 3}


def features(row):
    """Coded category and numbers; unknown values count as 0."""
    return [float(CODES["Unknown" if row[1] is None else row[1]]), row[2] or 0.0, row[3]]


def leaf_of(tree, x):
    node = tree._java_obj.rootNode()
    while node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
    return node


def forest_probability(model, x):
    """Mean over the trees of the share of the second class in the leaf."""
    shares = [0.0, 0.0]
    for tree in model.trees:
        stats = list(leaf_of(tree, x).impurityStats().stats())
        for k in (0, 1):
            shares[k] += stats[k] / sum(stats)
    return shares[1] / sum(shares)


def boosted_probability(model, x):
    margin = sum(w * leaf_of(tree, x).prediction() for w, tree in zip(model.treeWeights, model.trees))
    return 1 / (1 + math.exp(-2 * margin))


def level(p):
    return "HIGH" if p >= 0.7 else "MEDIUM" if p >= 0.4 else "LOW"


def brute_measures(scored):
    tp = sum(1 for y, p in scored if y and p >= 0.5)
    fp = sum(1 for y, p in scored if not y and p >= 0.5)
    fn = sum(1 for y, p in scored if y and p < 0.5)
    tn = len(scored) - tp - fp - fn
    pairs = [(p > q) + (p == q) / 2 for y, p in scored if y for z, q in scored if not z]
    precision, recall = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
    return {"tp": tp, "tn": tn, "fp": fp, "fn": fn, "accuracy": (tp + tn) / len(scored), "precision": precision, "recall": recall,
            "f1": 2 * precision * recall / (precision + recall) if precision + recall else 0.0, "auc": sum(pairs) / len(pairs)}


@pytest.fixture(scope="module", params=[("random_forest", 7, forest_probability), ("gradient_boosting", 5, boosted_probability)], ids=["rf", "gbt"])
def fitted(request, table):
    algorithm, trees, probability = request.param
    return M.train_classifier(table, "outcome", ["id"], algorithm, ["kind"], ["size", "noise"], trees=trees), algorithm, trees, probability


def test_probabilities_by_walking_the_trees(fitted, table, rows):
    trained, _, trees, probability = fitted
    model = trained.model.stages[-1]
    assert len(model.trees) == trees and trained.features == ["kind_encoded", "size", "noise"]
    got = {r.id: r for r in M.score_batch(trained, table, ["id"]).collect()}
    assert len(got) == len(rows)
    for row in rows:
        p = probability(model, features(row))
        assert got[row[0]].probability == pytest.approx(p, abs=1e-9)
        assert got[row[0]].predicted == (p > 0.5) or abs(p - 0.5) < 1e-9
        assert got[row[0]].actual == (row[4] == "Yes")
    assert len({round(r.probability, 6) for r in got.values()}) > 5


def test_measures_of_the_test_rows(fitted, table, rows):
    trained, algorithm, _, probability = fitted
    split = M.split_stratified(M.binary_target(table, "outcome"), ["id"], "label")
    held = {r.id for r in split.filter("NOT is_train").collect()}
    scored = [(row[4] == "Yes", probability(trained.model.stages[-1], features(row))) for row in rows if row[0] in held]
    got = trained.metrics.first().asDict()
    for name, value in brute_measures(scored).items():
        assert got[name] == pytest.approx(value, abs=1e-4), name
    assert (got["algorithm"], got["features_used"], got["target"]) == (algorithm, 3, "outcome")
    assert not got["alert"] and got["auc"] > 0.7


def test_the_rows_of_a_merged_fit_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(size):
        made.add(1)
        return size

    rows = spark.range(400).select("id", (F.col("id") % 5).cast("double").alias("size"), F.when(F.col("id") % 5 > 2, "Yes").otherwise("No").alias("outcome"))
    trained = M.train_classifier(rows.withColumn("size", seen("size")), "outcome", ["id"], "random_forest", [], ["size"], trees=2)
    got = trained.metrics.first()
    assert made.value == 400 and got.tp + got.tn + got.fp + got.fn == 80


@pytest.mark.parametrize("algorithm", ["random_forest", "gradient_boosting"])
def test_many_single_rows_of_a_fit_are_made_once(spark, monkeypatch, algorithm):
    monkeypatch.setattr(M, "FEW_ROWS", 100)
    monkeypatch.setattr(M, "MERGED_ROWS", 1000)
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(size):
        made.add(1)
        return size

    rows = spark.range(400).select("id", F.col("id").cast("double").alias("size"), F.when(F.col("id") % 100 > 60, "Yes").otherwise("No").alias("outcome"))
    table = rows.withColumn("size", seen("size"))
    trained = M.train_classifier(table, "outcome", ["id"], algorithm, [], ["size"], trees=5)
    got = trained.metrics.first()
    assert made.value == 400 and got.tp + got.tn + got.fp + got.fn == 80
    model = trained.model.stages[-1]
    assert sum(t._java_obj.rootNode().impurityStats().rawCount() for t in model.trees) > 5 * 200 and got.accuracy > 0.8


def test_scores_are_computed_once_for_the_measures(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(score):
        made.add(1)
        return score

    rows = spark.range(500).select((F.col("id") % 2).cast("int").alias("label"), seen((F.col("id") % 7) / 7.0).alias("score"))
    got = M.classifier_metrics(rows, "label", "score").first()
    assert made.value == 500 and got.tp + got.tn + got.fp + got.fn == 500


def test_columns_of_many_values(spark):
    rows = spark.range(0, 400, 1, 5).select(*[(F.col("id") % n).cast("double").alias(f"c{n}") for n in (1, M.BINS, M.BINS + 1, 200)])
    assert M._many_valued(rows, rows.columns) == {f"c{M.BINS + 1}", "c200"}
    assert M._many_valued(rows.filter("c1 > 1"), rows.columns) == set()


def test_new_rows_with_missing_inputs(fitted, spark, rows):
    trained, _, _, probability = fitted
    got = M.score_rows(trained, spark.createDataFrame([(1, 9.0), (2, None)], "id int, size double"), ["id"]).collect()
    for r, size in zip(sorted(got), (9.0, 0.0)):
        p = probability(trained.model.stages[-1], [0.0, size, 0.0])
        assert r.probability == pytest.approx(p, abs=5.1e-4) and r.positive == (p > 0.5)
        assert r.recommendation == RECOMMENDATIONS[r.risk_level]


def test_importance_is_that_of_the_fit_in_order(fitted):
    trained = fitted[0]
    found = {r.feature: r.importance for r in M.feature_importance(trained).collect()}
    values = list(trained.model.stages[-1].featureImportances.toArray())
    assert found == dict(zip(trained.features, values)) and sum(values) == pytest.approx(1) and found["size"] == max(values)
    ranked = [(r.feature, r.importance) for r in M.rank_importance(M.feature_importance(trained)).collect()]
    assert ranked == sorted(found.items(), key=lambda x: (-x[1], x[0]))
    assert [r.label for r in chart_importance(M.feature_importance(trained), 2).collect()] == [
        f.replace("_encoded", "").capitalize() for f, _ in ranked[:2]]


def test_saved_model_scores_alike(fitted, spark, table, tmp_path):
    trained = fitted[0]
    M.save_model(trained, str(tmp_path))
    again = {r.id: r.probability for r in M.score_batch(M.load_model(spark, str(tmp_path)), table, ["id"]).collect()}
    assert again == {r.id: r.probability for r in M.score_batch(trained, table, ["id"]).collect()}


@pytest.fixture(scope="module")
def rates(table):
    return M.train_rate_regressor(table, ["id"], "rate", ["kind"], ["size"], trees=6)


def predicted(trained, row):
    found = [leaf_of(tree, features(row)[:2]).prediction() for tree in trained.model.stages[-1].trees]
    return sum(found) / len(found)


def test_rates_by_walking_the_trees(rates, table, rows):
    got = {r.id: r.predicted_rate for r in M.score_rate(rates, table, ["id"]).collect()}
    assert len(got) == len(rows)
    for row in rows:
        assert got[row[0]] == pytest.approx(predicted(rates, row), abs=0.0051)


def test_r2_of_both_sides(rates, table, rows):
    split = {r.id: r.is_train for r in M.split_stratified(table.withColumn("one", F.lit(1)), ["id"], "one").collect()}
    got = rates.metrics.first()
    assert (got.total_records, got.train_records, got.test_records, got.unique_kind) == (240, 192, 48, 3)
    for on, value in ((True, got.train_r2), (False, got.test_r2)):
        side = [row for row in rows if split[row[0]] == on]
        mean = sum(r[5] for r in side) / len(side)
        gap = sum((r[5] - predicted(rates, r)) ** 2 for r in side)
        assert value == pytest.approx(1 - gap / sum((r[5] - mean) ** 2 for r in side), abs=1e-4)
    assert got.test_r2 > 0.8


def test_rate_gap(rates, table, rows):
    got = {r.id: r for r in M.rate_gap(rates, table, ["id"], "rate").collect()}
    for row in rows:
        p = round(predicted(rates, row), 2)
        r = got[row[0]]
        assert r.actual_rate == pytest.approx(row[5], abs=0.0051) and r.predicted_rate == pytest.approx(p, abs=0.0101)
        assert r.difference == pytest.approx(r.predicted_rate - row[5], abs=0.0051)


@pytest.fixture(scope="module")
def repeated(spark):
    """4,000 distinct numbers, 8 rows each, and a few kinds: far fewer rows once trees tell them apart by 32 values."""
    rnd = random.Random(5)
    out = []
    for i in range(32_000):
        kind, size = rnd.choice(["a", "b", None]), float(i % 4000)
        out.append((i, kind, size, 0.0, "Yes" if size > 3000 or kind == "b" else "No", size / 100 + (9 if kind == "a" else 0) + rnd.random()))
    return out, spark.createDataFrame(out, SCHEMA).repartition(4).cache()


def test_rows_that_trees_cannot_tell_apart_are_fitted_once(repeated):
    rows, table = repeated
    trained = M.train_rate_regressor(table, ["id"], "rate", ["kind"], ["size"], trees=4)
    model = trained.model.stages[-1]
    # 32 values of size, 3 of kind; every training row counts with its weight
    assert max(t._java_obj.rootNode().impurityStats().count() for t in model.trees) > 20_000
    assert all(t._java_obj.rootNode().impurityStats().rawCount() < 300 for t in model.trees)
    assert trained.metrics.first().train_records == 25_600 and trained.metrics.first().test_r2 > 0.85
    got = {r.id: r.predicted_rate for r in M.score_rate(trained, table, ["id"]).collect()}
    assert len(got) == len(rows)
    for row in rows[::97]:
        x = [float({"Unknown": 0, "a": 1, "b": 2}["Unknown" if row[1] is None else row[1]]), row[2]]
        assert got[row[0]] == pytest.approx(sum(leaf_of(t, x).prediction() for t in model.trees) / 4, abs=0.0051)


@pytest.mark.parametrize("algorithm", ["random_forest", "gradient_boosting"])
def test_classes_of_merged_rows(repeated, algorithm):
    rows, table = repeated
    trained = M.train_classifier(table, "outcome", ["id"], algorithm, ["kind"], ["size"], trees=5)
    root = trained.model.stages[-1].trees[0]._java_obj.rootNode().impurityStats()
    assert root.rawCount() < 300 and root.count() > 15_000
    assert trained.metrics.first().accuracy > 0.95


def test_merged_rows_hold_every_row_on_its_side_of_every_split(spark):
    # a heavy value, a long tail and a feature that is told apart whole
    sizes = [0.0] * 9000 + [float(i) ** 2 for i in range(1, 1001)]
    table = spark.createDataFrame([(i, v, i % 3.0, float(i)) for i, v in enumerate(sizes)], "id int, size double, part double, y double")
    stages, names = M.numeric_stages([], ["size", "part"])
    merged = [(list(r.features), r.y, r.weight) for r in M.merge_rows(table, stages, names, "y", mean=True).collect()]
    assert sum(w for _, _, w in merged) == 10_000 and sum(y * w for _, y, w in merged) == pytest.approx(sum(range(10_000)))
    levels = sorted({x[0] for x, _, _ in merged})
    assert len(levels) == M.BINS and {x[1] for x, _, _ in merged} == {0.0, 1.0, 2.0}
    for a, b in zip(levels, levels[1:]):
        cut = (a + b) / 2
        assert sum(w for x, _, w in merged if x[0] <= cut) == sum(v <= cut for v in sizes)
    assert M.merge_rows(table.withColumn("size", F.col("id") / 7).filter("id < 100"), stages, names, "y", mean=True) is None


def unsuccessful(n):
    """Mean path of an unsuccessful search in a binary tree of n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def test_isolation_scores_by_walking_the_trees(spark):
    rnd = random.Random(1)
    points = [(i, rnd.gauss(0, 1), rnd.gauss(0, 1)) for i in range(150)] + [(900, 30.0, 30.0), (901, None, 1.0)]
    df = spark.createDataFrame(points, "id int, a double, b double")
    forest, scored = A.fit_scores(df, ["id"], ["a", "b"])
    known = [sorted(p[k] for p in points if p[k] is not None) for k in (1, 2)]
    middle = [(k[(len(k) - 1) // 2] + k[len(k) // 2]) / 2 for k in known]
    assert forest.fills == pytest.approx(middle) and forest.sample == 152
    raw = {}
    for i, a, b in points:
        x, depth = [middle[0] if a is None else a, b], 0.0
        for t in forest.trees:
            at = 0
            while t["feature"][at] >= 0:
                at = t["left"][at] if x[t["feature"][at]] < t["threshold"][at] else t["right"][at]
            depth += t["length"][at]
        raw[i] = -(2 ** (-depth / (len(forest.trees) * unsuccessful(forest.sample))))
    got = {r.id: r for r in scored.collect()}
    for i, value in raw.items():
        assert got[i].score == pytest.approx(value - forest.offset, abs=1e-9) and got[i].anomaly == (got[i].score < 0)
    ordered = sorted(raw.values())
    assert ordered[0] <= forest.offset <= ordered[len(ordered) // 5] and min(raw, key=raw.get) == 900


def test_leaf_lengths_count_depth_and_points_left():
    import numpy as np
    points = np.random.default_rng(2).normal(size=(64, 2))
    tree = A._grow(points, 5)
    rows, seen = [(0, np.arange(64), 0)], 0
    while rows:
        at, some, depth = rows.pop()
        if tree["feature"][at] < 0:
            assert tree["length"][at] == pytest.approx(depth + unsuccessful(len(some)))
            seen += len(some)
            continue
        below = points[some, tree["feature"][at]] < tree["threshold"][at]
        assert 0 < below.sum() < len(some)
        rows += [(tree["left"][at], some[below], depth + 1), (tree["right"][at], some[~below], depth + 1)]
    assert seen == 64


def test_scores_after_a_rollback_are_those_of_the_first_version(spark):
    rnd = random.Random(3)
    df = spark.createDataFrame([(i, rnd.gauss(0, 1), rnd.gauss(0, 9)) for i in range(120)], "id int, a double, b double")
    first = G.written(G.retrain(G.empty_registry(spark), df, ["id"], ["a"]), "registry")
    before = {r.id: r.score for r in A.score_with(G.active_forest(first), df, ["id"]).collect()}
    both = G.written(G.retrain(first, df, ["id"], ["a", "b"]), "registry")
    back = G.rollback(both, both.filter("version LIKE 'v1%'").first()["version"])
    assert {r.id: r.score for r in A.score_with(G.active_forest(back), df, ["id"]).collect()} == before and len(set(before.values())) > 20


def test_retrain_eval_measures(spark):
    """The three measures of a retraining run, each taken from its parts."""
    from brindle import queries as registry
    from brindle.queries import models as Q

    registry.load_all()
    folder = "/root/testdata/sf0.001"
    got = {r.measure: r.value for r in registry.QUERIES["retrain_eval"](spark, folder).collect()}
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    assert got["trends_fitted"] == len({r[0] for r in orders.select("o_orderpriority").collect()})
    # price numeric, status and priority categories of text, date a time: all four columns fit their type
    assert got["schema_accuracy"] == pytest.approx(1.0) or got["schema_accuracy"] == pytest.approx(100.0)
    hits = [r.severity for r in A.anomaly_iforest(Q._priced(registry.Tables(spark, folder)), ["o_orderkey"], list(Q.COLS)).collect()]
    assert hits and got["anomaly_precision"] == pytest.approx(100 * hits.count("high") / len(hits))


@pytest.mark.parametrize("name", ["join_pred_actual", "model_load"])
def test_rows_that_two_sides_read_are_made_once(spark, monkeypatch, name):
    from brindle import queries as registry
    from brindle.queries import models as Q

    registry.load_all()
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(size):
        made.add(1)
        return size

    rows = spark.range(80).select(F.col("id").alias("o_orderkey"), (F.col("id") % 5).cast("double").alias("size"), F.when(F.col("id") % 5 > 2, "Yes").otherwise("No").alias("outcome"))
    fit = M.train_classifier(rows, "outcome", ["o_orderkey"], "random_forest", [], ["size"], trees=2)
    monkeypatch.setattr(Q, "trained", lambda t: fit)
    monkeypatch.setattr(Q, "account", lambda t: rows.withColumn("size", seen("size")))
    got = registry.QUERIES[name](spark, "").collect()
    assert made.value == 80 and {r.o_orderkey for r in got} == set(range(80)) and len(got) == 80
    assert all(r.same for r in got) if name == "model_load" else all(r.actual == (r.o_orderkey % 5 > 2) for r in got)
