"""The fitted forest: its node table against the model, folds, unseen categories, saving."""

import re

import pytest
from pyspark.sql import functions as F

from runwise.operators import model as M
from runwise.plans import catalog
from runwise.sources import sinks


@pytest.fixture(scope="module")
def fitted(spark, sf):
    model, train, test = catalog._trained(spark, sf)
    data = catalog._prepared(spark, sf)
    nodes, _ = catalog._nodes(spark, sf)
    return model, train, test, data, nodes.cache()


def test_node_table_predicts_what_the_model_predicts(spark, fitted):
    model, _, _, data, nodes = fitted
    want = {r["flight_id"]: r["predictedExit"] for r in M.predict(model, data).collect()}
    twice = data.unionByName(data.limit(3))
    got = M.score_by_nodes(nodes, M.features_of(model, twice, ["flight_id"]), M.exit_labels(model)).collect()
    assert len(got) == len(want) + 3
    assert all(want[r["flight_id"]] == r["predictedExit"] for r in got)
    raw = {r["flight_id"]: list(r["rawPrediction"]) for r in model.transform(data).select("flight_id", "rawPrediction").collect()}
    assert all(r["votes"] == pytest.approx(raw[r["flight_id"]], abs=1e-9) for r in got)


def test_importances_from_the_node_table(spark, fitted):
    model, *_, nodes = fitted
    want = {(r["tree"], r["feature"]): r["importance"] for r in M.importances(spark, model).collect()}
    got = {(r["tree"], r["feature"]): r["importance"] for r in M.importances_by_nodes(nodes, M.feature_names(model)).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_depth_and_shape(spark, fitted):
    model, *_, nodes = fitted
    trees = M.forest(model).trees
    assert M.forest_depth(nodes).first()[0] == max(t.depth for t in trees)
    per_tree = {r["treeID"]: r["n"] for r in nodes.groupBy("treeID").agg(F.count("*").alias("n")).collect()}
    assert per_tree == {k: t.numNodes for k, t in enumerate(trees)}
    sides = nodes.groupBy("treeID").agg(F.sum((F.col("side") == "left").cast("int")).alias("l"),
                                        F.sum((F.col("side") == "right").cast("int")).alias("r"), F.sum((F.col("left") >= 0).cast("int")).alias("inner"))
    assert all((r["l"] or 0) == (r["r"] or 0) == r["inner"] for r in sides.collect())


def test_conditions_say_what_the_nodes_do(spark, fitted):
    """Walking the texts of one landing leads to the class that the tree predicts."""
    model, *_, data, nodes = fitted
    text = {(r["treeID"], r["node"]): r["condition"] for r in M.node_condition(spark, nodes, model).collect()}
    child = {(r["treeID"], r["node"]): (r["left"], r["right"]) for r in nodes.collect()}
    row = data.orderBy("flight_id").first().asDict()
    labels = M.exit_labels(model)
    vector = M.features_of(model, data.where(F.col("flight_id") == row["flight_id"]), ["flight_id"]).first()["features"]
    from pyspark.ml.linalg import Vectors
    for k, tree in enumerate(M.forest(model).trees):
        at = 0
        while not text[(k, at)].startswith("Predict Exit "):
            said = re.fullmatch(r"Is (\w+) (?:in \((.*)\)|<= (.*))\?", text[(k, at)])
            name, among, bound = said.groups()
            yes = str(row[name]) in among.split(", ") if among is not None else row[name] <= float(bound)
            at = child[(k, at)][0 if yes else 1]
        assert text[(k, at)] == f"Predict Exit {labels[int(tree.predict(Vectors.dense(vector)))]}"


def test_unseen_categories_and_repeated_rows(spark, fitted):
    model, *_, data, _ = fitted
    some = data.orderBy("flight_id").limit(4)
    odd = some.withColumn("carrier", F.lit("NEVER")).unionByName(some.withColumn("decel", F.lit(None).cast("double"))) \
        .unionByName(some.withColumn("runway", F.lit(None).cast("string")))
    scored = M.score(model, some.unionByName(some).unionByName(odd))
    rows = scored.collect()
    assert len(rows) == 20 and scored.columns == [*data.columns, "predictedExit"]
    fine = [r for r in rows if r["carrier"] != "NEVER" and r["decel"] is not None and r["runway"] is not None]
    want = {r["flight_id"]: r["predictedExit"] for r in M.predict(model, some).collect()}
    assert len(fine) == 8 and all(r["predictedExit"] == want[r["flight_id"]] for r in fine)
    assert all(r["predictedExit"] is None for r in rows if r not in fine)


def test_folds(spark, fitted):
    _, train, *_ = fitted
    keyed = train.select("flight_id")
    folds = [{r["flight_id"]: r["fold"] for r in d.select("flight_id", M.fold_of("flight_id", 3, 7).alias("fold")).collect()}
             for d in (keyed.repartition(2), keyed.repartition(7))]
    assert folds[0] == folds[1] and set(folds[0].values()) == {0, 1, 2}
    by_fold = M.tune_folds(train, list(catalog.ALL_FEATURES), trees=(3, 5), depth=3, folds=3)
    rows = by_fold.collect()
    assert sorted((r["num_trees"], r["fold"]) for r in rows) == [(n, k) for n in (3, 5) for k in range(3)]
    assert all(0 <= r["accuracy"] <= 1 and r["n_correct"] <= r["n_held_out"] for r in rows)
    best = M.best_params(by_fold).collect()
    mean = {n: sum(r["accuracy"] for r in rows if r["num_trees"] == n) / 3 for n in (3, 5)}
    assert {r["num_trees"]: r["mean_accuracy"] for r in best} == pytest.approx(mean)
    assert [r["num_trees"] for r in best if r["best"]] == [max(sorted(mean), key=lambda n: (mean[n], -n))]


def test_folds_keep_the_node_of_each_row(spark, fitted, monkeypatch):
    _, train, *_ = fitted
    seen, forest = [], M.RandomForestClassifier
    found = []
    for keep in (None, False):
        monkeypatch.setattr(M, "RandomForestClassifier", lambda **kw: seen.append(kw) or forest(**kw | ({} if keep is None else {"cacheNodeIds": keep})))
        found.append(sorted(map(tuple, M.tune_folds(train, list(catalog.ALL_FEATURES), trees=(4,), depth=3, folds=2).collect())))
    assert sum(kw.get("cacheNodeIds", False) for kw in seen) == 4
    assert found[0] == found[1]


def test_loaded_model_predicts_the_same(spark, fitted, tmp_path):
    model, _, _, data, _ = fitted
    sinks.save_model(model, f"file://{tmp_path}", "r1")
    loaded = sinks.load_model(f"file://{tmp_path}", "r1")
    both = [sorted((r["flight_id"], r["predictedExit"]) for r in M.predict(m, data).collect()) for m in (model, loaded)]
    assert both[0] == both[1] and len(both[0]) == data.count()
