"""Forests grown side by side (M8): the draws of the JVM, and Spark ML's trees node for node."""

import random

import numpy as np
import pytest
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from runwise.operators import forest_fit
from runwise.operators import model as M


def test_draws_are_those_of_the_jvm(spark):
    jvm = spark._jvm
    counts = jvm.org.apache.commons.math3.distribution.PoissonDistribution(1.0)
    counts.reseedRandomGenerator(4291)
    want = list(counts.sample(30000))
    bag = forest_fit.Bag(4291)
    assert bag.take(0, 12000).tolist() == want[:12000]
    bag.forget(9000)
    assert bag.take(9000, 21000).tolist() == want[9000:]
    for seed in (4283, -7, 1 << 40):
        theirs, mine = jvm.org.apache.spark.util.random.XORShiftRandom(seed), forest_fit.XorShift(seed)
        assert [theirs.nextInt(), theirs.nextDouble()] == [mine.next_int(), mine.next_double()]
        theirs, mine = jvm.java.util.Random(seed), forest_fit.JavaRandom(seed)
        assert [theirs.nextLong(), theirs.nextLong()] == [mine.next_long(), mine.next_long()]


def test_logarithm_is_javas(spark):
    rng = random.Random(5)
    x = [rng.randint(1, n) / n for n in (rng.randint(1, 10 ** rng.randint(1, 6)) for _ in range(500))] + [1.0, 1 - 2.0 ** -30, 0.5, 2.0 ** -40]
    strict = spark._jvm.java.lang.StrictMath
    assert forest_fit.java_log(np.array(x)).tolist() == [strict.log(v) for v in x]


def table(spark, n, classes, parts=3):
    """Rows with few and many categories and numbers, some of them 0, that say something of the label; features, label, fold."""
    rng = random.Random(n + classes)
    rows = []
    for k in range(n):
        few, many, x = rng.choice("abcd"), f"m{rng.randrange(23)}", rng.choice([0.0, round(rng.uniform(-2, 5), 2), rng.uniform(0, 9)])
        label = (ord(few) + int(many[1:]) // 7 + int(x > 3) + rng.choice([0, 0, 0, 1])) % classes
        rows.append((few, many, rng.choice("pq"), "only", x, float(rng.randrange(5)), rng.gauss(label, 3), 1.5, 0.0, f"e{label}", k % 3))
    names = ["few", "many", "two", "one", "x", "small", "near", "same", "none", "exit", "fold"]
    df = spark.createDataFrame(rows, names).repartition(parts, "fold", "many").sortWithinPartitions("near").checkpoint()
    cats = names[:4]
    for c in [*cats, "exit"]:
        df = StringIndexer(inputCol=c, outputCol="label" if c == "exit" else f"{c}_idx").fit(df).transform(df)
    features = [f"{c}_idx" for c in cats] + names[4:9]
    return VectorAssembler(inputCols=features, outputCol="features").transform(df).select("features", "label", "fold").cache()


def forest(trees, **other):
    return M.RandomForestClassifier(labelCol="label", featuresCol="features", impurity="entropy", featureSubsetStrategy="sqrt", numTrees=trees,
                                    seed=4283, **other)


def differing(fitted, grown):
    """Nodes of Spark ML's trees that are others here."""
    bad, seen = [], 0
    for t, (theirs, (splits, leaves)) in enumerate(zip(fitted._java_obj.trees(), grown.trees(), strict=True)):
        todo = [(theirs.rootNode(), 1)]
        while todo:
            there, node = todo.pop()
            seen += 1
            if there.getClass().getSimpleName() == "LeafNode":
                stats = list(there.impurityStats().stats())
                if node in splits or [x / (sum(stats) or 1.0) for x in stats] != leaves[node].tolist():
                    bad.append((t, node))
                continue
            feature, split = splits.get(node, (None, None))
            s = there.split()
            same = feature == s.featureIndex() and (grown.shape.thresholds[feature][split] == s.threshold() if isinstance(split, int)
                                                    else sorted(s.leftCategories()) == sorted(map(float, split)))
            if not same:
                bad.append((t, node))
            else:
                todo += [(there.leftChild(), 2 * node), (there.rightChild(), 2 * node + 1)]
    return bad, seen


@pytest.mark.parametrize("n,classes,settings", [
    (600, 5, dict(numTrees=7, maxDepth=5, maxBins=500)),
    (600, 2, dict(numTrees=3, maxDepth=4, maxBins=64)),
    (600, 4, dict(numTrees=1, maxDepth=2, maxBins=30, maxMemoryInMB=0)),      # a node a pass
    (16500, 4, dict(numTrees=40, maxDepth=4, maxBins=40, maxMemoryInMB=1)),   # thresholds from a sample, several passes a level
])
def test_forests_are_spark_mls(spark, tmp_path, n, classes, settings):
    rows = table(spark, n, classes)
    trees = settings.pop("numTrees")
    fits = [(forest(trees, **settings), 0), (forest(trees + 2, **settings), 0), (forest(trees, **settings), 1)]
    grown = forest_fit.grow(rows, fits)
    counted = forest_fit.held_out(rows, grown)
    for k, ((rf, fold), mine, found) in enumerate(zip(fits, grown, counted, strict=True)):
        # Read back without the summary, which for two classes keeps tasks from being sent once the session has observed a table.
        rf.fit(rows.where(F.col("fold") != fold)).save(f"file://{tmp_path}/{k}")
        fitted = M.RandomForestClassificationModel.load(f"file://{tmp_path}/{k}")
        bad, seen = differing(fitted, mine)
        assert not bad and seen > trees
        held = fitted.transform(rows.where(F.col("fold") == fold))
        assert found == (rf.getNumTrees(), fold, held.count(), held.where("prediction = label").count())
    rows.unpersist()


def test_folds_need_no_fit_of_spark_ml(spark, monkeypatch):
    """Each fit of Spark ML counts a row once for every subset of a feature's few categories, and shuffles all counts for each task."""
    rng = random.Random(3)
    data = [(k, rng.choice("ab"), rng.choice("xyz"), rng.uniform(0, 9), rng.randrange(24), rng.gauss(0, 1)) for k in range(300)]
    train = spark.createDataFrame(data, "flight_id long, runway string, carrier string, decel double, hour int, touchdownLat double") \
        .withColumn("exit", F.concat(F.lit("e"), ((F.col("decel") / 3).cast("int") + (F.col("runway") == "a").cast("int")).cast("string")))
    features, kept = ["runway", "carrier", "decel", "hour", "touchdownLat"], forest_fit.grow
    monkeypatch.setattr(M.forest_fit, "grow", lambda rows, fits: None)
    alone = M.tune_folds(train, features, trees=(3, 5), depth=4, folds=3).collect()
    monkeypatch.setattr(M.forest_fit, "grow", kept)
    monkeypatch.setattr(M.RandomForestClassifier, "fit", lambda *_: pytest.fail("a fit of its own"))
    assert M.tune_folds(train, features, trees=(3, 5), depth=4, folds=3).collect() == alone


def test_cases_left_to_spark_ml(spark):
    rows = table(spark, 60, 3, parts=1)
    assert forest_fit.grow(rows, [(forest(3, maxBins=10), 0)]) is None      # more categories than bins
    assert forest_fit.grow(rows.where("fold = 0"), [(forest(3), 0)]) is None
    assert forest_fit.grow(rows, [(forest(3, minInfoGain=0.1), 0)]) is None
    rows.unpersist()
