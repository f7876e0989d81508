"""Exit prediction with a Spark ML random forest.

Training, scoring and evaluation are Spark ML jobs on the landing table; the
only driver-side values are the model's own bounded metadata (category labels,
importances, tree count).
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runwise.constants import (FOREST_IMPURITY, FOREST_MAX_BINS, FOREST_SEED, FOREST_SUBSAMPLING, FOREST_SUBSET,
                               MIN_FEATURES, SPLIT_SEED, SPLIT_WEIGHTS, TUNE_DEPTH, TUNE_FOLDS, TUNE_TREES)
from runwise.operators import forest_fit
from runwise.session import materialise

TUNE_MEMORY_MB = 1024  # statistics of the nodes split in one pass: fewer passes a fit
EXCLUDED = {"positions", "link_ids", "links", "exit", "flight_id"}
VECTOR_COLS = ["features", "rawPrediction", "label", "probability"]


def split(df: DataFrame, seed: int = SPLIT_SEED, mode: str = "hash", key: str = "flight_id") -> tuple[DataFrame, DataFrame]:
    """M1: 70/30 split.  'hash' is stable under any partitioning (MD5 of key and seed); 'random' is randomSplit."""
    if mode == "random":
        a, b = df.randomSplit(list(SPLIT_WEIGHTS), seed)
        return a, b
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 1000
    cut = int(SPLIT_WEIGHTS[0] * 1000)
    return df.where(bucket < cut), df.where(bucket >= cut)


def feature_kinds(df: DataFrame, features: list[str] | None = None) -> list[tuple[str, str]]:
    """M2: (name, 'categorical' | 'continuous') from the schema; strings are categorical."""
    out = []
    for f in df.schema.fields:
        if f.name in EXCLUDED or (features is not None and f.name not in features):
            continue
        if isinstance(f.dataType, T.StringType):
            out.append((f.name, "categorical"))
        elif isinstance(f.dataType, (T.LongType, T.IntegerType, T.DoubleType, T.FloatType)):
            out.append((f.name, "continuous"))
    return out


def check_features(features: list[str]) -> None:
    if "runway" not in features or len(features) < MIN_FEATURES:
        raise ValueError(f"choose at least {MIN_FEATURES} features including 'runway'")


def fit_pipeline(data: DataFrame, train: DataFrame, features: list[str], trees: int, depth: int,
                 fit_on: str = "all", forest_too: bool = True) -> PipelineModel:
    """M3-M7 (without the forest: M3-M5): category indexers (fitted on all rows, invalid rows skipped), assembler, label
    indexer (fitted on the training rows), random forest, label decoder."""
    check_features(features)
    kinds = feature_kinds(data, features)
    cats = [n for n, k in kinds if k == "categorical"]
    conts = [n for n, k in kinds if k == "continuous"]
    basis = data if fit_on == "all" else train
    indexers = [StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="skip").fit(basis) for c in cats]
    assembler = VectorAssembler(inputCols=[f"{c}_idx" for c in cats] + conts, outputCol="features")
    label = StringIndexer(inputCol="exit", outputCol="label", handleInvalid="skip").fit(train)
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", impurity=FOREST_IMPURITY,
                                    featureSubsetStrategy=FOREST_SUBSET, subsamplingRate=FOREST_SUBSAMPLING,
                                    maxBins=FOREST_MAX_BINS, numTrees=trees, maxDepth=depth, seed=FOREST_SEED)
    decode = IndexToString(inputCol="prediction", outputCol="predictedExit", labels=label.labels)
    head = PipelineModel(stages=[*indexers, assembler, label])
    if not forest_too:
        return head
    rf_model = forest.fit(head.transform(train))
    return PipelineModel(stages=[*indexers, assembler, label, rf_model, decode])


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """M7 + P16: scored rows with predictedExit; model vector columns dropped."""
    return model.transform(df).drop(*VECTOR_COLS, "prediction",
                                    *[c for c in model.transform(df.limit(0)).columns if c.endswith("_idx")])


def accuracy_of(scored: DataFrame, label: str = "exit", predicted: str = "predictedExit") -> DataFrame:
    """Share of rows whose predicted label equals the true label, in percent (one aggregation)."""
    same = (F.col(label) == F.col(predicted)).cast("double")
    return scored.agg((F.avg(same) * 100).alias("accuracy"), F.count(F.lit(1)).alias("scored"))


def accuracy(model: PipelineModel, df: DataFrame) -> DataFrame:
    return accuracy_of(model.transform(df))


def forest(model: PipelineModel) -> RandomForestClassificationModel:
    return next(s for s in model.stages if isinstance(s, RandomForestClassificationModel))


def exit_labels(model: PipelineModel) -> list[str]:
    return next(s.labels for s in model.stages if isinstance(s, StringIndexerModel) and s.getInputCol() == "exit")


def feature_names(model: PipelineModel) -> list[str]:
    va = next(s for s in model.stages if isinstance(s, VectorAssembler))
    return [c[:-4] if c.endswith("_idx") else c for c in va.getInputCols()]


def feature_metadata(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """(featureName, featureType, categories); the label `exit` is the last entry."""
    idx = {s.getInputCol(): s.labels for s in model.stages
           if isinstance(s, StringIndexerModel) and s.getInputCol() != "exit"}
    label = next(s for s in model.stages if isinstance(s, StringIndexerModel) and s.getInputCol() == "exit")
    rows = [(n, "categorical" if n in idx else "continuous", idx.get(n)) for n in feature_names(model)]
    rows.append(("exit", "categorical", list(label.labels)))
    return spark.createDataFrame(rows, "featureName string, featureType string, categories array<string>")


def importances(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """Forest and per-tree feature importances in percent (tree -1 = forest)."""
    rf = forest(model)
    names = feature_names(model)
    rows = [(-1, n, float(v) * 100) for n, v in zip(names, rf.featureImportances.toArray())]
    for t, tree in enumerate(rf.trees):
        rows += [(t, n, float(v) * 100) for n, v in zip(names, tree.featureImportances.toArray())]
    return spark.createDataFrame(rows, "tree int, feature string, importance double")


def forest_nodes(spark: SparkSession, model: PipelineModel, path: str) -> DataFrame:
    """M9: tree nodes with depth, side, split feature, threshold / categories and prediction.

    The model is written with Spark's own writer; its node table is read back as a
    DataFrame and depths come from an iterative parent join (at most maxDepth rounds).
    """
    rf = forest(model)
    rf.write().overwrite().save(path)
    raw = spark.read.parquet(f"{path}/data")
    n = raw.select("treeID", F.col("nodeData.id").alias("node"), F.col("nodeData.prediction").alias("prediction"),
                   F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
                   F.col("nodeData.split.featureIndex").alias("feature_index"),
                   F.col("nodeData.split.leftCategoriesOrThreshold").alias("split_values"),
                   F.col("nodeData.split.numCategories").alias("num_categories"),
                   F.col("nodeData.gain").alias("gain"), F.col("nodeData.impurityStats").alias("class_weights"))
    parents = n.where(F.col("left") >= 0).select("treeID", F.explode(F.array(
        F.struct(F.col("left").alias("node"), F.lit("left").alias("side"), F.col("node").alias("parent")),
        F.struct(F.col("right").alias("node"), F.lit("right").alias("side"), F.col("node").alias("parent")))).alias("p")) \
        .select("treeID", "p.*")
    depth = n.join(parents, ["treeID", "node"], "left").select("treeID", "node", "side", "parent")
    level = depth.where(F.col("parent").isNull()).select("treeID", "node", F.lit(0).alias("depth"))
    known = level
    for d in range(1, rf.getMaxDepth() + 1):
        level = parents.join(level.select("treeID", F.col("node").alias("parent")), ["treeID", "parent"]) \
            .select("treeID", "node", F.lit(d).alias("depth"))
        known = known.unionByName(level)
    return n.join(depth, ["treeID", "node"]).join(known, ["treeID", "node"])


def node_condition(spark: SparkSession, nodes: DataFrame, model: PipelineModel) -> DataFrame:
    """Readable node text: 'Is X in (a, b)?', 'Is X <= t?' or 'Predict Exit e'."""
    meta = feature_metadata(spark, model).collect()
    names = F.array(*[F.lit(r["featureName"]) for r in meta[:-1]])
    cat_maps = {i: r["categories"] for i, r in enumerate(meta[:-1]) if r["categories"]}
    exits = F.array(*[F.lit(x) for x in meta[-1]["categories"]])
    fname = F.get(names, F.col("feature_index"))
    cat_text = F.lit(None).cast("string")
    for i, cats in cat_maps.items():
        arr = F.array(*[F.lit(c) for c in cats])
        cat_text = F.when(F.col("feature_index") == i, F.array_join(
            F.transform("split_values", lambda v: F.get(arr, v.cast("int"))), ", ")).otherwise(cat_text)
    leaf = F.col("left") < 0
    return nodes.select("treeID", "node", "depth", F.when(leaf, F.concat(F.lit("Predict Exit "), F.get(exits, F.col("prediction").cast("int"))))
                        .when(F.col("num_categories") >= 0, F.concat(F.lit("Is "), fname, F.lit(" in ("), cat_text, F.lit(")?")))
                        .otherwise(F.concat(F.lit("Is "), fname, F.lit(" <= "), F.get("split_values", 0).cast("string"), F.lit("?")))
                        .alias("condition"))


def forest_depth(nodes: DataFrame) -> DataFrame:
    """Maximum node depth over all trees."""
    return nodes.agg(F.max("depth").alias("max_depth"))


def features_of(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the feature vector as an array; rows that the model skips are left out."""
    from pyspark.ml.functions import vector_to_array
    head = PipelineModel(stages=[s for s in model.stages if isinstance(s, VectorAssembler)
                                 or isinstance(s, StringIndexerModel) and s.getInputCol() != "exit"])
    return head.transform(df).select(*keep, vector_to_array("features").alias("features"))


def score_by_nodes(nodes: DataFrame, rows: DataFrame, labels: list[str]) -> DataFrame:
    """M7 on the relation of M9: rows (any columns and ``features``) walk the node table level by level.

    A row is at one node of each tree; a level is one join with the node table, which has a row per node of the model
    and whose size Spark knows.  A tree votes with the class shares of the leaf, in tree order, and the first of
    the greatest sums wins, as in the fitted model.  Adds ``votes`` and ``predictedExit``.
    """
    keys = [c for c in rows.columns if c != "features"]
    table = nodes.select("treeID", "node", "left", "right", "feature_index", "split_values", "num_categories", "class_weights")
    depth, n_trees = nodes.agg(F.max("depth"), F.countDistinct("treeID")).first()
    # Rows get an id that stays, once written: the votes of a row meet again by it.
    whole = materialise(rows.withColumn("_id", F.monotonically_increasing_id()))
    at = whole.select("_id", "features", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("treeID"), F.lit(0).alias("node"))
    for level in range(depth + 1):
        here = at.join(table, ["treeID", "node"])
        value = F.get("features", F.col("feature_index"))
        goes_left = F.when(F.col("num_categories") >= 0, F.array_contains("split_values", value)).otherwise(value <= F.get("split_values", 0))
        leaf = F.col("left") < 0
        at = here.select("_id", "features", "treeID", F.when(leaf, F.col("node")).when(goes_left, F.col("left")).otherwise(F.col("right")).alias("node"),
                         *([F.when(leaf, F.col("class_weights")).alias("at_leaf")] if level == depth else []))
    total = F.aggregate("at_leaf", F.lit(0.0), lambda a, x: a + x)
    shares = at.select("_id", "treeID", F.transform("at_leaf", lambda x: F.when(total != 0, x / total).otherwise(0.0)).alias("shares"))
    votes = shares.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("treeID", "shares"))).alias("v"))
    zero = F.array_repeat(F.lit(0.0), len(labels))
    votes = votes.select("_id", F.aggregate("v", zero, lambda a, t: F.zip_with(a, t["shares"], lambda x, y: x + y)).alias("votes"))
    winner = F.get(F.array(*[F.lit(x) for x in labels]), (F.array_position("votes", F.array_max("votes")) - 1).cast("int"))
    return whole.join(votes, "_id").select(*keys, "votes", winner.alias("predictedExit"))


def importances_by_nodes(nodes: DataFrame, names: list[str]) -> DataFrame:
    """M10 from the node table: gain x rows of every split, per feature, as shares of the tree; the forest (tree -1) is the
    mean of the trees that split at all, as shares again.  In percent, also for features that split nothing."""
    rows = F.aggregate("class_weights", F.lit(0.0), lambda a, x: a + x)
    split = nodes.where(F.col("left") >= 0).groupBy("treeID", "feature_index").agg(F.sum(F.col("gain") * rows).alias("s"))
    shares = split.withColumn("share", F.col("s") / F.sum("s").over(Window.partitionBy("treeID")))
    forest_ = shares.groupBy("feature_index").agg(F.sum("share").alias("s"))
    forest_ = forest_.select(F.lit(-1).alias("tree"), "feature_index", (F.col("s") / F.sum("s").over(Window.partitionBy())).alias("share"))
    every = forest_.unionByName(shares.select(F.col("treeID").alias("tree"), "feature_index", "share"))
    trees = nodes.select(F.col("treeID").alias("tree")).distinct().unionByName(nodes.sparkSession.createDataFrame([(-1,)], "tree int"))
    listed = F.array(*[F.struct(F.lit(k).alias("feature_index"), F.lit(n).alias("feature")) for k, n in enumerate(names)])
    full = trees.select("tree", F.inline(listed)).join(every, ["tree", "feature_index"], "left")
    return full.select("tree", "feature", (F.coalesce("share", F.lit(0.0)) * 100).alias("importance"))


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Any number of feature rows with ``predictedExit``, every row kept as it is.

    A row with a category that the model doesn't know, or without a feature, has a NULL prediction; nothing is joined, so
    repeated rows stay as many as they are.
    """
    stages, known = [], F.lit(True)
    for s in model.stages:
        if isinstance(s, StringIndexerModel):
            if s.getInputCol() == "exit":
                continue
            known = known & F.col(s.getInputCol()).isNotNull() & (F.col(s.getOutputCol()) < len(s.labels))
            s = s.copy({s.handleInvalid: "keep"})
        elif isinstance(s, VectorAssembler):
            for c in s.getInputCols():
                if not c.endswith("_idx"):
                    known = known & F.col(c).isNotNull()
            s = s.copy({s.handleInvalid: "keep"})
        stages.append(s)
    scored = PipelineModel(stages=stages).transform(df.drop("predictedExit"))
    keep = [c for c in df.columns if c != "predictedExit"]
    return scored.select(*keep, F.when(known, F.col("predictedExit")).alias("predictedExit"))


def fold_of(key: str, folds: int, seed: int) -> F.Column:
    """0 to folds-1 by a digest of the row's key, so a row is in the same fold under any partitioning."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(f"fold{seed}")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % folds).cast("int")


def tune_folds(train: DataFrame, features: list[str], trees=TUNE_TREES, depth: int = TUNE_DEPTH, folds: int = TUNE_FOLDS,
               key: str = "flight_id", at_once: int = 4) -> DataFrame:
    """M8: (num_trees, max_depth, fold, n_held_out, n_correct, accuracy) of every grid point and fold.

    Rows are indexed, assembled and given their fold once, in one cached table.  The forests of all fits are grown side by side
    (``forest_fit``); they are those that the estimators would fit.  What that leaves to Spark ML (no rows, one class, more categories
    than bins) is fitted by it, ``at_once`` side by side.
    """
    from concurrent.futures import ThreadPoolExecutor
    base = fit_pipeline(train, train, features, trees[0], depth, forest_too=False)
    rows = base.transform(train).select("features", "label", fold_of(key, folds, FOREST_SEED).alias("fold")).cache()

    def estimator(n_trees: int) -> RandomForestClassifier:
        return RandomForestClassifier(labelCol="label", featuresCol="features", impurity=FOREST_IMPURITY,
                                      featureSubsetStrategy=FOREST_SUBSET, subsamplingRate=FOREST_SUBSAMPLING,
                                      maxBins=FOREST_MAX_BINS, numTrees=n_trees, maxDepth=depth, seed=FOREST_SEED,
                                      maxMemoryInMB=TUNE_MEMORY_MB, cacheNodeIds=True)

    def alone(fit: tuple[RandomForestClassifier, int]) -> tuple:
        rf, fold = fit
        fitted = rf.fit(rows.where(F.col("fold") != fold))
        n, right = fitted.transform(rows.where(F.col("fold") == fold)) \
            .agg(F.count(F.lit(1)), F.count_if(F.col("prediction") == F.col("label"))).first()
        return rf.getNumTrees(), fold, n, right

    filled = {r["fold"] for r in rows.select("fold").distinct().collect()}  # at most ``folds`` numbers
    fits = [(estimator(n), k) for n in trees for k in range(folds) if filled != {k}]  # a fold with all rows leaves none to learn from
    forests = forest_fit.grow(rows, fits)
    if forests is not None:
        counted = forest_fit.held_out(rows, forests)
    else:
        with ThreadPoolExecutor(at_once) as pool:
            counted = list(pool.map(alone, fits))
    found = [(n_trees, depth, fold, n, right, right / n if n else None) for n_trees, fold, n, right in counted]
    rows.unpersist()
    return train.sparkSession.createDataFrame(found, "num_trees int, max_depth int, fold int, n_held_out long, n_correct long, accuracy double")


def best_params(by_fold: DataFrame) -> DataFrame:
    """Mean accuracy of each grid point over its folds; the best is flagged (ties: fewer trees)."""
    means = by_fold.groupBy("num_trees", "max_depth").agg(F.avg("accuracy").alias("mean_accuracy"))
    first = Window.orderBy(F.desc("mean_accuracy"), "num_trees", "max_depth")  # a row per grid point
    return means.withColumn("best", F.row_number().over(first) == 1)


def tune(train: DataFrame, features: list[str], trees=TUNE_TREES, depth: int = TUNE_DEPTH, folds: int = TUNE_FOLDS) -> DataFrame:
    """M8 + A9: k-fold cross-validation over numTrees, accuracy metric; best row flagged."""
    return best_params(tune_folds(train, features, trees, depth, folds))


def split_counts(train: DataFrame, test: DataFrame) -> DataFrame:
    """A4: training / test / total row counts in one job."""
    both = train.select(F.lit("train").alias("part")).unionByName(test.select(F.lit("test").alias("part")))
    return both.rollup("part").count().select(F.coalesce("part", F.lit("total")).alias("part"), "count")


def index_categories(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """M3 as a table: every value of the fitted indexers with its index (frequency descending, then value)."""
    rows = [(s.getInputCol(), v, k) for s in model.stages if isinstance(s, StringIndexerModel) and s.getInputCol() != "exit"
            for k, v in enumerate(s.labels)]
    return spark.createDataFrame(rows, "feature string, value string, index long")
