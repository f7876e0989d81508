"""F3 run_analysis and F4 inspect_run: the user-level entry points."""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import DataFrame, SparkSession

from runwise.constants import ALL_FEATURES, FOREST_DEPTHS, FOREST_TREES, SAMPLE_CAP
from runwise.operators import model as M
from runwise.operators import summary as S
from runwise.operators.network import NetworkIndex
from runwise.operators.overlay import node_overlay, path_overlay
from runwise.plans.optimise import optimise
from runwise.plans.prepare import prepare_landings
from runwise.session import materialise
from runwise.sources import sinks


def run_analysis(spark: SparkSession, flights: DataFrame, nodes: DataFrame, edges: DataFrame, sizes: DataFrame,
                 code: str, root: str, run_id: str, features: list[str] | None = None,
                 trees: int = FOREST_TREES[0], depth: int = FOREST_DEPTHS[0], split_mode: str = "hash",
                 stop: str = "first_touch") -> dict[str, DataFrame]:
    """F1 -> M1-M7 -> F2 (test split) -> S7-S11, the manifest last.  Returns the result DataFrames.

    Paths that earlier runs of the same root solved on the same network aren't solved again."""
    started = time.time()
    sinks.open_run(spark, root, run_id)
    features = list(features or ALL_FEATURES)
    prepared = materialise(prepare_landings(flights, edges, code, features))
    train, test = M.split(prepared, mode=split_mode)
    model = M.fit_pipeline(prepared, train, features, trees, depth)
    acc = M.accuracy(model, test).first()
    predictions = M.predict(model, test)
    costed = materialise(optimise(predictions, nodes, edges, sizes, code, stop=stop, net=NetworkIndex(nodes, edges),
                                  store=f"{root}/paths"))
    summary = sinks.write_summary(costed, f"{root}/summaries/{run_id}")
    sample = S.top_sample(costed, SAMPLE_CAP)
    doc = sinks.result_document(costed, sample)
    sinks.write_results(costed, sample, root, run_id)
    meta = M.feature_metadata(spark, model)
    sinks.write_features(meta, root, run_id)
    sinks.save_model(model, root, run_id)
    stats = S.distinct_counts(prepared).first()
    counts = {r["part"]: r["count"] for r in M.split_counts(train, test).collect()}
    run = spark.createDataFrame(
        [(run_id, code, float(acc["accuracy"] or 0.0), int(stats["num_runways"]), int(stats["num_exits"]),
          int(counts.get("train", 0)), int(counts.get("test", 0)), int((time.time() - started) * 1000),
          dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S"))],
        "run_id string, airport_code string, accuracy double, num_runways long, num_exits long, train_count long, "
        "test_count long, run_duration_ms long, date string")
    sinks.write_run(run, root, run_id)
    sinks.write_manifest(spark, root, run_id)
    return {"prepared": prepared, "predictions": predictions, "costed": costed, "summary": summary,
            "result": doc, "features": meta, "run": run}


def inspect_run(spark: SparkSession, root: str, run_id: str, nodes: DataFrame | None = None,
                edges: DataFrame | None = None) -> dict[str, DataFrame]:
    """run artifacts, forest nodes with readable conditions, importances, the impact tables and,
    given the network, the path and node overlay of the samples."""
    arts = sinks.read_run(spark, root, run_id)
    model = sinks.load_model(root, run_id)
    tree = M.forest_nodes(spark, model, f"{root}/forests/{run_id}")
    arts["nodes"] = M.node_condition(spark, tree, model)
    arts["max_depth"] = M.forest_depth(tree)
    arts["importances"] = M.importances(spark, model)
    costed = arts["costed"]
    arts["impact_societal"] = S.impact_societal(costed)
    arts["impact_airline"] = S.impact_airline(costed)
    arts["time_reduction"] = S.time_reduction(costed)
    if nodes is not None and edges is not None:
        arts["path_overlay"] = path_overlay(costed, nodes, edges)
        arts["node_overlay"] = node_overlay(costed, nodes)
    return arts
