import importlib.util
import os

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_and_registry(spark):
    mod = _entry()
    df = mod.entry(spark)
    assert df.count() == 49 and "exit" in df.columns  # from packed text, without other airports and "null" types
    q, o = mod.queries(), mod.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 110


def _canon(rows, cols):
    idx = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(round(r[i], 9)) if isinstance(r[i], float) else repr(r[i]) for i in idx) for r in rows)


def test_oracles_agree_on_cheap_queries(spark, sf):
    mod = _entry()
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    q, o = mod.queries(), mod.oracle_sql()
    for name in ["prepare_landings", "label_real_exit", "scan_links", "is_exit_link", "scan_flights", "decel", "traffic", "label_exit_geofence", "min_items", "den_link_patch",
                 "labelled_only", "train_test_split", "index_categories", "sink_df_csv",
                 "vincenty_m", "airport_code", "size_class_join"]:
        sdf = q[name](spark, sf)
        rel = con.sql(o[name])
        assert sorted(sdf.columns) == sorted(rel.columns), name
        assert _canon([tuple(r) for r in sdf.collect()], sdf.columns) == _canon(rel.fetchall(), rel.columns), name


def test_run_analysis_and_registry(spark, sf):
    from runwise.plans import catalog
    from runwise.session import delete_folder
    from runwise.sources import sinks
    run = catalog.q_run_analysis(spark, sf).first()
    assert run.airport_code == "KPHX" and run.train_count + run.test_count == 71 and 0 <= run.accuracy <= 100
    results = {r["result"]: r["n_rows"] for r in catalog.q_inspect_run(spark, sf).collect()}
    assert {"nodes", "importances", "max_depth", "impact_societal", "impact_airline", "time_reduction", "path_overlay", "node_overlay"} <= set(results)
    assert all(n > 0 for n in results.values())
    root = catalog._run_root(spark, sf)
    assert [r["run_id"] for r in catalog.q_complete_runs(spark, sf).collect()] == [catalog.RUN_ID]
    assert sinks.damaged_tables(spark, root, catalog.RUN_ID).count() == 0
    # A run stopped half-way has everything but the manifest, or a table less than it lists: neither is listed.
    for name in ("runs", "features", "results", "samples", "costed", "documents"):
        part = spark.read.parquet(f"{root}/{name}").where(f"run_id = '{catalog.RUN_ID}'").drop("run_id")
        sinks._write_part(part, root, name, "stopped")
    sinks.save_model(sinks.load_model(root, catalog.RUN_ID), root, "stopped")
    assert [r["run_id"] for r in sinks.complete_runs(spark, root).collect()] == [catalog.RUN_ID]
    sinks.write_manifest(spark, root, "stopped")
    assert sorted(r["run_id"] for r in sinks.complete_runs(spark, root).collect()) == [catalog.RUN_ID, "stopped"]
    delete_folder(spark, f"{root}/samples/run_id=stopped")
    assert [r["run_id"] for r in sinks.complete_runs(spark, root).collect()] == [catalog.RUN_ID]
    assert [r["name"] for r in sinks.damaged_tables(spark, root, "stopped").collect()] == ["samples"]
