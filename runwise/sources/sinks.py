"""Result sinks and the run registry.

Runs are rows of typed tables partitioned by ``run_id`` under one shared root
folder (e.g. a folder next to ``spark.checkpoint.dir``), never files named by
the driver's clock.  Every writer takes an explicit save mode.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runwise.operators.summary import MEAN_MEASURES, describe
from runwise.session import delete_folder, folder_exists

SAMPLE_COLS = ["flight_id", "aircraftType", "size_class", "optROT", "optTT", "actualROT", "actualTT", "optPath",
               "predPath", "slowV", "totalOptCost", "totalActualCost", "savings", "predictedExit"]


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header, one file per partition of the frame."""
    df.write.mode(mode).option("header", True).csv(path)


def write_summary(costed: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Count / mean / stddev / min / max of the 21 measures as one CSV file."""
    d = describe(costed)
    write_csv(d.coalesce(1), path, mode)  # five rows
    return d


def result_document(costed: DataFrame, samples: DataFrame) -> DataFrame:
    """One row: the 19 means plus up to 50 sample landings, as a JSON text column."""
    means = costed.agg(*[F.avg(c).alias(c) for c in MEAN_MEASURES])
    sample_list = samples.select(F.struct(*[c for c in SAMPLE_COLS if c in samples.columns]).alias("s")) \
        .agg(F.collect_list("s").alias("samples"))  # bounded: the sample is capped
    # both sides hold exactly one row
    doc = means.withColumn("_one", F.lit(1)).join(sample_list.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return doc.select(F.to_json(F.struct(*doc.columns)).alias("result"))


def write_result(doc: DataFrame, path: str, mode: str = "overwrite") -> None:
    doc.coalesce(1).write.mode(mode).text(path)


def read_result(spark: SparkSession, path: str, samples: DataFrame) -> DataFrame:
    """A result file as typed columns: the means, and the samples with the types of ``samples``."""
    cols = [c for c in SAMPLE_COLS if c in samples.columns]
    fields = [T.StructField(c, T.DoubleType()) for c in MEAN_MEASURES]
    fields.append(T.StructField("samples", T.ArrayType(T.StructType([samples.schema[c] for c in cols]))))
    return spark.read.text(path).select(F.from_json("value", T.StructType(fields)).alias("r")).select("r.*")


def _write_part(df: DataFrame, root: str, name: str, run_id: str) -> None:
    """The run's partition of a table; a rerun replaces it and leaves other runs alone."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("run_id").parquet(f"{root}/{name}")


def write_run(run_row: DataFrame, root: str, run_id: str) -> None:
    """The run record."""
    _write_part(run_row.drop("run_id"), root, "runs", run_id)


def write_features(meta: DataFrame, root: str, run_id: str) -> None:
    """Feature metadata of a run."""
    _write_part(meta, root, "features", run_id)


def write_results(costed: DataFrame, samples: DataFrame, root: str, run_id: str) -> None:
    """The result document, and its typed parts: means, samples and the costed landings."""
    _write_part(result_document(costed, samples), root, "documents", run_id)
    _write_part(costed.agg(*[F.avg(c).alias(c) for c in MEAN_MEASURES]), root, "results", run_id)
    _write_part(samples, root, "samples", run_id)
    _write_part(costed, root, "costed", run_id)


def save_model(model: PipelineModel, root: str, run_id: str) -> str:
    """Spark ML writer, one folder per run."""
    path = f"{root}/models/{run_id}"
    model.write().overwrite().save(path)
    return path


def load_model(root: str, run_id: str) -> PipelineModel:
    return PipelineModel.load(f"{root}/models/{run_id}")


RUN_TABLES = ("runs", "features", "results", "samples", "costed", "documents")


def read_run(spark: SparkSession, root: str, run_id: str) -> dict[str, DataFrame]:
    """The artifacts of one run as typed tables (partition pruning on run_id)."""
    return {name: spark.read.parquet(f"{root}/{name}").where(F.col("run_id") == run_id) for name in RUN_TABLES}


def open_run(spark: SparkSession, root: str, run_id: str) -> None:
    """A run that is about to be written (again) is no complete one until ``write_manifest``."""
    delete_folder(spark, f"{root}/manifest/run_id={run_id}")


def contents(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """name, n_rows, digest of every table of a run as it is now; the digest doesn't depend on the order of rows."""
    every = None
    for name, df in read_run(spark, root, run_id).items():
        digest = F.sum(F.xxhash64(*[c for c in df.columns if c != "run_id"]).cast("decimal(38,0)")).cast("string")
        one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(digest, F.lit("0")).alias("digest")) \
            .select(F.lit(name).alias("name"), "n_rows", "digest")
        every = one if every is None else every.unionByName(one)
    return every


def write_manifest(spark: SparkSession, root: str, run_id: str) -> None:
    """Row counts and digests of the run's tables, written last: what a complete run holds."""
    _write_part(contents(spark, root, run_id).coalesce(1), root, "manifest", run_id)  # a row per table


def damaged_tables(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """Tables of a run whose rows aren't those that its manifest lists."""
    said = spark.read.parquet(f"{root}/manifest").where(F.col("run_id") == run_id).drop("run_id")
    return said.join(contents(spark, root, run_id), ["name", "n_rows", "digest"], "left_anti")


def saved_models(spark: SparkSession, root: str) -> DataFrame:
    """Run ids with a saved model, from the model folders' metadata files (contents aren't read)."""
    files = spark.read.format("binaryFile").load(f"{root}/models/*/metadata/part-*").select("path")
    return files.select(F.regexp_extract("path", r"/models/([^/]+)/metadata/", 1).alias("run_id")).distinct()


def list_models(spark: SparkSession, root: str) -> DataFrame:
    """Run ids that have a saved model."""
    return spark.read.parquet(f"{root}/runs").join(saved_models(spark, root), "run_id", "left_semi") \
        .select("run_id", "airport_code").distinct()


def complete_runs(spark: SparkSession, root: str) -> DataFrame:
    """Runs with a manifest whose tables all hold as many rows as it lists, and with a saved model.

    A run that was stopped half-way has no manifest, as that is written last.
    """
    if not folder_exists(spark, f"{root}/manifest"):
        return spark.read.parquet(f"{root}/runs").where("false")
    now = None
    for name in RUN_TABLES:
        one = spark.read.parquet(f"{root}/{name}").groupBy("run_id").agg(F.count(F.lit(1)).alias("n_now")).withColumn("name", F.lit(name))
        now = one if now is None else now.unionByName(one)
    said = spark.read.parquet(f"{root}/manifest").join(now, ["run_id", "name"], "left")
    whole = said.groupBy("run_id").agg(F.bool_and(F.col("n_rows") == F.coalesce("n_now", F.lit(0))).alias("whole"),
                                       F.countDistinct("name").alias("n")).where((F.col("n") == len(RUN_TABLES)) & F.col("whole"))
    runs = spark.read.parquet(f"{root}/runs").join(whole, "run_id", "left_semi")
    return runs.join(saved_models(spark, root), "run_id", "left_semi")
