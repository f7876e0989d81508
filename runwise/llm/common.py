"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from runwise import session

# Rows of one Arrow batch.  Texts may be 100 kB and more, so a batch stays small.
ARROW_ROWS = "1000"


def prepare(spark: SparkSession) -> None:
    session.prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The given table with only the named columns, whatever others it has."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder name below the cluster's shared checkpoint folder."""
    return f"{session.ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends here."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``written`` made, once what was computed from them is written itself."""
    for df in frames:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


# Tables that a Python worker keeps between tasks, of one operator at a time.
_KEPT: dict = {}


def kept_by_worker(operator: str, key, make: Callable):
    """What ``make`` returns, made once per worker process and dropped when another operator's task comes."""
    make_room(operator)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def make_room(operator: str) -> None:
    """Drop what tasks of other operators left in this worker: workers are used again, memory is bounded."""
    if _KEPT.get("operator") != operator:
        import gc

        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _KEPT["operator"] = operator


def map_texts(df: DataFrame, make: Callable, out: str, keep: list[str], text: str = "text") -> DataFrame:
    """Row-wise operator over whole texts in Arrow batches.

    ``make()`` runs once per task and returns a function from the list of texts of a
    batch (None for null) to the output columns, in the order of the DDL ``out``.  The
    columns in ``keep`` pass through untouched, so null and large keys stay exact.
    """
    added = T.StructType.fromDDL(out)
    schema = T.StructType([df.schema[c] for c in keep] + added.fields)
    arrow = [_arrow_type(f.dataType) for f in added.fields]
    names = schema.names

    operator = make.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(operator)
        apply = make()
        for batch in batches:
            cols = apply(batch.column(text).to_pylist())
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(c, t) for c, t in zip(cols, arrow)], names)

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def map_batches(df: DataFrame, make: Callable, out: str, keep: list[str], reads: list[str]) -> DataFrame:
    """Row-wise operator over Arrow batches: the kept columns untouched, then the columns of the DDL ``out``.

    ``make()`` runs once per task and returns a function from a batch to those columns, one value per row.
    """
    added = T.StructType.fromDDL(out)
    schema = T.StructType([df.schema[c] for c in keep] + added.fields)
    arrow = [_arrow_type(f.dataType) for f in added.fields]
    names = schema.names
    operator = make.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(operator)
        apply = make()
        for batch in batches:
            cols = list(apply(batch)) if batch.num_rows else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(c, t) for c, t in zip(cols, arrow)], names)

    return df.select(*dict.fromkeys([*keep, *reads])).mapInArrow(run, schema)


def _arrow_type(t: T.DataType) -> pa.DataType:
    simple = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(),
              "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow_type(t.elementType))
    if isinstance(t, T.StructType):
        return pa.struct([(f.name, _arrow_type(f.dataType)) for f in t.fields])
    return simple[t.simpleString()]


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of frames that nothing refers to any more.

    The cleaner acts when the driver collects garbage; after a step whose result is written,
    its shuffles are of no use, and on large inputs they are most of the disk in use.
    """
    import gc
    import time

    for _ in range(2):  # the first collection frees what holds the shuffles, the second the shuffles
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
