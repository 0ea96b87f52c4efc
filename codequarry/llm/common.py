"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import uuid
from functools import reduce

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from codequarry.session import shared_folder


TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


def struct_of(**types: str) -> T.StructType:
    """A struct type without a session (``array<...>`` of a simple type is known too)."""
    known = TYPES | {f"array<{k}>": T.ArrayType(v) for k, v in TYPES.items()}
    return T.StructType([T.StructField(k, known[v]) for k, v in types.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def newest(df: DataFrame, keys: list[str], by: str, tie: list[str] | None = None) -> DataFrame:
    """One row for each key: the newest ``by`` (null is oldest), ties going to the least hash of the
    other columns (or of ``tie``), so that the result doesn't depend on the order of rows.  Rows with a null key
    form a key of their own."""
    others = tie or [c for c in df.columns if c not in {*keys, by}]
    rank = Window.partitionBy(*keys).orderBy(F.col(by).desc_nulls_last(), F.xxhash64(*others) if others else F.lit(0))
    return df.withColumn("_newest", F.row_number().over(rank)).where("_newest = 1").drop("_newest")


def columns_or_null(df: DataFrame, **types: str) -> DataFrame:
    """Exactly the named columns, null where the table lacks one; extra columns are left behind."""
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.col(f"`{c}`").cast(t) if c.lower() in have else F.lit(None).cast(t)).alias(c) for c, t in types.items()])


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint of a small or row-wise read table (Spark removes its files with
    ``spark.cleaner.referenceTracking.cleanCheckpoints``, which ``session()`` sets)."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[str] = []


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet beside the checkpoints and read again: lineage is cut, columns are read one by
    one and, with ``by``, so are the parts of a low-cardinality column.  What was shuffled for it is removed as soon as it
    is written; ``release()`` removes the files."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    path = f"{folder if ':/' in folder else 'file://' + folder}/table-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # else shuffle files stay until the driver happens to collect its garbage
    try:
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a ``stored()`` table that nothing reads any more."""
    names = {part for file in df.inputFiles() for part in file.split("/") if part.startswith("table-")}
    for path in [p for p in _written if p.rpartition("/")[2] in names]:
        _written.remove(path)
        files, folder = pyarrow.fs.FileSystem.from_uri(path)
        files.delete_dir(folder)


def release() -> None:
    """Removes the tables of ``stored()``; results that still read them can't be read afterwards."""
    while _written:
        files, path = pyarrow.fs.FileSystem.from_uri(_written.pop())
        files.delete_dir(path)


@atexit.register
def _release_at_exit() -> None:
    try:
        release()
    except (OSError, ValueError, NotImplementedError):  # removed before, or of a file system that only Spark can reach
        pass
