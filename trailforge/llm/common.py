"""Helpers that the corpus operators share: the shared folder, written tables and Arrow row maps."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's own. Where neither is set, a local
    master gets a new temporary folder, as in tests; a cluster has no folder that all of it sees, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="trailforge-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _place(spark: SparkSession, path: str):
    """The file system and path as Hadoop has them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has yet; what stands there goes when the application ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    fs, at = _place(spark, path)
    fs.deleteOnExit(at)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a table in the shared folder and rereads it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path).withMetadata(df.columns[0], {"path": path})


def discard(df: DataFrame) -> None:
    """Deletes a table that materialize() wrote."""
    path = df.schema.fields[0].metadata.get("path")
    if path:
        fs, at = _place(df.sparkSession, path)
        fs.delete(at, True)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """A name for each stem that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in stems:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[Column]:
    """Every column by its own name, whatever characters that has."""
    return [named(c) for c in df.columns]


def named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@cache
def _libc():
    try:
        trim = ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return None
    return trim


def give_back() -> None:
    """Returns memory that Arrow and the C library hold but don't use to the machine: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    if trim := _libc():
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, giving back memory after every batch it makes and at its end."""

    def tidied(batches: Iterator) -> Iterator:
        for out in run(batches):
            yield out
            del out
            give_back()
        give_back()

    return tidied


def with_columns(df: DataFrame, fn: Callable[..., list], inputs: list[str], fields: list[T.StructField]) -> DataFrame:
    """df and more columns that fn computes from Arrow batches, one pass, one evaluation per row.

    fn takes one Arrow array per input and returns one list or array per field. New names must not be in df.
    """
    names = [*df.columns, *(f.name for f in fields)]
    flat = [f"c{k}" for k in range(len(names))]  # columns may have names that Spark would read as paths
    schema = T.StructType([T.StructField(n, f.dataType, True) for n, f in zip(flat, [*df.schema.fields, *fields], strict=True)])
    kinds = [f.type for f in to_arrow_schema(T.StructType(fields))]
    at = [df.columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(*(batch.column(k) for k in at))
            made = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, k) for x, k in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=flat)

    return df.toDF(*flat[: len(df.columns)]).mapInArrow(tidy(run), schema).toDF(*names)


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind) if kind not in _KINDS else _KINDS[kind], True)


_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "binary": T.BinaryType(), "array<double>": T.ArrayType(T.DoubleType()), "array<long>": T.ArrayType(T.LongType()), "array<string>": T.ArrayType(T.StringType())}
