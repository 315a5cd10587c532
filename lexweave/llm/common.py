"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lexweave.shipping import shipped

#: Where scratch tables go in local mode (tests) if the session names no folder. A cluster has to name one.
LOCAL_SCRATCH = "file:///tmp/checkpoints"

#: Largest Arrow batch handed to a Python worker, so that long texts cannot fill its memory.
BATCH_BYTES = 4 << 20

#: One label in five is held out from every fit.
FOLDS = 5

#: The column that holds a whole input row while an operator adds columns of its own: what the input's columns are called
#: cannot matter then.
ROW = "row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode it may be unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return (named or LOCAL_SCRATCH).rstrip("/")


class Scratch:
    """Tables in the shared folder that are removed once what they serve has been written."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []

    def written(self, df: DataFrame, what: str) -> DataFrame:
        """Write df as Parquet and read it back, which cuts its lineage. The files survive lost executors."""
        path = f"{shared_dir(self.spark)}/scratch-{self.spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def remove(self, *gone: DataFrame) -> None:
        """Remove the files of these tables of this scratch."""
        self._delete(lambda df: any(df is g for g in gone))

    def close(self, *keep: DataFrame) -> None:
        """Remove all that is left but for keep, whose files then stay for those who read them."""
        self._delete(lambda df: not any(df is k for k in keep))

    def _delete(self, goes: Callable[[DataFrame], bool]) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df, path in self.tables:
            if goes(df):
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(conf).delete(where, True)
        self.tables = [(df, path) for df, path in self.tables if not goes(df)]


def written(df: DataFrame, what: str) -> DataFrame:
    """A scratch table that stays as long as its reader needs it: the application's folder can be removed at its end."""
    return Scratch(df.sparkSession).written(df, what)


def given_back() -> None:
    """Give free memory of this process back to the system: idle workers stay alive beside those that work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with batches bounded in bytes; function turns an iterator of batches into another. What a task has gathered
    is given back at its end."""
    shipped(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        given_back()

    return df.mapInArrow(run, schema)


def whole_row(df: DataFrame) -> Column:
    """The columns of df as one struct named ROW."""
    return F.struct(*(F.col(quoted(c)) for c in df.columns)).alias(ROW)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def row_field(df: DataFrame) -> StructField:
    return StructField(ROW, StructType(df.schema.fields), False)


def field_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column of the input rows in a batch with ROW."""
    rows = batch.column(ROW)
    return rows.field(rows.type.get_field_index(name))


def held_out(doc_id: Column | str) -> Column:
    """True for the fold that no fit sees: crc32 of the id as text, modulo 5, is 0. A null id is held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label int) of the rows a fit may learn from: label 0 or 1, id not held out."""
    return labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out("doc_id"))
