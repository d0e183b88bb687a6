"""Reading tables, cutting lineage in the shared folder, and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: Largest side that is broadcast, by the estimated bytes of its rows, arrays and strings included; beyond it the join shuffles.
BROADCAST_BYTES = 4 << 20
#: Bytes of texts that go to a Python worker at once, where the session doesn't say otherwise.
BATCH_BYTES = "2m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``; one of our own only where that is unset in one local process (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    ship_package(spark)
    return where


def prepare(spark: SparkSession) -> None:
    """What a registered query or a stage sets up: the shared folder, and batches for Python workers bounded by bytes."""
    shared_dir(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, besides any --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/saltmarsh-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _bytes_of(value: Column, kind: DataType) -> Column:
    """About how many bytes a value takes in a row."""
    if isinstance(kind, (StringType, BinaryType)):
        own = F.octet_length(value) + 16
    elif isinstance(kind, StructType):
        own = sum((_bytes_of(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    elif isinstance(kind, ArrayType):
        own = F.aggregate(value, F.lit(24).cast("long"), lambda n, x: n + _bytes_of(x, kind.elementType))
    else:
        own = F.lit(8)
    return F.coalesce(own.cast("long"), F.lit(8))


def sized(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a written table for broadcast if its rows take ``limit`` bytes at most; otherwise Spark shuffles it."""
    total = df.agg(F.sum(F.lit(24) + sum((_bytes_of(F.col(f.name), f.dataType) for f in df.schema.fields), F.lit(0)))).first()[0]
    return F.broadcast(df) if (total or 0) <= limit else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
