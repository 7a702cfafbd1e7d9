"""Helpers that the operators share: shared storage, worker state, byte views of texts."""

from __future__ import annotations

import re
import sys
import types
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset on a local master, one beside the session's warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/seriesloom-shared"


def small_batches(spark: SparkSession) -> None:
    """Batches of long texts to and from Python in 8 MB steps where the session has Spark's own 64 MB: a worker holds a few copies of one."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in ("67108864b", "67108864", "64MB"):
        spark.conf.set(key, "8m")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage ends there, and a lost executor costs no rerun."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a materialised table that no later plan reads."""
    if path := getattr(df, "_loom_path", None):
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores before it as keep it apart from the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def worker_state(name: object) -> dict:
    """A dict that lives as long as the Python worker process, whatever way the caller was pickled."""
    module = sys.modules.setdefault("_seriesloom_worker", types.ModuleType("_seriesloom_worker"))
    return module.__dict__.setdefault("state", {}).setdefault(name, {})


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b or b"" for b in column.cast(kind).to_pylist()]


#: ASCII white space.
SPACE = re.compile(rb"[ \t-\r]")


def word_blocks(text: bytes, size: int = 1 << 20):
    """``text`` in blocks of about ``size`` bytes that cut no word; a longer word stays whole."""
    a = 0
    while a + size < len(text):
        found = SPACE.search(text, a + size)
        if not found:
            break
        yield text[a : found.start()]
        a = found.start()
    yield text[a:] if a else text


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than the cluster has cores is dealt out; a large one is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def join_counted(rows: DataFrame, table: DataFrame, key: str, n: str, share: int = 1000) -> DataFrame:
    """``rows`` joined to ``table`` (a row per key, with ``n`` its rows in ``rows``): keys of a ``share``-th of all rows or more, no more than ``share`` of them, are broadcast, so none lands in one task."""
    total = table.agg(F.sum(n)).first()[0] or 0
    heavy = F.broadcast(table.where(F.col(n) * share >= total))
    rest = rows.join(heavy.select(key), key, "left_anti").join(table.where(F.col(n) * share < total), key)
    return rows.join(heavy, key).unionByName(rest)
