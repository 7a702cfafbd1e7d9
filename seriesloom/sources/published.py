"""Versions of a table behind one manifest: readers see the old version or the new one, never a part.

Data goes to a folder of its own, then a manifest that names it is renamed over
the one before; that rename is the only step that readers notice.  What was
current before goes to ``superseded`` first, so earlier versions stay readable.
A job that dies between the steps leaves the old version in place and, at worst,
an unnamed folder of data.  A name may be guarded: settings other than those it
was published with first are refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFEST, SUPERSEDED, DATA = "MANIFEST.json", "superseded", "data"


class Store:
    """The file system of a path, through Hadoop, so any store that Spark writes to works."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> dict | None:
        if not self.fs.exists(self.path(name)):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def write(self, name: str, value: dict) -> None:
        """As a whole: under another name first, then renamed over what is there."""
        hidden = f".{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(hidden), True)
        try:
            stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        finally:
            stream.close()
        self.fs.mkdirs(self.path(name).getParent())
        rename = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        rename[0] = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        self.context.rename(self.path(hidden), self.path(name), rename)


def publish(df: DataFrame, root: str, settings: dict | None = None, before_swap=None) -> int:
    """Writes ``df`` as the next version under ``root`` and makes it the current one; gives its number.

    ``settings`` must equal those of the version before it, if that has any.  ``before_swap`` runs when all data is
    written and the manifest is not, for tests.
    """
    store = Store(df.sparkSession, root)
    now = store.read(MANIFEST)
    if now and now["settings"] is not None and settings != now["settings"]:
        raise ValueError(f"{root} was published with other settings: {now['settings']}")
    name = f"{DATA}/{uuid.uuid4().hex}"
    df.write.parquet(f"{store.root}/{name}")
    if before_swap:
        before_swap()
    version = now["version"] + 1 if now else 1
    if now:
        store.write(f"{SUPERSEDED}/{now['version']}.json", now)
    store.write(MANIFEST, {"version": version, "data": name, "settings": settings, "schema": df.schema.jsonValue()})
    return version


def published(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The current version, or an earlier one by its number."""
    from pyspark.sql.types import StructType

    store = Store(spark, root)
    now = store.read(MANIFEST)
    found = now if now and version in (None, now["version"]) else store.read(f"{SUPERSEDED}/{version}.json")
    if not found:
        raise ValueError(f"no version {version or ''} under {root}")
    return spark.read.schema(StructType.fromJson(found["schema"])).parquet(f"{store.root}/{found['data']}")
