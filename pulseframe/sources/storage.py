"""Folders that all executors share, atomic commits in whatever store they are, and batches that count once."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where the setting is absent in a local session (as in tests) a temporary
    folder of this machine serves, and goes when Python ends. On a cluster, where
    executors would each write to their own disks, an absent setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="pulseframe-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return _own["dir"]


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the session ends, if not before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at, store = _place(spark, path)
    store.deleteOnExit(at)
    return path


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete folders, in whatever store they are."""
    for path in paths:
        at, store = _place(spark, path)
        store.delete(at, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written once in the shared folder: what reads it more than once doesn't compute it again, and it survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at, store = _place(spark, path)
    return store.exists(at)


def commit_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a small text at path in one step: readers see the former one or this one, and never a part."""
    at, store = _place(spark, path)
    store.mkdirs(at.getParent())
    ahead, _ = _place(spark, f"{at.getParent().toString()}/.{at.getName()}-{uuid.uuid4().hex}")
    out = store.create(ahead, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(store.makeQualified(ahead), store.makeQualified(at), options)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text, or None where there is none; read by Spark, in whatever store it is."""
    return spark.read.text(path, wholetext=True).first().value if exists(spark, path) else None


class Snapshots:
    """Versions of a table in one folder, each under a key: data first, under a new name, then a manifest that names it.

    Readers follow the manifest alone, so a writer that is killed leaves what was there before, and
    readers that began with the former version can finish.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _manifest(self, key: str) -> str:
        return f"{self.root}/{key}.manifest.json"

    def write(self, df: DataFrame, key: str, manifest: dict, by: tuple[str, ...] = ()) -> None:
        data = f"{self.root}/{key}-{uuid.uuid4().hex}"
        df.write.partitionBy(*by).parquet(data)
        commit_text(self.spark, self._manifest(key), json.dumps({**manifest, "data": data.rpartition("/")[2], "schema": df.schema.jsonValue()}, sort_keys=True))

    def manifest(self, key: str) -> dict | None:
        text = read_text(self.spark, self._manifest(key))
        return None if text is None else json.loads(text)

    def read(self, key: str) -> DataFrame:
        manifest = self.manifest(key)
        if manifest is None:
            raise FileNotFoundError(f"no snapshot {key} in {self.root}")
        return self.spark.read.schema(StructType.fromJson(manifest["schema"])).parquet(f"{self.root}/{manifest['data']}")


class EpochSink:
    """A sink whose batches count once: a batch goes to a folder of its number, which a repeated batch replaces, and counts when its marker is there.

    For foreachBatch: a batch that Spark runs again after a failure has the same number and the same rows.
    """

    def __init__(self, spark: SparkSession, root: str, kind: str = "parquet"):
        self.spark, self.root, self.kind = spark, root.rstrip("/"), kind

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        if exists(self.spark, f"{self.root}/committed/{epoch}"):
            return
        batch.write.mode("overwrite").format(self.kind).save(f"{self.root}/data/epoch={epoch}")
        commit_text(self.spark, f"{self.root}/committed/{epoch}", batch.schema.json())

    def epochs(self) -> list[int]:
        """Numbers of the batches that count."""
        at, store = _place(self.spark, f"{self.root}/committed")
        return sorted(int(f.getPath().getName()) for f in store.listStatus(at) if f.getPath().getName().isdigit()) if store.exists(at) else []

    def read(self, schema) -> DataFrame:
        """All batches that count, and no row of others."""
        done = [f"{self.root}/data/epoch={e}" for e in self.epochs()]
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/data").format(self.kind).load(done).drop("epoch")

