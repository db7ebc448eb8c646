"""Session defaults, and a folder that all executors share."""

from __future__ import annotations

import atexit
import json
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def builder(name: str = "tidemark") -> SparkSession.Builder:
    """UTC, ANSI and adaptive plans; everything else is the cluster's business."""
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return SparkSession.builder.appName(name).config(map=conf)


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{root}:{env['PYTHONPATH']}" if env.get("PYTHONPATH") else root


def shared_dir(spark: SparkSession) -> str:
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "tidemark-shared")
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it is deleted when the driver exits."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_drop_all)
    _MADE.append((spark, path))
    return path


def _drop_all() -> None:
    for spark, path in _MADE:
        try:
            Store(spark).delete(path)
        except Exception:  # the session is gone already; the shared folder belongs to the cluster
            return


class Store:
    """Small metadata work on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark._jvm
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def read_json(self, path: str):
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write_json(self, path: str, value) -> None:
        """Create a file; it must not be there, so of two writers one fails."""
        fs, p = self._at(path)
        stream = fs.create(p, False)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
