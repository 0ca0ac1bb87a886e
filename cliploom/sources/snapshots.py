"""Tables that are replaced as a whole: immutable data folders and numbered manifests.

A snapshot is written to a folder of its own; then a manifest with the next number is created, which names
the folder.  The greatest number is live.  A writer that dies before the manifest leaves the old snapshot live and a folder
that nothing names; two writers cannot create the same number.  Readers take the live manifest once and read its
folder, so what they read does not change while newer ones appear.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share (spark.checkpoint.dir); a temporary one on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{root.rstrip('/')}/cliploom/{name}-{uuid.uuid4().hex}"


class Snapshots:
    def __init__(self, spark: SparkSession, root: str, schema_version: int = 1):
        self.spark, self.root, self.schema_version = spark, root.rstrip("/"), schema_version
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def live(self) -> dict | None:
        """The live manifest: number, data (a folder), tag, schema_version; None without one of this schema version."""
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return None
        numbers = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        numbers = sorted(int(n) for n in numbers if n.isdigit())
        if not numbers:
            return None
        text = self.spark.read.text(f"{self.root}/manifests/{numbers[-1]:012d}", wholetext=True).head()[0]
        manifest = json.loads(text)
        return manifest if manifest["schema_version"] == self.schema_version else None

    def read(self, manifest: dict) -> DataFrame:
        """The rows of one manifest, whatever has been published since."""
        return self.spark.read.parquet(f"{self.root}/{manifest['data']}")

    def stage(self, rows: DataFrame) -> str:
        """Write a data folder that no manifest names yet."""
        name = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}")
        return name

    def publish(self, rows: DataFrame, tag: int = 0) -> dict:
        """Write the rows and make them live."""
        return self.swap(self.stage(rows), tag)

    def swap(self, data: str, tag: int = 0) -> dict:
        """Make a staged folder live; fails if another writer took the number."""
        folder = self._path(f"{self.root}/manifests")
        self._fs.mkdirs(folder)
        taken = [int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit()]
        number = max(taken, default=0) + 1
        manifest = {"number": number, "data": data, "tag": tag, "schema_version": self.schema_version}
        # Written aside and renamed, so that a manifest is whole or absent; an existing number is never replaced.
        aside, target = self._path(f"{self.root}/manifests/_{uuid.uuid4().hex}"), self._path(f"{self.root}/manifests/{number:012d}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            renamed = not self._fs.exists(target) and self._fs.rename(aside, target)
        except Py4JJavaError as error:
            raise RuntimeError(f"manifest {number} could not be created") from error
        if not renamed:
            raise RuntimeError(f"manifest {number} was created by another writer")
        return manifest

    def invalidate(self, paths: DataFrame, key: str = "path") -> DataFrame:
        """Publish the live rows without those of ``paths``; (path, was_there) of every path that was named."""
        live = self.live()
        named = paths.select(key).distinct()
        if live is None:
            return named.selectExpr(key, "false as was_there")
        rows = self.read(live)
        self.publish(rows.join(named, key, "left_anti"), live["tag"])
        return named.join(rows.select(key).distinct().selectExpr(key, "true as was_there"), key, "left").selectExpr(key, "coalesce(was_there, false) as was_there")
