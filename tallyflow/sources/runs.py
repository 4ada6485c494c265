"""Stored state as folders that runs commit (SNK2-SNK4): a run counts once, a half-written one not at all."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Runs:
    """Folders under ``root``, and one empty marker per committed run.

    A run writes a fresh folder and then creates a marker whose name holds the run's id and the
    folder's. A folder without a marker is never read, so a writer that dies half-way leaves
    nothing behind that counts, and running it again writes another folder. Of two writers
    that commit one id, the folder first in name counts, for every reader alike.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _file_system(self, path: str):
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jvm_path, jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    @staticmethod
    def name(run: str) -> str:
        """The id as it stands in file names; others by their hash."""
        return run if re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", run) else hashlib.sha1(run.encode()).hexdigest()

    def committed(self, prefix: str = "") -> dict[str, str]:
        """Folder by run, from one listing."""
        pattern, system = self._file_system(f"{self.root}/_runs/{prefix}*@*")
        found: dict[str, str] = {}
        for status in system.globStatus(pattern) or []:
            run, folder = status.getPath().getName().rsplit("@", 1)
            found[run] = min(folder, found.get(run, folder))
        return {run: f"{self.root}/data/{folder}" for run, folder in sorted(found.items())}

    def fresh(self) -> str:
        return f"{self.root}/data/{uuid.uuid4().hex}"

    def mark(self, run: str, folder: str) -> None:
        marker, system = self._file_system(f"{self.root}/_runs/{self.name(run)}@{folder.rsplit('/', 1)[1]}")
        system.create(marker).close()

    def append(self, run: str, rows: DataFrame) -> bool:
        """Adds the rows of a run; False, without reading them, if it is committed already."""
        if self.name(run) in self.committed():
            return False
        folder = self.fresh()
        rows.write.parquet(folder)
        self.mark(run, folder)
        return True

    def read(self, schema: StructType | str, folders: Iterable[str] | None = None) -> DataFrame:
        """The rows of all committed runs, or of some folders; columns a run lacks are null."""
        paths = list(self.committed().values() if folders is None else folders)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
