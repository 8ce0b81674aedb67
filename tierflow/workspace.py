"""Where a pipeline keeps its data: paths every executor can reach."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

# Folder names of the stored layers.
LAYER_FOLDERS = {"staging": "stg", "standard": "std", "serving": "srv"}
DATA_FOLDER = "data"
CHECKPOINT_FOLDER = "chkpt"

VERSIONS_FOLDER = "versions"

_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster shares between driver and executors.

    It is the one named by ``spark.checkpoint.dir``.  Only a local session,
    where driver and executors are one process, may go without the setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.conf.get("spark.app.id")
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="tierflow-")
        atexit.register(shutil.rmtree, _local_roots[app], ignore_errors=True)
    return _local_roots[app]


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared root, never used before."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    filesystem, location = _filesystem(spark, path)
    return filesystem.exists(location)


def delete_path(spark: SparkSession, path: str) -> None:
    filesystem, location = _filesystem(spark, path)
    filesystem.delete(location, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, none where it does not exist."""
    filesystem, location = _filesystem(spark, path)
    if not filesystem.exists(location):
        return []
    return sorted(status.getPath().getName() for status in filesystem.listStatus(location))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Create or replace a small file."""
    filesystem, location = _filesystem(spark, path)
    out = filesystem.create(location, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None where there is none."""
    filesystem, location = _filesystem(spark, path)
    if not filesystem.exists(location):
        return None
    source = filesystem.open(location)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def _filesystem(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


@dataclass(frozen=True)
class Workspace:
    """Names of everything one pipeline stores, in one place."""

    app: str
    working_dir: str
    storage_format: str = "parquet"

    @property
    def root(self) -> str:
        return f"{self.working_dir.rstrip('/')}/{self.app}"

    @property
    def schema(self) -> str:
        return _quoted(self.app)

    @property
    def tables_dir(self) -> str:
        return f"{self.root}/tables"

    def data_path(self, stage: str, target: str) -> str:
        return f"{self.root}/{LAYER_FOLDERS[stage]}/{DATA_FOLDER}/{target}"

    def checkpoint_path(self, stage: str, target: str, sink: str) -> str:
        """One checkpoint per sink, so two sinks of a task never share offsets."""
        return f"{self.root}/{LAYER_FOLDERS[stage]}/{CHECKPOINT_FOLDER}/{target}/{sink}"

    def inputs_path(self, stage: str, target: str) -> str:
        """Notes what a streaming task reads, so that it goes on with the same."""
        return f"{self.root}/{LAYER_FOLDERS[stage]}/{CHECKPOINT_FOLDER}/{target}/inputs.json"

    def table_versions_path(self, target: str) -> str:
        """Data of a table that is replaced, a folder for each version."""
        return f"{self.root}/{VERSIONS_FOLDER}/{target}"

    def table(self, target: str) -> str:
        return f"{self.schema}.{_quoted(target)}"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
