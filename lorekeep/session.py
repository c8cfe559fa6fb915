"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lorekeep", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; cluster sizing is left to the submitter."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.checkpoint.compress": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's checkpoint folder.

    Only a local session without the setting gets a temporary folder; on a cluster a missing
    setting is an error, because a machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="lorekeep-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def shared_file(uri: str):
    """The Arrow file system of a path below the shared folder, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + unquote(uri.removeprefix("file:")).lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def read_shared(uri: str):
    """An Arrow table from one Parquet file below the shared folder, read by a task."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    if uri.startswith("file:"):
        return pq.read_table("/" + unquote(uri.removeprefix("file:")).lstrip("/"), partitioning=None)
    store, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
    return pq.read_table(path, filesystem=store, partitioning=None)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage reliably, so that the rows and their partitions stay fixed from here on."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[tuple[str, str]] = set()


def ship(spark: SparkSession, *folders: str | Path) -> None:
    """Make Python packages importable in the executors, once per application."""
    application = spark.sparkContext.applicationId
    for folder in map(Path, folders):
        if (application, str(folder)) in _SHIPPED:
            continue
        archive = Path(tempfile.mkdtemp(prefix="lorekeep-")) / f"{folder.name}.zip"
        with zipfile.ZipFile(archive, "w") as packed:
            for source in sorted(folder.rglob("*.py")):
                packed.write(source, source.relative_to(folder.parent))
        spark.sparkContext.addPyFile(str(archive))
        _SHIPPED.add((application, str(folder)))
