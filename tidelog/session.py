"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Results depend on these: days and minutes are cut in UTC, and a repeated JSON
# key keeps its last value instead of making the document unreadable.
REQUIRED_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Checkpoints of frames that are no longer used are removed while the session goes on.
CLEANING = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true"}

_local_scratch: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings every query relies on to an existing session."""
    for key, value in REQUIRED_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "tidelog", master: str | None = None, **settings: str) -> SparkSession:
    """Create a session. Sizing (shuffle partitions, memory) is left to the caller's cluster."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**CLEANING, **REQUIRED_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the duration of one job."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="tidelog-")
        atexit.register(shutil.rmtree, _local_scratch[app], ignore_errors=True)
        context.setCheckpointDir(_local_scratch[app])
    return _local_scratch[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, never reused path below the shared folder."""
    return f"{shared_dir(spark)}/tidelog/{label}-{uuid.uuid4().hex}"


def fresh_path(spark: SparkSession, label: str, key: str) -> str:
    """A path of this application for ``label`` and ``key``; what an earlier call left there is removed."""
    name = f"{label}-{spark.sparkContext.applicationId}-{hashlib.md5(key.encode()).hexdigest()[:12]}"
    path = f"{shared_dir(spark)}/tidelog/{name}"
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return path
