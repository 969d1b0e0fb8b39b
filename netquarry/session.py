"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a job of this package wants.  Everything here may be set at run time, so they can also be
# applied to a session somebody else built.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even where that costs a further shuffle behind the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A task writes the days and classes of a dump side by side, and sorts its rows only if there are more.
    "spark.sql.maxConcurrentOutputFileWriters": "8",
}


def build_session(master: str | None = None, app: str = "netquarry", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to an existing session, but for those its owner has set."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


# Work folders handed out in this process, by application.
_HANDED_OUT: dict[str, list[str]] = {}


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only a local session without that setting falls back to the machine's temporary folder; on a
    cluster the setting is required, since other machines could not see a local folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="netquarry-")
    path = f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _HANDED_OUT.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_work(spark: SparkSession) -> int:
    """Delete the work folders handed out to this application; returns how many there were.

    For the end of a run, when what it made has been delivered: frames that read from these folders, such as
    shared views, cannot be read any more.
    """
    paths = _HANDED_OUT.pop(spark.sparkContext.applicationId, [])
    found = 0
    for text in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(text)
        found += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return found


def resolved(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared work folder and read it back.

    What several plans read is computed once, and the planner knows the size of the file: it broadcasts
    a small side of a join without having to guess.
    """
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
