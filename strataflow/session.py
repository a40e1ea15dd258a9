"""Session helpers shared by every job."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "strataflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for (UTC, AQE, skew join, fair shares among jobs that run at once)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.scheduler.mode": "FAIR",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session that names none gets a folder of its own, as in tests. On a cluster the
    driver's disk is no shared folder, so that the setting has to be there.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strataflow-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Seconds between collections of the driver's garbage, and when the last one was.
COLLECT_EVERY, _collected = 10.0, [0.0]


def collect_garbage(spark: SparkSession) -> None:
    """Collect the driver's garbage, every COLLECT_EVERY seconds at most.

    Rounds leave old plans on the driver, and shuffles and checkpoints on disk that go only
    once the driver has found their handles to be garbage, which a driver that holds little
    data seldom looks for.
    """
    if time.monotonic() - _collected[0] >= COLLECT_EVERY:
        spark.sparkContext._jvm.System.gc()
        _collected[0] = time.monotonic()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    collect_garbage(df.sparkSession)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
