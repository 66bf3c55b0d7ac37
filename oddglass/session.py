"""Session settings and lineage cutting."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app: str = "oddglass", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SCRATCH: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder named in ``spark.checkpoint.dir``.

    Where none is named, a folder of this run under the warehouse, which all executors share as
    well; it is removed when the driver ends.  A warehouse on the driver's own disk is shared by
    nobody: on a cluster that stops the run with a message.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    app = sc.applicationId
    if app not in _SCRATCH:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if not sc.master.startswith("local") and (base.startswith("file:") or "://" not in base):
            raise RuntimeError(f"spark.checkpoint.dir is not set and the warehouse {base} is a local folder: name a folder that all executors share")
        _SCRATCH[app] = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _SCRATCH[app])
    return _SCRATCH[app]


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # else the session has ended and cannot reach its storage
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written copy.

    Used where several branches read one expensive aggregate: every branch then
    sees the very same values, also after an executor was lost.
    """
    if getattr(df, "_settled", False):
        return df
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    done = df.checkpoint(eager=True)
    done._settled = True
    return done
