"""Session defaults and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "eventsurv",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with UTC time and AQE on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when nothing is configured (local tests) a folder of our own is
    made.  On a cluster the setting must point at shared storage.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf_dir = tempfile.mkdtemp(prefix="eventsurv-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives the Python files beside this package to the workers, once per
    application, so that tasks find them wherever the job was started."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="eventsurv-code-"), "eventsurv_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(ROOT):
            inside = os.path.relpath(folder, ROOT)
            if inside != "." and inside.split(os.sep)[0] not in ("eventsurv", "llm"):
                continue
            for f in files:
                if f.endswith(".py") and (inside != "." or f == "corpus_pipeline.py"):
                    z.write(os.path.join(folder, f), os.path.normpath(os.path.join(inside, f)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
