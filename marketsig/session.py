"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session built here gets.  AQE re-plans joins and coalesces
# shuffle partitions at runtime; skew-join splitting handles hot tickers in
# the shuffle joins.  UTC keeps `timestamp` arithmetic independent of the host.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Checkpoint files of frames that are no longer referenced are removed.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app: str = "marketsig",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with this library's defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; locally the
    tests use ``local[*]`` with a handful of shuffle partitions.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session (the cluster's shared
    storage).  Only when it is unset -- a local test session -- a scratch folder
    is made and registered so later ``checkpoint()`` calls use it too.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the setting
        if not root:
            raise RuntimeError("set spark.checkpoint.dir on the Spark Connect server") from None
        return root
    if not root:
        root = sc.getCheckpointDir()
    if not root:
        master = sc.master or ""
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="marketsig-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    current = (sc.getCheckpointDir() or "").replace("file:", "", 1)
    if not current.startswith(root.replace("file:", "", 1).rstrip("/")):
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the checkpoint root for one job's output."""
    root = checkpoint_root(spark)
    if root.startswith("file:"):
        root = root[len("file:"):]
    sub = f"{name}-{os.getpid()}-{next(_counter)}-{os.urandom(4).hex()}"
    return os.path.join(root, "marketsig", sub) if "://" not in root else f"{root.rstrip('/')}/marketsig/{sub}"


def _count():
    i = 0
    while True:
        i += 1
        yield i


_counter = _count()
