"""Session helpers.

Cluster settings come from the session; we only fill in what is unset, so a
cluster's own ``spark.checkpoint.dir`` (a shared folder) always wins.
"""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import SparkConf, cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Fixed defaults for the engine (all overridable by the cluster config).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # lets the file-tree source prune its listing with path predicates
    "spark.sql.python.filterPushdown.enabled": "true",
    # broadcast only what is small; the dimension tables we broadcast
    # explicitly are bounded by construction
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def carried(*modules: str) -> None:
    """Code of these modules travels with the functions that use it, so that tasks can run
    them where this package is not installed."""
    for m in modules:
        cloudpickle.register_pickle_by_value(sys.modules[m])


def get_session(master: str | None = None, app: str = "markscope",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    given = SparkConf()  # what the cluster or the command line has set stays
    for k, v in DEFAULT_CONF.items():
        if not given.contains(k):
            builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only in local mode, when the setting is absent (tests), do we pick a
    scratch folder; on a cluster a missing setting is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        # local mode (tests): one machine, so a scratch folder is shared
        d = tempfile.mkdtemp(prefix="markscope-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder of this run under the checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/markscope-{name}-{uuid.uuid4().hex[:12]}"


# Largest row count we broadcast for tables whose size is not fixed by
# construction (name lists, rule tables).
MAX_BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only after checking it has at most ``max_rows`` rows;
    beyond that it is joined normally (shuffle, or AQE's own choice)."""
    from pyspark.sql import functions as F
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df
