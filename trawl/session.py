"""Session helpers.

Shared scratch space: lineage cuts and intermediate tables go under the folder the
cluster names in ``spark.checkpoint.dir``. We only set our own folder when the session
has none (local tests), never a machine-local folder on a cluster.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def get_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume."""
    master = master or os.environ.get("TRAWL_MASTER", "local[*]")
    builder = (
        SparkSession.builder.master(master)
        .appName("trawl")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TRAWL_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.ansi.enabled", "true")
    )
    if shuffle_partitions or master.startswith("local"):  # a cluster keeps its own setting
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``trawl`` importable in the Python workers (pandas UDFs, cogroup kernels).

    The package is zipped once per SparkContext and handed to ``addPyFile``, which
    distributes it to every executor (the driver-side zip is only the upload source).
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    ckpt = sc.getCheckpointDir() or ""
    local_ckpt = ckpt[len("file:"):] if ckpt.startswith("file:") else ("" if "://" in ckpt else ckpt)
    base = local_ckpt if local_ckpt and os.path.isdir(local_ckpt) else tempfile.mkdtemp(prefix="trawl-py-")
    path = os.path.join(base, f"trawl-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(path)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder (create a local one only if none is configured)
    and make sure the workers can import this package."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        ship_package(spark)
        return current
    configured = spark.conf.get(_CHECKPOINT_KEY, None) or sc.getConf().get(_CHECKPOINT_KEY, None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        # a local session: a fresh temp folder is the shared folder
        configured = tempfile.mkdtemp(prefix="trawl-ckpt-")
    sc.setCheckpointDir(configured)
    ship_package(spark)
    return sc.getCheckpointDir() or configured


def scratch_dir(spark: SparkSession, name: str = "scratch") -> str:
    """A fresh, unique folder inside the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/trawl-{name}-{uuid.uuid4().hex[:12]}"


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``scratch_dir`` made, through Hadoop's file system, so that it
    works on any store. Only call it when nothing that is still to run reads the folder."""
    if "/trawl-" not in path:
        raise ValueError(f"not a scratch folder: {path}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
