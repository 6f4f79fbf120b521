"""Session construction and lineage-cutting helpers.

On a cluster the session comes from the launcher; ``spark.checkpoint.dir``
must name a shared folder there.  Only when it is unset *and* the master is
local (tests, bench) do we create a private checkpoint folder.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Defaults chosen for corpus-scale jobs; every one can be overridden by the caller.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the reference tokenises in batches of 1,024 rows; Arrow batches match it
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    # collect_list regroups (tokenisation, id remapping) keep up to this many
    # groups per task in the object hash map, then fall back to the spillable
    # sort-based path (the default, 128, falls back almost at once)
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
}


def build_session(master: str | None = None, partitions: int | None = None,
                  app: str = "textpairs", conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``textpairs`` importable in every Python worker (``addPyFile`` of a zip,
    as ``--py-files`` would on a cluster).  Done once per application."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out_dir = tempfile.mkdtemp(prefix="textpairs-pyfiles-")
    target = os.path.join(out_dir, "textpairs.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(target)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, honouring ``spark.checkpoint.dir``.

    A private temporary folder is used only for a local master; on a cluster
    an unset checkpoint dir is an error (machine-local folders are not shared).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if re.match(r"local(\[|$)", sc.master):
        path = tempfile.mkdtemp(prefix="textpairs-ckpt-")
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir() or path
    raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")


#: paths of written tables that were not dropped, per application, in order
_CUTS: dict[str, list[str]] = {}


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str, folder: str = "tables") -> str:
    """A fresh path under the (shared) checkpoint folder for a written table.

    The table is deleted by the end of a ``cuts`` block it was made in, by
    ``drop_cuts``, or when the application ends.
    """
    base = os.path.join(ensure_checkpoint_dir(spark), folder)
    app = spark.sparkContext.applicationId
    if app not in _CUTS:
        _CUTS.clear()
        _CUTS[app] = []
    if not any(os.path.dirname(p) == base for p in _CUTS[app]):
        # the folder is this application's own: the JVM removes it when it shuts down
        at, fs = _file_system(spark, base)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    path = os.path.join(base, f"{name}-{uuid.uuid4().hex}")
    _CUTS[app].append(path)
    return path


def drop_cuts(spark: SparkSession, paths: Sequence[str] | None = None) -> None:
    """Delete written tables (all of this application's by default).  DataFrames over them cannot be read any more."""
    known = _CUTS.get(spark.sparkContext.applicationId, [])
    for path in list(known if paths is None else paths):
        at, fs = _file_system(spark, path)
        fs.delete(at, True)
        if path in known:
            known.remove(path)


@contextmanager
def cuts(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside the block are deleted at its end: consume the results in it."""
    before = set(_CUTS.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        drop_cuts(spark, [p for p in _CUTS.get(spark.sparkContext.applicationId, []) if p not in before])


def materialise(df: DataFrame, name: str = "cut", folder: str = "tables") -> DataFrame:
    """Cut lineage with a Parquet table in the shared checkpoint folder (columns prune, filters push)."""
    path = scratch_path(df.sparkSession, name, folder)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
