"""Session set-up and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import os
import tempfile
import uuid
import warnings
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow (key plus a number) table may be broadcast; about 40 MB.
BROADCAST_ROWS = 500_000


def get_session(app: str = "palaver", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Where a join has sorted the rows already, nesting them needs no second sort.
        "spark.sql.execution.replaceHashWithSortAgg": "true",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_palaver_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="palaver-"), "palaver.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("palaver", os.path.relpath(path, root)))
    sc.addPyFile(archive)
    sc._palaver_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where the setting is absent a folder is made only in local mode; a cluster must name one.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="palaver-shared-"))
    return sc.getCheckpointDir().rstrip("/")


#: Paths handed out in the block of :func:`scratch_tables` that is open, if one is.
_handed_out: ContextVar[list[str] | None] = ContextVar("handed_out", default=None)


def scratch_path(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A fresh path in the shared folder; unless ``keep`` is set, an open :func:`scratch_tables` block removes it."""
    path = f"{shared_dir(spark)}/palaver-{label}-{uuid.uuid4().hex}"
    paths = _handed_out.get()
    if paths is not None and not keep:
        paths.append(path)
    return path


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Remove the tables staged inside the block when it ends, also by an error; those of other blocks and jobs stay.

    What the block returns must be written by then: a lazy result that reads a removed table fails. Blocks may be nested,
    each removes its own. A path that cannot be removed is left and does not fail the job.
    """
    paths: list[str] = []
    token = _handed_out.set(paths)
    try:
        yield
    finally:
        _handed_out.reset(token)
        for path in paths:
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception as error:
        warnings.warn(f"could not remove {path}: {error}", stacklevel=2)


def stage(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage, survives lost executors, and gives later plans the true size of the table. ``keep`` lets the table
    outlive a block of :func:`scratch_tables`.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label, keep)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a counted, narrow table for broadcast if it is small; otherwise leave the join to shuffle."""
    return F.broadcast(df) if rows <= limit else df


def key_table(df: DataFrame, label: str) -> DataFrame:
    """A list of keys for a semi join: written once, and broadcast if it turns out small.

    Where it is large the join shuffles both sides. As the list is then read from a table and
    not aggregated in the join's own stage, adaptive execution can split a crowded key.
    """
    keys = stage(df, label)
    return small_side(keys, keys.count())
