"""Session helpers: shared scratch tables, guarded broadcasts, shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and scratch tables that driver and executors share.

    It is the one named by ``spark.checkpoint.dir``. Where that is unset, a local master gets a
    temporary folder (tests); a cluster must name one, since a machine-local folder would be lost.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="leafmill-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str = "t") -> str:
    """A new path in the shared folder, for a table that ``drop_scratch`` removes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch(spark).append(path)
    return path


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later jobs neither recompute
    it nor depend on the executors that made it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _scratch(spark: SparkSession) -> list[str]:
    sc = spark.sparkContext
    if not hasattr(sc, "_leafmill_scratch"):
        sc._leafmill_scratch = []
    return sc._leafmill_scratch


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_materialized(df: DataFrame) -> None:
    """Remove the files behind a DataFrame made by ``materialize`` that no later plan reads."""
    files = df.inputFiles()
    if files:
        _delete(df.sparkSession, os.path.dirname(files[0]))


def scratch_mark(spark: SparkSession) -> int:
    """A mark that tells the tables written so far from later ones (see ``drop_scratch``)."""
    return len(_scratch(spark))


def drop_scratch(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Remove the tables that ``materialize`` has written in this context (since a ``scratch_mark``), but for
    the one that ``keep`` reads. DataFrames that were built on those tables can no longer be computed."""
    paths = _scratch(spark)
    held = {os.path.basename(os.path.dirname(f)) for f in keep.inputFiles()} if keep is not None else set()
    for path in paths[since:]:
        if os.path.basename(path) not in held:
            _delete(spark, path)
            paths.remove(path)


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast only when ``df`` (already materialised, narrow) has at most ``max_rows``
    rows; beyond that the planner shuffles it."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


#: Rows of an Arrow batch, where the session does not say otherwise. Texts are long: Spark's 10,000 rows
#: would be tens to hundreds of MB in the JVM and again in each Python worker.
ARROW_ROWS = 512
_ARROW_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that their Python workers can import
    it whatever their working directory is, and bound the session's Arrow batches."""
    if spark.conf.get(_ARROW_CONF) == "10000":
        spark.conf.set(_ARROW_CONF, str(ARROW_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_leafmill_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="leafmill-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("leafmill", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._leafmill_shipped = True
