"""Session helpers: the shared scratch folder, table reading and run-time sizing."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_local_scratch: dict[str, str] = {}
_session_dirs: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only a local master (tests, the bench) may go without: there a temporary folder is set. On a cluster that is an error.
    """
    named = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{_CHECKPOINT_KEY} must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = "file://" + tempfile.mkdtemp(prefix="quoin-")
        spark.sparkContext.setCheckpointDir(_local_scratch[app])
    return _local_scratch[app]


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def make_dir(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.mkdirs(p)


def session_dir(spark: SparkSession) -> str:
    """This session's own folder in the shared one; it is removed when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/quoin-{spark.sparkContext.applicationId}"
    if path not in _session_dirs:
        fs, p = _hadoop(spark, path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _session_dirs.add(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the session's folder."""
    return f"{session_dir(spark)}/{uuid.uuid4().hex[:12]}/{name}"


def written(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder, in folders by the values of ``by``, and read it back.

    The written table survives the loss of executors, and reading it back gives Spark exact sizes to plan with.
    """
    path = scratch_path(df.sparkSession, name)
    w = df.write
    (w.partitionBy(*by) if by else w).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quoin_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table that ``written`` made, once nothing reads it any more; other DataFrames are left alone."""
    path = getattr(df, "_quoin_path", None)
    if path:
        fs, p = _hadoop(df.sparkSession, path)
        fs.delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def partitions_of(df: DataFrame) -> int:
    """Number of partitions of the physical plan, without running it."""
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a real cluster; local masters import it from the driver's path."""
    sc = spark.sparkContext
    if sc.master.startswith("local") or getattr(sc, "_quoin_shipped", False):
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="quoin-")) / "quoin.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(out))
    sc._quoin_shipped = True


def local_session(cores: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quoin")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
