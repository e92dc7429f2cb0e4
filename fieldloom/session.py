"""Session, table and shared-folder helpers used by every operator."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "fieldloom", master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the plans are written for (AQE on, UTC, Arrow)."""
    b = SparkSession.builder.appName(app).master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the package to the executors, once per application; else they'd have to have it installed or on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="fieldloom-")) / "fieldloom.zip"  # on the driver, from where Spark serves it
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent).as_posix())
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir.

    Only where the session names none (tests, local mode) a local folder is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="fieldloom-"))
    return sc.getCheckpointDir().rstrip("/")


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/fieldloom-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write once to the shared folder, read it back.

    Unlike a cached frame it survives the loss of any executor. The files stay until clean() or the end of the program.
    """
    spark = df.sparkSession
    path = f"{_run_dir(spark)}/{uuid.uuid4().hex}"
    if not _registered:
        _registered.append(atexit.register(_clean_quietly))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Delete what this application has materialised; frames that read it can't be used afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_registered: list = []


def _clean_quietly() -> None:
    try:
        if spark := SparkSession.getActiveSession():
            clean(spark)
    except Exception:  # noqa: BLE001  the cluster may be gone already
        pass


def spread(df: DataFrame, spark: SparkSession, *keys: str) -> DataFrame:
    """Even out a scan whose files are fewer than the cores, before CPU-heavy work.

    The number of partitions follows the cluster's parallelism; a scan that already
    has as many splits is left alone.
    """
    want = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *keys)
