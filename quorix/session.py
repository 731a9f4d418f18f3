"""Session helpers: building a session, reading tables, cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quorix")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers of all executors, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_quorix_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quorix-ship-")) / "quorix.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._quorix_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    The cluster names a shared folder in spark.checkpoint.dir. Only a local master may fall back on a
    temporary folder; on a cluster without the setting this raises, since a machine-local folder would
    not survive the loss of an executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quorix-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and cut its lineage."""
    ship_package(df.sparkSession)
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def snapshot(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Write `df` as a table in the shared checkpoint folder and read it back; for loops.

    Unlike a checkpoint, the table starts with fresh size statistics: those of a checkpoint keep the
    estimates of the plan behind it, which a loop of joins multiplies without end. `replaces` is an older
    snapshot that nothing needs any more; it is deleted once the new one is written.
    """
    spark = df.sparkSession
    ship_package(spark)
    path = f"{ensure_checkpoint_dir(spark)}/quorix-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quorix_path = path
    release(replaces)
    return out


def kept(df: DataFrame) -> DataFrame:
    """`df` if it is a snapshot, else a snapshot of it; for operators that read their input more than once."""
    return df if getattr(df, "_quorix_path", None) else snapshot(df)


def release(df: DataFrame | None) -> None:
    """Delete a snapshot's table."""
    path = getattr(df, "_quorix_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        place = sc._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)
        df._quorix_path = None
