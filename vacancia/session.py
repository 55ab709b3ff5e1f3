"""Session, table loading and lineage cutting shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller's own session is used."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("vacancia")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, unless their PYTHONPATH has it."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent.parent
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_vacancia_sent", False):
        return
    sc._vacancia_sent = True
    folder = tempfile.mkdtemp(prefix="vacancia-")  # on the driver, which serves the file to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder, "vacancia.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(Path(__file__).parent.rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's spark.checkpoint.dir, or, where that is unset, one of our own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="vacancia-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def files(spark: SparkSession, path: str):
    """The file system of a path and the path, for `exists`, `delete` and `listStatus`."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = files(spark, path)
    fs.delete(p, True)


_cuts: dict[str, SparkSession] = {}


def _remove_cuts() -> None:
    for path, spark in list(_cuts.items()):
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session is gone, and its folder is the cluster's to clean
            pass


def cut(df: DataFrame, *by: str) -> DataFrame:
    """Write `df` to the shared folder and go on from there; survives the loss of executors.

    A written table is computed once, where a checkpoint computes its last stage twice. What is cut goes at the end of the process.
    `by`: columns that part the table's files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    if not _cuts:
        atexit.register(_remove_cuts)
    _cuts[path] = spark
    return keep(df, path, *by)


def keep(df: DataFrame, path: str, *by: str) -> DataFrame:
    """Write `df` to a folder, in place of what is there, and read it."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    """Partitions for a shuffle whose row order inside a partition matters (AQE leaves it alone)."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def tokenizer_dir() -> str:
    """Folder of the public tokenizers' files; a parameter everywhere, this is its default."""
    return os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
