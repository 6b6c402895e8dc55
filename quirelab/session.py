"""Session helpers: table loading and reliable lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []
#: Spark's setting that deletes an action's exchanges when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Make this package importable for Python workers on every machine, once per context.

    It is added to the context like any submitted Python file, from where executors fetch it;
    a package that was submitted as an archive already is not sent again.
    """
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(sc, "_quirelab_shipped", False) or not root.is_dir():
        return
    sc._quirelab_shipped = True
    archive = Path(tempfile.mkdtemp(prefix="quirelab-")) / "quirelab_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((root / "quirelab").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(archive))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written intermediate tables.

    ``spark.checkpoint.dir`` names it on a cluster, or the checkpoint folder set on the context.
    Only where neither is set and all work is done on this machine (tests, a laptop) is a temporary
    folder made for the session; elsewhere this raises RuntimeError, since executors would each
    write to a disk of their own.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or getattr(spark, "_quirelab_dir", None)
    if not place:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that every machine reads and writes")
        place = "file://" + tempfile.mkdtemp(prefix="quirelab-")
        spark._quirelab_dir = place
    return place


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below :func:`shared_dir`; what is written there outlives lost executors."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back.

    A checkpoint keeps the size estimate of its plan, and estimates of joins multiply, so in a
    loop they would grow without bound; a written table has its own size. The exchanges behind the
    rows are deleted as soon as these are written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def whole_executor(spark: SparkSession) -> ResourceProfile | None:
    """Tasks that take all cores of an executor, since each needs its memory; None within one process, or where the cores aren't known."""
    sc = spark.sparkContext
    master = re.match(r"local-cluster\[\s*\d+\s*,\s*(\d+)", sc.master)
    cores = int(master[1]) if master else 0 if sc.master.startswith("local") else int(sc.getConf().get("spark.executor.cores", "0"))
    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(cores)).build if cores > 1 else None


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of written rows, if it is there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there; other trouble than its absence is raised."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this process wrote below the shared folder; results must have been used or saved by then."""
    while _made:
        drop_path(spark, _made.pop())
