"""Sessions: sending this package to the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Lets executors import this package, once per application; what a job submitted with --py-files has anyway."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        _sent.add(app)
        here = Path(__file__).resolve().parent
        to = os.path.join(tempfile.mkdtemp(prefix="helixframe-"), "helixframe.zip")
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, str(p.relative_to(here.parent)))
        spark.sparkContext.addPyFile(to)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where it is unset and Spark runs in one process (local runs, tests) a
    temporary one is chosen; on a cluster its machines would not share it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        at = "file://" + tempfile.mkdtemp(prefix="helixframe-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


#: The setting that deletes the shuffle files of a query with its end. What is written needs them no more, and without it they
#: stay until the driver collects garbage, so rounds would fill the disk with the shuffles of all rounds before.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders of tables that written() has made and sweep() not deleted yet.
_made: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a table in the shared folder. Unlike after a checkpoint, Spark knows the table's size, so small
    ones are broadcast, and infers nothing from how it came about, so plans of many rounds stay small. Lazy results read
    these tables: they stay until sweep()."""
    spark = df.sparkSession
    at = f"{shared_folder(spark).rstrip('/')}/helixframe-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)
    _made.append(at)
    return spark.read.schema(df.schema).parquet(at)


def tables() -> frozenset[str]:
    """Folders that written() has made and nobody deleted."""
    return frozenset(_made)


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Deletes the tables that a result of written() reads."""
    folders = {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}
    for at in [x for x in _made if x.rpartition("/")[2] in folders]:
        _delete(df.sparkSession, at)
        _made.remove(at)


def sweep(spark: SparkSession, but: frozenset[str], *keep: DataFrame) -> None:
    """Deletes the tables that written() has made since `but` was taken with tables(), except those that `keep` reads: for
    when results that read them are no longer needed or have been written themselves."""
    held = {f.rpartition("/")[0].rpartition("/")[2] for df in keep for f in df.inputFiles()}
    for at in [x for x in _made if x not in but and x.rpartition("/")[2] not in held]:
        _delete(spark, at)
        _made.remove(at)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
