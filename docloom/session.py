"""Session settings that suit this library on any cluster size."""

from __future__ import annotations

import contextlib
import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Nothing here is a bound on data; adaptive execution sizes partitions and splits skewed ones.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "docloom", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for lineage cuts: the session's, or our own where none is set (local runs only)."""
    sc = spark.sparkContext
    folder = sc._jsc.sc().getCheckpointDir()
    if folder.isDefined():
        return folder.get()
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "docloom-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    sc = df.sparkSession.sparkContext
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    file = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        out._docloom_file = file.get()
        if not hasattr(sc, "_docloom_cuts"):
            sc._docloom_cuts = []
        sc._docloom_cuts.append(out._docloom_file)
    return out


def remove(spark: SparkSession, files: list[str]) -> None:
    """Deletes files or folders of the shared folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for file in files:
        path = hadoop(file)
        path.getFileSystem(conf).delete(path, True)


def discard(*dfs: DataFrame) -> None:
    """Deletes what cut() kept of these; for results that nothing reads any more, as those of earlier rounds."""
    for df in dfs:
        file = df.__dict__.pop("_docloom_file", None)
        if file is not None:
            remove(df.sparkSession, [file])
            df.sparkSession.sparkContext._docloom_cuts.remove(file)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what cut() kept inside; the results made inside must have been written or collected by then."""
    sc = spark.sparkContext
    before = set(getattr(sc, "_docloom_cuts", ()))
    try:
        yield
    finally:
        inside = [f for f in getattr(sc, "_docloom_cuts", ()) if f not in before]
        remove(spark, inside)
        sc._docloom_cuts = [f for f in getattr(sc, "_docloom_cuts", ()) if f in before]


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, unless they are sure to have it.

    They have it where it was submitted as a file, or where its folder stands in PYTHONPATH.
    """
    sc = spark.sparkContext
    package = Path(__file__).resolve().parent
    known = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if getattr(sc, "_docloom_shipped", False) or not package.is_dir() or str(package.parent) in known:
        return
    archive = Path(tempfile.mkdtemp(prefix="docloom-")) / "docloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._docloom_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
