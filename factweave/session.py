"""Session helpers: a local session for tests, and lineage cuts that survive the loss of executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, in UTC; a cluster brings its own session and needs nothing from here."""
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return SparkSession.builder.master(f"local[{cores}]").appName("factweave").config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one is set only where a local
    session has none, and a cluster without the setting is refused."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    sc.setCheckpointDir(made)
    return sc.getCheckpointDir()


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/factweave/{spark.sparkContext.applicationId}"


_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def cut(df: DataFrame, *done: DataFrame) -> DataFrame:
    """The rows of df, written as a table in the shared folder and read again: the lineage ends there, later
    stages read only the columns they use, and a lost executor loses nothing. Then the tables `done`, which `cut` wrote
    and nothing reads any more, are removed."""
    at = f"{_own_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    _written[out] = at
    for table in done:
        if table in _written:
            _remove(df.sparkSession, _written.pop(table))
    return out


def _remove(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Removes the tables this application's `cut` wrote; DataFrames that still read them can't be used after."""
    _remove(spark, _own_dir(spark))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python, once per application, as `--py-files` would; needed where it isn't
    installed or on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root, at = Path(__file__).parent, Path(tempfile.mkdtemp(prefix="factweave-")) / "factweave.zip"
    atexit.register(shutil.rmtree, at.parent, ignore_errors=True)  # the driver hands the file out until it ends
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(at))
    _shipped.add(sc.applicationId)
