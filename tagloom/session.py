"""Session helpers: tables of a data set, the shared folder, intermediate tables."""

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a small table up to which it is broadcast; about 32 MB at 32 bytes a row.
BROADCAST_ROWS = 1_000_000

#: Paths to remove. No session is kept here: functions of this package go to the workers by value, with what they refer to.
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset (local runs)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tagloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written_at(df: DataFrame) -> str:
    """Write ``df`` as a Parquet table in the shared folder; its path."""
    path = f"{shared_dir(df.sparkSession)}/tagloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    remember(df.sparkSession, path)
    return path


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage and survives lost executors.

    The table is removed when the driver program ends, or by ``release``.
    """
    return df.sparkSession.read.schema(df.schema).parquet(written_at(df))


def remember(spark: SparkSession, path: str) -> None:
    """Have a file or folder removed when the driver program ends."""
    if not _written:
        atexit.register(_remove_written)
    _written.append(path)


def release(spark: SparkSession, since: int = 0) -> None:
    """Remove the intermediate tables written since ``marked()`` gave ``since``: results that were not yet computed need them."""
    while len(_written) > since:
        at = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def marked() -> int:
    """A point from which ``release`` removes tables."""
    return len(_written)


def _remove_written() -> None:
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None:
            release(spark)
    except Exception:  # the session may be gone already
        pass


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``BROADCAST_ROWS`` rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
