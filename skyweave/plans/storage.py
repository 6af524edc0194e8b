"""The shared folder in which iterative plans cut their lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; on a local master without one, a temporary folder."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _LOCAL:
        folder = tempfile.mkdtemp(prefix="skyweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL["dir"] = f"file://{folder}"
    return _LOCAL["dir"]


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: a cut in the lineage that outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def dropped(df: DataFrame) -> None:
    """Deletes what ``written`` made for ``df``; nothing may read it any more."""
    for file in df.inputFiles()[:1]:
        _delete(df.sparkSession, file.rpartition("/")[0])


def mark() -> int:
    """A point in time, for ``release``."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Deletes the tables written since a ``mark``, but for the last ``keep``; nothing may read them any more."""
    gone = _WRITTEN[since : len(_WRITTEN) - keep]
    for path in gone:
        _delete(spark, path)
    del _WRITTEN[since : since + len(gone)]
