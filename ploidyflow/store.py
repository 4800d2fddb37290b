"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

#: Paths written for each application, by its id.
_made: dict[str, list[str]] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only where it is unset (tests on one machine) a temporary folder is made; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, root[7:], True)
        try:
            spark.conf.set("spark.checkpoint.dir", root)
        except Exception:  # noqa: BLE001  a static setting stays as it is
            pass
    return root.rstrip("/")


def mounted(uri: str) -> str | None:
    """The path of a file: URI or a plain path, None for any other store."""
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _delete(spark: SparkSession, uri: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def marked(spark: SparkSession) -> int:
    """How many paths this application has written so far, for release()."""
    return len(_made.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, first: int = 0, last: int | None = None) -> None:
    """Deletes what this application wrote into the shared folder, from one mark to another; for when no result reads it any more."""
    made = _made.get(spark.sparkContext.applicationId, [])
    for path in made[first:last]:
        _delete(spark, path)
    made[first:last] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again.

    Cuts the lineage: a lost executor costs no recomputation of what is written.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() returned and that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        _delete(spark, t.written_to)
        _made[spark.sparkContext.applicationId].remove(t.written_to)
