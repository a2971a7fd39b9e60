"""Session plumbing shared by the operators: code shipping, durable cuts, sizes."""

from __future__ import annotations

import atexit
import hashlib
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parent.parent
_OWN_DIRS: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers; once per application.

    Also lowers the session's default of rows in an Arrow batch, which Spark has for no single operator: 10,000 whole
    texts are too many at once. A value set by the caller stays. Needs a classic session, not Spark Connect.
    """
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default: too many rows of whole texts at once
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    marker = "dbpulse-" + sc.applicationId.replace("/", "_") + ".zip"
    if any(str(p).endswith(marker) for p in sc._python_includes):
        return
    folder = Path(tempfile.mkdtemp(prefix="dbpulse-code-"))
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(folder / marker, "w") as out:
        for p in sorted(_PACKAGE.rglob("*.py")):
            out.write(p, f"{_PACKAGE.name}/{p.relative_to(_PACKAGE)}")
    sc.addPyFile(str(folder / marker))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset and all run on this machine."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="dbpulse-shared-")
        atexit.register(shutil.rmtree, _OWN_DIRS[app], True)
    return "file://" + _OWN_DIRS[app]


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing uses yet; removed when the application ends."""
    path = f"{shared_dir(spark)}/dbpulse/{what}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session is already gone; the folder's owner removes it
        pass


def cut(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: lineage ends, lost executors cost nothing."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcasts only what was counted and is small; otherwise the join shuffles."""
    return F.broadcast(df) if rows <= limit else df



def hash_sample(df: DataFrame, key: str, most: int, rows: int) -> DataFrame:
    """The ``most`` rows, of ``rows``, with the smallest hashes of a key.

    A threshold on the hash lets through half as many again before they are ordered, so what meets in one task
    follows ``most`` and not the number of partitions.
    """
    h = F.xxhash64(key)
    if rows > 2 * most:
        df = df.where(h < int(-(1 << 63) + min(1.0, 1.5 * most / rows) * (1 << 64)))
    return df.orderBy(h, key).limit(most)


def shipped_file(spark: SparkSession, path: str):
    """(key, broadcast) of a file's bytes, read on the driver, as executors may not have it."""
    data = Path(path).read_bytes()
    return hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
