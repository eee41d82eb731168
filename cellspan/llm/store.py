"""Shared-folder staging and size-checked joins used by the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most key rows that filter_by_keys() broadcasts (8 bytes each, so some 16 MB); beyond it, both sides shuffle.
BROADCAST_ROWS = 1_000_000

#: Bytes of an Arrow batch of whole texts, beside Spark's own bounds of 10,000 rows and 64 MB.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold some BATCH_BYTES, unless the session has a bound of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder is taken in local mode (tests); on a cluster that is an error, as executors
    would not find what others have written.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses, removed when the driver ends."""
    path = f"{shared_dir(spark)}/cellspan/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended; the folder's owner clears it then
        pass


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and return the table: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _STAGED[id(table)] = (weakref.ref(table, lambda _, k=id(table): _STAGED.pop(k, None)), path)
    return table


#: The paths of tables that stage() returned, as long as they are held.
_STAGED: dict[int, tuple] = {}


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for t in tables:
        _, path = _STAGED.pop(id(t), (None, None))
        if path:
            _remove(t.sparkSession, path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as make it none of df's (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def quoted(name: str) -> str:
    """A column name for select(), dots and back quotes in it among the rest."""
    return "`" + name.replace("`", "``") + "`"


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True if df (cheap to count: a staged table) has at most limit rows."""
    return df.count() <= limit


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, hinted for broadcast if a count shows at most limit rows; without a hint beyond it."""
    return F.broadcast(df) if small(df, limit) else df


def filter_by_keys(df: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    """left_semi or left_anti of df with staged keys: without a shuffle of df when the keys are few."""
    return df.join(checked_broadcast(keys), on, how)
