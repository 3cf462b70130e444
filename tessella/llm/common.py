"""Shared folders, written tables and id filters for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of 8-byte ids up to which a side may be broadcast (8 MB); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch with whole texts in it: the default of 10,000 takes hundreds of MB beside the heap.
TEXTS = 1000

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Only in local mode, where it may be unset, one on this machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tessella-"))
    return f"{base.rstrip('/')}/tessella-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, batch: int | None = None, packed: bool = True) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there, and a lost executor loses nothing.

    ``batch``: rows of an Arrow batch while this is written; the session's setting is put back. ``packed``: compressed;
    tables of hashes don't shrink, and the codecs' buffers are memory beside the heap.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}"
    before = spark.conf.get(BATCH_ROWS)
    try:
        if batch:
            spark.conf.set(BATCH_ROWS, batch)
        df.write.parquet(path, compression=None if packed else "uncompressed")
    finally:
        if batch:
            spark.conf.set(BATCH_ROWS, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def removed(*tables: DataFrame) -> None:
    """Removes tables that ``written`` returned and no plan reads any more."""
    for t in tables:
        spark, path = t.sparkSession, t.table_path.rsplit("/", 1)[0]
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def free(name: str, columns: list[str]) -> str:
    """``name``, with underscores behind it until no column has that name in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_ids(rows: DataFrame, ids: DataFrame, column: str | list[str], count: int) -> DataFrame:
    """Rows whose id is not among ``count`` ids: broadcast up to BROADCAST_IDS, shuffled beyond."""
    return rows.join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, column, "left_anti")


def only_ids(rows: DataFrame, ids: DataFrame, column: str, count: int) -> DataFrame:
    return rows.join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, column, "left_semi")


def small_batches(spark: SparkSession) -> None:
    """For rows that go on without being written here, batches of at most TEXTS rows; the session's setting stays lowered."""
    if int(spark.conf.get(BATCH_ROWS)) > TEXTS:
        spark.conf.set(BATCH_ROWS, TEXTS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
