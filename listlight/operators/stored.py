"""Tables in the folder that driver and executors share, numbering without a single task, broadcasts behind a check of size."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SMALL = 100_000  # rows (a few MB) up to which a dimension is broadcast; beyond it joins shuffle
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_folders: dict[str, str] = {}  # of applications that name no shared folder themselves
_tables: dict[str, tuple[str, object]] = {}  # path: (application, Hadoop configuration, which outlives the application)


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df marked for broadcast if it has at most `most` rows; the check reads no more than most + 1 of them."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only where that is unset and executors are this machine (local runs): a folder of our own, one for each application."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if context.applicationId not in _folders:
            _folders[context.applicationId] = tempfile.mkdtemp(prefix="listlight-")
            kept(spark, _folders[context.applicationId])
        path = _folders[context.applicationId]
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/listlight-{name}-{uuid.uuid4().hex}"


def _system(spark_jvm, path: str, conf):
    at = spark_jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(conf)


def kept(spark: SparkSession, path: str) -> None:
    """Have a folder deleted: by drop, by close, when another session writes after the end of this one, or at the latest as the JVM or Python exits."""
    conf = spark._jsc.hadoopConfiguration()
    at, system = _system(spark._jvm, path, conf)
    system.deleteOnExit(at)
    _tables[path] = spark.sparkContext.applicationId, conf


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that is deleted as written tables are."""
    path = new_folder(spark, name)
    at, system = _system(spark._jvm, path, spark._jsc.hadoopConfiguration())
    system.mkdirs(at)
    kept(spark, path)
    return path


def _delete(path: str) -> None:
    from pyspark import SparkContext

    _, conf = _tables.pop(path)
    if SparkContext._jvm is not None:
        at, system = _system(SparkContext._jvm, path, conf)
        system.delete(at, True)
        system.cancelDeleteOnExit(at)


def write(df: DataFrame, name: str, codec: str | None = None, by: str | None = None, options: dict[str, str] | None = None) -> str:
    """Write df as Parquet (options are its writer's) into a new folder below the shared one and return its path.

    The shuffle files of the write are deleted with its end, as nothing reads them again. What ended sessions left is deleted first.
    """
    spark = df.sparkSession
    own = spark.sparkContext.applicationId
    for path in [p for p, (application, _) in _tables.items() if application != own]:
        _delete(path)
        _folders.pop(next((a for a, f in _folders.items() if f == path), None), None)
    path = new_folder(spark, name)
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        writer = df.write.options(**(options or {}) | ({"compression": codec} if codec else {}))
        (writer.partitionBy(by) if by else writer).parquet(path)
        kept(spark, path)
    except BaseException:
        at, system = _system(spark._jvm, path, spark._jsc.hadoopConfiguration())
        system.delete(at, True)
        raise
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return path


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    out = spark.read.schema(schema).parquet(path)
    out.listlight_path = path
    return out


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write df into the shared folder and read it back: computed once, and a lineage cut that survives lost executors.

    The table stays until drop or close, since results that are still to be run may read it; at the latest it goes with the session.
    """
    return read(df.sparkSession, write(df, name, codec), df.schema)


def drop(*tables: DataFrame) -> None:
    """Delete written tables that nothing lazy reads any more."""
    for df in tables:
        path = getattr(df, "listlight_path", None) if "listlight_path" in df.__dict__ else None
        for file in [] if path else df.inputFiles()[:1]:
            path = max([p for p in _tables if "/".join(p.split("/")[-2:]) + "/" in unquote(file)], key=len, default=None)
        if path in _tables:
            _delete(path)


def close(spark: SparkSession) -> None:
    """Delete all that was written for the session's results; they can't be read any more."""
    for path in [p for p, (application, _) in _tables.items() if application == spark.sparkContext.applicationId and p not in _folders.values()]:
        _delete(path)


@atexit.register
def _delete_all() -> None:
    for path in list(_tables):
        try:
            _delete(path)
        except Exception:  # the JVM is gone; it has deleted what it was told to as it went
            return


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with n from 1 in the order of columns (nulls first): ranges are numbered apart and offset by the sizes of those before them."""
    spread = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "numbered")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = spread.groupBy("part").agg(F.count("*").alias("size")).select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return spread.join(F.broadcast(offsets), "part").withColumn("n", F.col("offset") + within).drop("part", "offset")


def running(rows: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """rows with, for each (name: column) of sums, the sum of the column up to and including the row in the order of columns (nulls first; unique, lest ties be summed in any order).

    Ranges are summed apart and offset by the totals of those before them: no task sees more than a range.
    """
    spread = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "running")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    totals = spread.groupBy("part").agg(*[F.sum(c).alias(f"of_{n}") for n, c in sums.items()])
    offsets = totals.select("part", *[F.coalesce(F.sum(f"of_{n}").over(before), F.lit(0)).alias(f"of_{n}") for n in sums])
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = spread.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"in_{n}") for n, c in sums.items()])
    joined = summed.join(F.broadcast(offsets), "part")
    return joined.select(*rows.columns, *[(F.col(f"of_{n}") + F.col(f"in_{n}")).alias(n) for n in sums])
