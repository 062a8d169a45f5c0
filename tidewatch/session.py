"""Session helpers: local builder for tests and bench, and the shared working folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def local_session(cores: int = 8, app: str = "tidewatch") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_OWN_FOLDER: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets one temporary folder; on a cluster that is an error, since each executor
    would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDER:
        _OWN_FOLDER[app] = tempfile.mkdtemp(prefix="tidewatch-")
        atexit.register(shutil.rmtree, _OWN_FOLDER[app], ignore_errors=True)
    return _OWN_FOLDER[app]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint by way of a written table, so a lost executor does not lose the rows."""
    spark = df.sparkSession
    path = new_folder(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: str = "16m") -> Iterator[None]:
    """Arrow batches of long rows are cut by their bytes in the jobs inside."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def write_small(df: DataFrame, path: str) -> None:
    """Write long rows in row groups of 32 MB, which a reader holds whole."""
    with small_batches(df.sparkSession):
        df.write.option("parquet.block.size", str(32 << 20)).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a written stage that no later read needs."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A short fixed table as literals; its size is known to the optimizer, which picks the join by it."""
    fields = T.StructType.fromDDL(schema).fields
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)]) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))


def with_fields(schema: T.StructType, *added: tuple[str, T.DataType]) -> T.StructType:
    """A new schema with further columns; ``StructType.add`` would change the one a DataFrame holds."""
    return T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in added]])
