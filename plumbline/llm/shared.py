"""Helpers that every operator of this subpackage uses: reading tables, shared scratch space, prefix sums, Arrow output."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six characters of [\x20\x09-\x0D], as a Java and DuckDB regular expression class and as plain text.
WHITE = "[ \\t-\\r]"
WHITE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{WHITE}+"))


def word_count(text: Column) -> Column:
    """The number of words ``[^\\x20\\x09-\\x0D]+``, 0 for null, as a long."""
    return F.size(words_of(text)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where that is unset a local session gets a new folder; on a cluster executors would not see it, so there it is a fault.
    """
    told = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        told = tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(told)
        told = spark.sparkContext.getCheckpointDir()
    return told.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared space."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            drop_path(spark, path)
    except Exception:  # noqa: BLE001  the session is gone, and with it the way to the folder
        return


#: Shuffle files go when the write that made them is done, not when the driver happens to collect garbage.
NO_LEFTOVERS = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the actions inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stash(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), drop_at_exit: bool = True) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and any executor can read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash/{name}-{uuid.uuid4().hex}"
    with setting(spark, *NO_LEFTOVERS):
        df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    if drop_at_exit:
        atexit.register(_drop_at_exit, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


class Bucketed:
    """A table in the shared folder, dealt by keys into one file a bucket: what joins or groups by them needs no shuffle.

    Rows that come dealt by the same keys into as many partitions as there are buckets make one file a bucket.
    """

    def __init__(self, df: DataFrame, name: str, keys: list[str], buckets: int, sort: bool = False) -> None:
        self.spark, self.name = df.sparkSession, f"{name}_{uuid.uuid4().hex}".replace("-", "_")
        self.path = f"{shared_dir(self.spark)}/stash/{self.name}"
        writer = df.write.option("compression", "zstd").option("path", self.path).bucketBy(buckets, *keys)
        with setting(self.spark, *NO_LEFTOVERS):
            (writer.sortBy(*keys) if sort else writer).saveAsTable(self.name)
        atexit.register(self.drop)

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        atexit.unregister(self.drop)
        if self.spark.sparkContext._jsc is not None:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
            _drop_at_exit(self.spark, self.path)


def buckets_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fine_bins(rows: int) -> int:
    """How many bins split rows so that both the bins and the rows of a bin stay near the square root of rows."""
    return max(16, math.ceil(math.sqrt(max(rows, 1))))


def running_sums(df: DataFrame, keys: list[str], bin_col: str, order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums per keys in the order (bin_col, order), without a task that holds a whole key.

    Sums of each bin are summed up first (one row a bin), then rows are summed within their bin. Null keys are a key.
    """
    by = [*keys, bin_col]
    over = Window.partitionBy(*keys).orderBy(F.col(bin_col)).rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    base = df.groupBy(*by).agg(*[F.sum(v).alias(f"_in_{k}") for k, v in sums.items()])
    base = base.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], *[F.coalesce(F.sum(f"_in_{k}").over(over), F.lit(0)).alias(f"_base_{k}") for k in sums])
    own = df.select("*", *[F.sum(v).over(within).alias(f"_own_{k}") for k, v in sums.items()])
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)]
    return own.join(base, on).select(*df.columns, *[(F.col(f"_own_{k}") + F.col(f"_base_{k}")).alias(k) for k in sums])


def utf8(col: pa.Array) -> list[bytes | None]:
    """The values of a string or binary Arrow column as UTF-8 bytes."""
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else pa.binary()).to_pylist()


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows, fewer at a time, so that fewer texts are Python objects at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def by_batch(work: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function out of a function of one batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            if (made := work(batch)) is not None and made.num_rows:
                yield made

    return run


def clear_of(name: str, taken: Iterable[str]) -> str:
    """A column name that no name in taken clashes with, whatever its case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name
