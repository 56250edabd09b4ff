"""Helpers shared by the training-data operators: scratch tables in the shared folder, input columns, Arrow."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.session import ship

_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the one named in spark.checkpoint.dir. Where that is unset, a local master gets a temporary folder
    (there is one machine) and any other master a folder below the warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _roots:
        local = spark.sparkContext.master.split("[")[0] == "local"
        _roots[app] = tempfile.mkdtemp(prefix="rasterloom-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return _roots[app]


def materialise(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage, survives a lost executor.

    The files go when the application ends, or earlier by discard().
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/rasterloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str | None) -> None:
    """Deletes a table that materialise() wrote and that no later plan reads."""
    if path:
        fs, p = _fs(spark, path)
        fs.delete(p, True)


class Scratch:
    """Tables that an operator writes for itself: with Scratch() as s, s.keep(df, name); all are deleted at the end.

    What leaves the block must be materialised itself.
    """

    def __enter__(self) -> Scratch:
        self.spark, self.paths = None, []
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            discard(self.spark, path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        out, path = materialise(df, name)
        self.spark = df.sparkSession
        self.paths.append(path)
        return out


#: Groups that may be sent to every task: those with more than 1/HOT of all rows, so fewer than HOT; rows that need no look.
HOT, FEW = 1000, 100_000


def with_groups(df: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """df joined by its keys with groups, a table of one row per group with its number of rows in df (_rl_n, not kept).

    A plain join with an aggregate would gather a group's rows in one task. Groups with more than 1/HOT of the rows
    go to the tasks by broadcast instead, so their rows stay where they are. Both tables are read several times.
    """
    total, most = groups.agg(F.sum("_rl_n"), F.max("_rl_n")).first()
    floor = (total or 0) / HOT
    if not total or most <= floor:
        return df.join(groups.drop("_rl_n"), keys)
    hot = F.broadcast(groups.where(F.col("_rl_n") > floor).drop("_rl_n"))
    rest = df.join(hot.select(*keys), keys, "left_anti").join(groups.where(F.col("_rl_n") <= floor).drop("_rl_n"), keys)
    return df.join(hot, keys).unionByName(rest)


def with_least(df: DataFrame, key: str, value: str, name: str, scratch: Scratch, rows: int | None = None) -> DataFrame:
    """df with the smallest `value` of each row's `key` as the column `name`; rows without a key are dropped.

    rows: df's number of rows, if it is known; up to FEW of them need no look at the groups.
    """
    least = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(name), F.count("*").alias("_rl_n"))
    if rows is not None and rows <= FEW:
        return df.join(least.drop("_rl_n"), key)
    return with_groups(df, scratch.keep(least, "least"), [key])


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast: other columns of the input can have any name."""
    ship(df.sparkSession)
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()])


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which its operator sizes to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def release() -> None:
    """Gives back what this worker holds beyond its task: another operator's caches, and memory that was freed in small pieces.

    Workers are used again by later stages, so a task that needs much memory begins and ends with this.
    """
    import ctypes
    import sys

    import pyarrow as pa

    if (subwords := sys.modules.get("rasterloom.llm.subwords")) is not None:
        subwords._LAST.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def hold() -> None:
    """Lets this worker keep up to 64 MB that it frees: steps that take and free the same arrays again get no new pages."""
    import ctypes

    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


def utf8(column) -> list[bytes]:
    """The texts of an Arrow string column as bytes, null as empty, without making Python strings."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]
