"""Sinks: keyed merges, staged tables, deletes, marks, run log and CSV files."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflux import schema


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with equal keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def increment(old: DataFrame, new: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """old and new with numbers of equal keys added up: one partial aggregation, no join."""
    return old.select(*keys, *sums).unionByName(new.select(*keys, *sums)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def upsert_templates(old: DataFrame, new: DataFrame, skip_empty: bool) -> DataFrame:
    """Template lists by id; with skip_empty an empty new list leaves the old one in place."""
    return upsert(old, new.where(F.size("templates") > 0) if skip_empty else new, ["id"])


def add_frequencies(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Document frequencies with signed changes; what falls to 0 goes (deliberate: decrements count)."""
    return increment(old, delta, ["language", "term"], ["df"]).where(F.col("df") > 0)


def delete(table: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """table without the rows whose column is among ids (a column of that name)."""
    return table.join(ids.select(column).distinct(), column, "left_anti")


def mark_deleted(products: DataFrame, ids: DataFrame, when) -> DataFrame:
    """Logical deletion: deleted_on is set where it wasn't."""
    gone = ids.select(F.col("external_id"), F.lit(True).alias("_gone")).distinct()
    rows = products.join(gone, "external_id", "left")
    return rows.withColumn("deleted_on", F.when(F.col("_gone"), F.coalesce("deleted_on", F.lit(when))).otherwise(F.col("deleted_on"))).drop("_gone")


def copy_marks(summary: DataFrame, prefix: str, cutoff) -> DataFrame:
    """Latest-activity marks (prefix uu or pp) of all rows from the cutoff day on."""
    late = F.col("day") >= F.lit(cutoff)
    return summary.withColumns({f"{prefix}_latest_type": F.when(late, F.col("activity")).otherwise(F.col(f"{prefix}_latest_type")), f"{prefix}_latest_date": F.when(late, F.col("created_at")).otherwise(F.col(f"{prefix}_latest_date"))})


def save_marks(summary: DataFrame, done: DataFrame, prefix: str) -> DataFrame:
    """Marks of the (user, product) pairs of `done` alone."""
    pairs = done.select("user", "product", F.lit(True).alias("_done")).distinct()
    rows = summary.join(pairs, ["user", "product"], "left")
    new = {f"{prefix}_latest_type": F.when(F.col("_done"), F.col("activity")).otherwise(F.col(f"{prefix}_latest_type")), f"{prefix}_latest_date": F.when(F.col("_done"), F.col("created_at")).otherwise(F.col(f"{prefix}_latest_date"))}
    return rows.withColumns(new).drop("_done")


def expire(table: DataFrame, now, days: int = 30, column: str = "created_at") -> DataFrame:
    """Rows of anonymous users older than the time to live go; others stay."""
    fresh = F.col(column) >= F.lit(now) - F.make_interval(days=F.lit(days))
    return table.where(~F.col("anonymous") | fresh)


_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local session (as in tests) gets a temporary folder, which goes with the process; on a
    cluster it is an error, since executors would each write to a disk of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("recoflux.shared.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="recoflux-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("recoflux.shared.dir", folder)
    return folder.rstrip("/")


def materialized(df: DataFrame) -> DataFrame:
    """df written once to the shared folder, and read again: for tables that one job uses several times, or whose plan is to end there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/recoflux-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove all that materialized() has written in this process; what was read from it must be done with."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    while _written:
        path = paths(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Store:
    """Tables as versioned Parquet folders below a root; readers see a version only once it is published.

    A write goes to a new folder. publish() then records it in one small file
    of versions, written last, so a failed write leaves readers where they were, and several
    tables can be swapped in at once.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._files = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _versions(self) -> dict[str, str]:
        path = self._path("versions")
        if not self._files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path)):
            return {}
        rows = self.spark.read.schema("at LONG, name STRING, version STRING").json(path).collect()  # one row for each table and publication
        return {r.name: r.version for r in sorted(rows, key=lambda r: r.at)}

    def stage(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> str:
        version = uuid.uuid4().hex
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self._path(name, version))
        return version

    def publish(self, *, on_top: bool = False, **versions: str) -> None:
        """Swap versions in at once, or add them to what is there."""
        if on_top:
            now = self._versions()
            versions = {name: ",".join(x for x in (now.get(name), version) if x) for name, version in versions.items()}
        at = int(datetime.now(timezone.utc).timestamp() * 1e6)
        rows = [(at, name, version) for name, version in versions.items()]
        self.spark.createDataFrame(rows, "at LONG, name STRING, version STRING").coalesce(1).write.mode("append").json(self._path("versions"))

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None, on_top: bool = False) -> DataFrame:
        self.publish(on_top=on_top, **{name: self.stage(name, df, partition_by)})
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        versions = self._versions()
        if name not in versions:
            raise KeyError(f"no table {name}")
        return self.spark.read.parquet(*(self._path(name, x) for x in versions[name].split(",")))

    def exists(self, name: str) -> bool:
        return name in self._versions()

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Rows on top of a table, as a folder of their own; what is there isn't written again."""
        return self.write(name, df, on_top=True)

    def merge(self, name: str, new: DataFrame, keys: list[str]) -> DataFrame:
        return self.write(name, upsert(self.read(name), new, keys) if self.exists(name) else new)

    def log_run(self, kind: str, status: str, started: datetime, cutoff=None, latest: str | None = None) -> None:
        now = datetime.now(timezone.utc)
        row = (kind, now, status, cutoff, (now - started).total_seconds(), latest)
        self.spark.createDataFrame([row], schema.RUN_LOG).write.mode("append").parquet(self._path("run_log"))

    def run_log(self) -> DataFrame:
        path = self._path("run_log")
        if not self._files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path)):
            return self.spark.createDataFrame([], schema.RUN_LOG)
        return self.spark.read.schema(schema.RUN_LOG).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name)), True)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("header", header).option("nullValue", "").option("emptyValue", "").csv(path)


def wide_recommendations(recommendations: DataFrame, n: int) -> DataFrame:
    """One row per user: USER, PRODUCT_1 .. PRODUCT_n. The values of the pivot are given, so no pass finds them."""
    rows = recommendations.where(F.col("rank") <= n).groupBy(F.col("user").alias("USER")).pivot("rank", list(range(1, n + 1))).agg(F.first("product"))
    return reduce(lambda df, k: df.withColumnRenamed(str(k), f"PRODUCT_{k}"), range(1, n + 1), rows)
