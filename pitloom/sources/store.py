"""Parquet tables under one root, whole or partitioned by year and month."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def merge_by_key(existing: DataFrame | None, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row for each key: new rows win over existing ones; of new rows the last in `order` (columns) wins, then the last as read."""
    rows = new.withColumns({"__new": F.lit(1), "__at": F.monotonically_increasing_id()})
    if existing is not None:
        rows = rows.unionByName(existing.withColumns({"__new": F.lit(0), "__at": F.monotonically_increasing_id()}), allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(F.desc("__new"), *(F.desc_nulls_last(c) for c in order), F.desc("__at"))
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__new", "__at")


class CheckFailed(ValueError):
    """A table isn't published: counts of bad rows by check."""

    def __init__(self, table: str, counts: Mapping[str, int]) -> None:
        super().__init__(f"{table}: " + ", ".join(f"{n} {v}" for n, v in counts.items()))
        self.table, self.counts = table, dict(counts)


class Store:
    """root may be on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def exists(self, table: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, table: str, columns: Sequence[str] | None = None) -> DataFrame:
        """FileNotFoundError if the table isn't there."""
        try:
            df = self.spark.read.parquet(self.path(table))
        except AnalysisException as e:
            raise FileNotFoundError(self.path(table)) from e
        return df.select(*columns) if columns else df

    def read_mixed(self, table: str, columns: Sequence[str] | None = None) -> DataFrame:
        """As read(), where months were written with other columns or types: what a month lacks is NULL there, numbers of several types are
        doubles, all else strings. Reads the footers of all files."""
        if not self.exists(table):
            raise FileNotFoundError(self.path(table))
        try:
            df = self.spark.read.option("mergeSchema", "true").parquet(self.path(table))
        except (PySparkException, Py4JJavaError):
            months = [self.spark.read.parquet(f"{self.path(table)}/year={y}/month={m}").withColumns({"year": F.lit(y), "month": F.lit(m)}) for y, m in self.partitions(table)]
            kinds: dict[str, set[str]] = {}
            for month in months:
                for f in month.schema.fields:
                    kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
            clash = {n: "double" if all(k in _NUMBERS or k.startswith("decimal") for k in ks) else "string" for n, ks in kinds.items() if len(ks) > 1}
            months = [m.withColumns({n: F.col(n).cast(k) for n, k in clash.items() if n in m.columns}) for m in months]
            df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), months)
        return df.select(*columns) if columns else df

    def read_optional(self, table: str) -> DataFrame | None:
        try:
            return self.read(table)
        except FileNotFoundError:
            return None

    def overwrite(self, df: DataFrame, table: str) -> None:
        df.write.mode("overwrite").parquet(self.path(table))

    def partitions(self, table: str) -> list[tuple[int, int]]:
        return [(r.year, r.month) for r in self.read(table).select("year", "month").distinct().orderBy("year", "month").collect()]

    def _write_months(self, df: DataFrame, table: str, keys: Sequence[str], overwrite: str) -> None:
        """Through a table beside it, as the rows may come from the files that are replaced."""
        beside = f"{self.root}/beside-{uuid.uuid4().hex}"
        df.write.parquet(beside)
        kept = self.spark.read.parquet(beside)
        dealt = kept.repartition("year", "month").sortWithinPartitions("year", "month", *keys)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", overwrite).partitionBy("year", "month").parquet(self.path(table))
        path = self.spark._jvm.org.apache.hadoop.fs.Path(beside)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    @staticmethod
    def _months(df: DataFrame, date: str) -> DataFrame:
        if date not in df.columns:
            raise KeyError(date)
        dated = df.where(F.col(date).isNotNull())
        return dated.withColumns({"year": F.year(date).cast("int"), "month": F.month(date).cast("int")})

    def upsert_by_month(self, df: DataFrame, table: str, *, date: str, keys: Sequence[str], order: Sequence[str] = ()) -> list[tuple[int, int]]:
        """Merges the rows into the months that they touch, which are returned; other months aren't read or written. Rows without a date are left out."""
        new = self._months(df, date)
        touched = new.select("year", "month").distinct()
        months = [(r.year, r.month) for r in touched.orderBy("year", "month").collect()]
        if not months:
            return []
        existing = self.read_optional(table)
        if existing is not None:
            # literal months, so that only their directories are listed and read
            wanted = F.lit(False)
            for y, m in months:
                wanted = wanted | ((F.col("year") == y) & (F.col("month") == m))
            existing = existing.where(wanted)
        self._write_months(merge_by_key(existing, new, keys, order), table, keys, "dynamic")
        return months

    def replace_by_month(self, df: DataFrame, table: str, *, date: str, keys: Sequence[str]) -> None:
        """The whole table, one row for each key."""
        self._write_months(merge_by_key(None, self._months(df, date), keys), table, keys, "static")

    def replace_checked(self, df: DataFrame, table: str, *, date: str, keys: Sequence[str], flags: Mapping[str, Column] | None = None) -> dict[str, int]:
        """As replace_by_month, but published only if `rows` share no key and every flag (a count of bad rows) is zero, else CheckFailed; the counts are returned.

        The input is computed once: the write beside the table counts what it writes, and keys are counted in the shuffle that brings their rows together. The table that was there stays
        until the new one is whole, and then makes way for it by a rename. Tasks that run again may be counted again, which makes no zero of a count and no count of a zero.
        """
        rows = self._months(df, date)
        counted = rows.withColumn("__same", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        seen = Observation(f"{table}-{uuid.uuid4().hex}")
        metrics = {"primary_key_unique": F.coalesce(F.sum(F.when(F.col("__same") > 1, 1).otherwise(0)), F.lit(0)), **(flags or {})}
        counted = counted.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.cast("long").alias(n) for n, c in metrics.items())).drop("__same")
        beside = f"{self.root}/beside-{uuid.uuid4().hex}"
        counted.repartition("year", "month").sortWithinPartitions("year", "month", *keys).write.partitionBy("year", "month").parquet(beside)
        found = {n: int(v) for n, v in seen.get.items()}
        bad = {n: v for n, v in found.items() if n != "rows" and v}
        if bad:
            self._delete(beside)
            raise CheckFailed(table, bad)
        self._swap(beside, self.path(table))
        return found

    def _system(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _delete(self, path: str) -> None:
        system, at = self._system(path)
        system.delete(at, True)

    def _swap(self, new: str, table: str) -> None:
        system, at = self._system(table)
        old = self._system(f"{self.root}/replaced-{uuid.uuid4().hex}")[1]
        there = system.exists(at)
        if there and not system.rename(at, old):
            raise OSError(f"{table} can't be moved")
        system.mkdirs(at.getParent())
        if not system.rename(self._system(new)[1], at):
            if there:
                system.rename(old, at)
            raise OSError(f"{new} can't be moved to {table}")
        if there:
            system.delete(old, True)

    def write_month(self, df: DataFrame, table: str, year: int, month: int) -> None:
        """Exactly one partition."""
        rows = df.withColumns({"year": F.lit(year), "month": F.lit(month)})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(self.path(table))

    def clear(self, table: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def partition_columns(self, table: str) -> dict[str, list[str]]:
        """Ordered column names of each month's files, from their footers."""
        return {f"{y}-{m:02d}": self.spark.read.parquet(f"{self.path(table)}/year={y}/month={m}").columns for y, m in self.partitions(table)}
