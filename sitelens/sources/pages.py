"""O5 for deep pages: a sorted table whose page directory says which files hold a page.

``OFFSET`` ranks every row before the page.  Here rows are written once, dealt out by
ranges of the sort key and sorted, in files of at most ``rows_per_file`` rows whose names
follow the order.  The directory - one row per file: its first position and its rows -
is read under a filter on the position, so page n opens the directory's rows and the
files of page n alone, however deep the page lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.plans.listings import Page


class PagedTable:
    """The table under ``path`` in the order ``sort``: (column, ascending) pairs that end with a unique key."""

    def __init__(self, spark: SparkSession, path: str, sort: list[tuple[str, bool]]):
        self.spark, self.path, self.sort = spark, path.rstrip("/"), sort

    @property
    def order(self) -> list[Column]:
        return [F.asc(c) if a else F.desc(c) for c, a in self.sort]

    def write(self, df: DataFrame, rows_per_file: int = 1_000_000) -> None:
        rows = df.repartitionByRange(*self.order).sortWithinPartitions(*self.order)
        rows.write.option("maxRecordsPerFile", rows_per_file).parquet(f"{self.path}/rows")
        # File names begin with the number of their range and end with their number in it.
        name = F.col("_metadata.file_name")
        part = F.regexp_extract(name, r"^part-(\d+)", 1).cast("bigint")
        nth = F.regexp_extract(name, r"-c(\d+)\.", 1).cast("bigint")
        files = (self.spark.read.schema(df.schema).parquet(f"{self.path}/rows").groupBy(
            name.alias("file"), part.alias("part"), nth.alias("nth")).agg(F.count(F.lit(1)).alias("n")))
        # Positions: within a range by a window, between ranges by the ranges' totals.
        totals = files.groupBy("part").agg(F.sum("n").alias("t")).select("part", F.coalesce(F.sum("t").over(
            Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        inner = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
        place = files.withColumn("inside", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(totals, "part")
        place.select("file", (F.col("before") + F.col("inside")).alias("first"), "n").repartitionByRange(
            "first").sortWithinPartitions("first").write.parquet(f"{self.path}/directory")

    def directory(self) -> DataFrame:
        return self.spark.read.schema("file string, first bigint, n bigint").parquet(f"{self.path}/directory")

    def count(self) -> int:
        return self.directory().agg(F.coalesce(F.max(F.col("first") + F.col("n")), F.lit(0))).first()[0]

    def page(self, page: Page) -> DataFrame:
        """The rows of a page, in order: the answer of OFFSET and LIMIT over the whole table."""
        end = page.offset + page.size
        hit = self.directory().where((F.col("first") < end) & (F.col("first") + F.col("n") > page.offset)).collect()
        whole = self.spark.read.schema(self.spark.read.parquet(f"{self.path}/rows").schema)
        if not hit:
            return whole.parquet(f"{self.path}/rows").limit(0)
        rows = whole.parquet(*[f"{self.path}/rows/{r['file']}" for r in hit])
        return rows.orderBy(*self.order).offset(page.offset - min(r["first"] for r in hit)).limit(page.size)
