"""Indexes: a DataFrame with a declared column order, read by prefix, range and neighbour."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import patterns as P


@dataclass(frozen=True)
class Index:
    name: str
    columns: list[str]
    df: DataFrame

    def row(self, width: int | None = None) -> Column:
        return F.struct(*[F.col(c) for c in self.columns[:width]])

    def ordered(self, df: DataFrame | None = None, reverse: bool = False) -> DataFrame:
        keys = [F.col(c).desc() if reverse else F.col(c).asc() for c in self.columns]
        return (df if df is not None else self.df).orderBy(*keys)

    def scan(self, start: list | None = None, reverse: bool = False) -> DataFrame:
        """Rows from a start row on, in index order; backwards, rows up to it.

        Backwards, a start row that is a prefix includes all its extensions.
        """
        if not start:
            return self.ordered(reverse=reverse)
        key = F.struct(*[F.lit(v).alias(c) for c, v in zip(self.columns, start)])
        width = len(start)
        bound = self.row(width) <= key if reverse else self.row(width) >= key
        if width == 1:
            c = F.col(self.columns[0])
            bound = c <= F.lit(start[0]) if reverse else c >= F.lit(start[0])
        return self.ordered(self.df.filter(bound), reverse)

    def from_pattern(self, pattern: list, reverse: bool = False) -> DataFrame:
        """The tail of the index from the pattern's start row on, not only matches."""
        return self.scan([v for v in P.constant_prefix(pattern)] or None, reverse)

    def filter_by_pattern(self, pattern: list, reverse: bool = False) -> DataFrame:
        """The tail, with trailing conditions applied if there are any."""
        out = self.from_pattern(pattern, reverse)
        return P.matching(out, self.columns, pattern) if P.has_trailing_conditions(pattern) else out

    def matches(self, pattern: list, strict: bool = False) -> DataFrame:
        return P.matching(self.df, self.columns, pattern, strict)

    def substitutions(self, pattern: list, strict: bool = False) -> DataFrame:
        """One row for each matching row, one column for each variable."""
        return self.matches(pattern, strict).select(*P.bindings(self.columns, pattern))

    def select(self, pattern: list) -> DataFrame:
        """Matching rows cut to the pattern's length; a bag."""
        P.check_pattern(self.columns, pattern)
        return self.matches(pattern).select(*self.columns[: len(pattern)])

    def select_unique(self, pattern: list) -> DataFrame:
        return self.select(pattern).distinct()

    def unique_prefix(self, width: int) -> DataFrame:
        return self.df.select(*self.columns[:width]).distinct()

    def unique_substitutions(self, pattern: list) -> DataFrame:
        rows = P.matching(self.unique_prefix(len(pattern)), self.columns, pattern)
        return rows.select(*P.bindings(self.columns, pattern)).distinct()

    def first(self, reverse: bool = False) -> DataFrame:
        return self.ordered(reverse=reverse).limit(1)

    def neighbour(self, value: Any, kind: str) -> DataFrame:
        """One row (neighbour): the least value ge or gt, or the largest lt or le, of the first column."""
        c, v = F.col(self.columns[0]), F.lit(value)
        condition, best = {"ge": (c >= v, F.min), "gt": (c > v, F.min), "lt": (c < v, F.max), "le": (c <= v, F.max)}[kind]
        return self.df.filter(condition).agg(best(c).alias("neighbour"))

    def permuted(self, name: str, columns: list[str]) -> Index:
        return Index(name, columns, self.df.select(*columns))

    def stored(self, path: str, partitions: int | None = None) -> None:
        """Sorted Parquet, range-partitioned by the leading columns, so scans are pruned by statistics."""
        keys = [F.col(c) for c in self.columns[:2]]
        ranged = self.df.repartitionByRange(partitions, *keys) if partitions else self.df.repartitionByRange(*keys)
        ranged.sortWithinPartitions(*self.columns).write.mode("overwrite").parquet(path)


def row_set(spark: SparkSession, name: str, schema: str, rows: list[tuple]) -> Index:
    """An index from literal rows; equal rows collapse."""
    df = spark.createDataFrame(rows, schema).distinct()
    return Index(name, df.columns, df)
