"""A database: a log, named views over its states, and transactions that append to it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import branch, shred
from ..operators.index import Index
from ..operators.temporal import expanded_sets, propositions, squashed

LOG = "t long, seq int, op string, e string, a string, v string"


@dataclass(frozen=True)
class Database:
    """views: name -> (column order, function of a state). t: the transaction that a value is pinned at."""

    log: DataFrame
    views: dict[str, tuple[list[str], Callable[[DataFrame], DataFrame]]] = field(default_factory=dict)
    t: int | None = None

    def last_transaction(self) -> int:
        found = self.log.agg(F.max("t")).first()[0]
        return -1 if found is None else found

    def pinned(self) -> Database:
        """The database as it is now, whatever is added later."""
        return self if self.t is not None else replace(self, t=self.last_transaction())

    def datoms(self) -> DataFrame:
        return expanded_sets(self.log if self.t is None else self.log.filter(F.col("t") <= self.t))

    def state(self) -> DataFrame:
        return propositions(self.datoms())

    def index(self, name: str) -> Index:
        if name not in self.views:
            raise KeyError(f"no index {name}; there are {sorted(self.views)}")
        columns, view = self.views[name]
        return Index(name, columns, view(self.state()))

    def transact(self, statements: list[tuple]) -> Database:
        """statements: (op, e, a, v); a database value with one more transaction.

        For a few transactions in memory; Store keeps many on disk.
        """
        if self.t is not None:
            raise ValueError("a pinned value can't be changed")
        t = self.last_transaction() + 1
        spark = self.log.sparkSession
        rows = spark.createDataFrame([(t, k, *s) for k, s in enumerate(statements)], LOG)
        return replace(self, log=self.log.unionByName(rows))

    def transact_temporary(self, statements: list[tuple], next_id: int, validate: Callable[[DataFrame], bool] | None = None) -> tuple[Database, DataFrame]:
        """Like transact, with ids "tmp/..." replaced by new dense ones; also gives the resolution."""
        spark = self.log.sparkSession
        rows = spark.createDataFrame([(k, *s) for k, s in enumerate(statements)], "seq int, op string, e string, a string, v string")
        resolution = shred.temporary_ids(rows, next_id)
        made = shred.resolved(rows, resolution)
        if validate is not None and not validate(made):
            raise ValueError("the changes were not accepted")
        t = self.last_transaction() + 1
        return replace(self, log=self.log.unionByName(made.select(F.lit(t).cast("long").alias("t"), "seq", "op", "e", "a", "v"))), resolution


@dataclass(frozen=True)
class Overlay:
    """Local transactions that are not committed yet, on top of a database (a client's view of a server).

    Local numbers follow the base's pinned last one; others' transactions show after refresh().
    """

    base: Database
    local: Database

    def log(self) -> DataFrame:
        return branch.merged(self.base.log, self.local.log, self.base.t)

    def state(self) -> DataFrame:
        return propositions(expanded_sets(self.log()))

    def transact(self, statements: list[tuple]) -> Overlay:
        return replace(self, local=self.local.transact(statements))

    def statements(self) -> DataFrame:
        """The net effect of the local transactions (op, e, a, v)."""
        return squashed(self.local.log)

    def refresh(self, base: Database) -> Overlay:
        """The local transactions on top of a newer database."""
        return replace(self, base=base.pinned())

    def committed(self, base: Database) -> Database:
        """base, as it is now, with the net effect as one more transaction."""
        return replace(base, log=branch.squashed_commit(base.log, self.local.log), t=None)


def overlaid(base: Database) -> Overlay:
    return Overlay(base.pinned(), empty(base.log.sparkSession, base.views))


def empty(spark: SparkSession, views: dict | None = None) -> Database:
    return Database(spark.createDataFrame([], LOG), views or {})
