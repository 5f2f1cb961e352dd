"""A database on shared storage: a Parquet log, views kept up with it, and snapshots of both.

One writer appends; readers see whole transactions, since a batch of them is one
job's files. A view is stored as its changes (its columns, op, t), in a folder
for each catch-up named by its last transaction, so what a catch-up that was
cut off has written is replaced by the next one.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import views as V
from ..operators.temporal import expanded_sets, propositions
from . import log as logs
from .database import LOG, Database


class Store:
    """views: name -> (column order, function of a state, whether its rows depend on one entity each)."""

    def __init__(self, spark: SparkSession, path: str, views: dict[str, tuple[list[str], Callable[[DataFrame], DataFrame], bool]] | None = None, bucket: int = 500):
        self.spark, self.path, self.views, self.bucket = spark, path, views or {}, bucket
        fs, target = logs._fs(spark, f"{path}/log")
        self._last = logs.last_transaction(spark, f"{path}/log") if fs.exists(target) else -1

    def last_transaction(self) -> int:
        return self._last

    def log(self, first: int = 0, last: int | None = None) -> DataFrame:
        if self._last < 0:
            return self.spark.createDataFrame([], LOG)
        return logs.read(self.spark, f"{self.path}/log", first, last, self.bucket)

    def transact(self, *batches: list[tuple]) -> int:
        """A transaction for each list of statements (op, e, a, v), written together; the last one's number."""
        rows = [(self._last + 1 + k, seq, *s) for k, statements in enumerate(batches) for seq, s in enumerate(statements)]
        if rows:
            logs.append(self.spark.createDataFrame(rows, LOG).coalesce(1), f"{self.path}/log", self.bucket)
        self._last += len(batches)
        return self._last

    def append(self, statements: DataFrame) -> int:
        """One transaction with the rows (op, e, a, v, and seq if order matters) of a table of any size."""
        seq = F.col("seq").cast("int") if "seq" in statements.columns else F.lit(0)
        rows = statements.select(F.lit(self._last + 1).cast("long").alias("t"), seq.alias("seq"), "op", "e", "a", "v")
        logs.append(rows, f"{self.path}/log", self.bucket)
        self._last += 1
        return self._last

    def database(self, t: int | None = None) -> Database:
        """A database value: the log as it is now."""
        return Database(self.log(), {n: v[:2] for n, v in self.views.items()}, self._last if t is None else t)

    def state(self, t: int | None = None) -> DataFrame:
        return propositions(expanded_sets(self.log(last=t)))

    def _caught(self, name: str) -> list[int]:
        """The transactions up to which parts of the view are stored whole."""
        return logs.snapshots(self.spark, f"{self.path}/views/{name}")

    def catch_up(self, name: str, t: int | None = None) -> int:
        """Store the changes of a view since its last catch-up, up to t or now; the transaction that it is at then."""
        _, view, by_entity = self.views[name]
        last, now = max(self._caught(name), default=-1), self._last if t is None else min(t, self._last)
        if last >= now:
            return last
        rows = self.log(last=now)
        if by_entity:  # entities that the new transactions do not touch have no changes
            rows = rows.join(self.log(last + 1, now).select("e").distinct(), "e", "left_semi")
        logs.store_snapshot(V.changes_after(view, expanded_sets(rows), last, by_entity), f"{self.path}/views/{name}", now)
        return now

    def changes(self, name: str) -> DataFrame:
        """The stored changes of a view (its columns, op, t)."""
        folders = [f"{self.path}/views/{name}/t={t}" for t in self._caught(name)]
        if not folders:
            raise KeyError(f"nothing of view {name} is stored")
        return self.spark.read.parquet(*folders)

    def view(self, name: str, t: int | None = None) -> DataFrame:
        """The stored view as of t or its last catch-up."""
        stored = self.changes(name)
        return propositions(stored, t, [c for c in stored.columns if c not in ("t", "op")])


class Objects:
    """Values by key on shared storage: put, get, remove and keys; one file for each, bytes or JSON."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _file(self, key: str):
        return logs._fs(self.spark, f"{self.path}/{key.encode().hex()}")

    def put(self, key: str, value: bytes) -> None:
        fs, target = self._file(key)
        out = fs.create(target, True)
        try:
            out.write(bytearray(value))
        finally:
            out.close()

    def get(self, key: str) -> bytes | None:
        fs, target = self._file(key)
        if not fs.exists(target):
            return None
        source = fs.open(target)
        try:
            return bytes(b & 255 for b in source.readAllBytes())
        finally:
            source.close()

    def put_json(self, key: str, value) -> None:
        self.put(key, json.dumps(value).encode())

    def get_json(self, key: str):
        found = self.get(key)
        return None if found is None else json.loads(found)

    def remove(self, key: str) -> bool:
        fs, target = self._file(key)
        return fs.delete(target, False)

    def keys(self) -> list[str]:
        fs, target = logs._fs(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []
        return sorted(bytes.fromhex(n).decode() for n in names if not n.startswith((".", "_")))


class Counter:
    """A number that survives its process: add() gives the new one."""

    def __init__(self, objects: Objects, key: str, initial: int = 0):
        self.objects, self.key = objects, key
        found = objects.get_json(key)
        self.value = initial if found is None else found

    def add(self, n: int = 1) -> int:
        self.objects.put_json(self.key, self.value + n)
        self.value += n
        return self.value
