"""Branches: a base as of a transaction with an overlay whose numbers are shifted behind it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .temporal import folded, squashed


def merged(upstream: DataFrame, downstream: DataFrame, n: int) -> DataFrame:
    """Upstream rows with t <= n, then downstream rows with t + n + 1."""
    shifted = downstream.withColumn("t", F.col("t") + n + 1)
    return upstream.filter(F.col("t") <= n).unionByName(shifted)


def merged_streams(upstream: DataFrame, upstream_id: str, downstream: DataFrame, downstream_id: str, n: int, id_columns: list[str]) -> DataFrame:
    """merged(), with local ids (struct of stream_id and id) qualified by the stream they come from."""

    def qualified(df: DataFrame, stream: str) -> DataFrame:
        for c in id_columns:
            own = F.struct(F.coalesce(F.col(c)["stream_id"], F.lit(stream)).alias("stream_id"), F.col(c)["id"].alias("id"))
            df = df.withColumn(c, F.when(F.col(c)["id"].isNull(), F.col(c)).otherwise(own))
        return df

    return merged(qualified(upstream, upstream_id), qualified(downstream, downstream_id), n)


def overlaid(base: DataFrame, overlay: DataFrame, n: int) -> DataFrame:
    """Two-way merge without a shift: base with t <= n and all of the overlay."""
    return base.filter(F.col("t") <= n).unionByName(overlay)


def branch_state(base: DataFrame, overlay: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    return folded(merged(base, overlay, n), keys or ["e", "a", "v"])


def branch_last(n: int, overlay: DataFrame) -> DataFrame:
    """The branch's last transaction number."""
    return overlay.agg((F.coalesce(F.max("t"), F.lit(-1)) + n + 1).alias("t"))


def squashed_commit(log: DataFrame, overlay: DataFrame) -> DataFrame:
    """The log with the overlay's net effect as one further transaction."""
    last = log.agg(F.coalesce(F.max("t"), F.lit(-1)).alias("last"))  # one row
    net = squashed(overlay).crossJoin(F.broadcast(last)).select((F.col("last") + 1).alias("t"), F.lit(0).alias("seq"), "op", "e", "a", "v")
    return log.select("t", "seq", "op", "e", "a", "v").unionByName(net)


def with_tail(snapshot: DataFrame, snapshot_t: int, log: DataFrame) -> DataFrame:
    """A stored snapshot's datoms and those of the log behind it."""
    return snapshot.unionByName(log.filter(F.col("t") > snapshot_t).select(*snapshot.columns))
