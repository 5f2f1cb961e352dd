"""Quality selection by importance resampling over hashed n-grams.

Two bags of hashed word and word-pair counts are gathered: one over all texts,
one over the target (texts labelled good). The log ratio of the two models is
shrunk towards 0 where the counts are few (PRIOR pseudo-counts for each bucket).

A text's log weight is the log likelihood ratio of its n-grams under the two
models: their log ratios summed. Its temperature is 1 up to TEMPERED n-grams
and n / TEMPERED for a text of n n-grams, since n-grams of a text are far from
independent: a long text counts as TEMPERED of them. Log weights are perturbed with Gumbel noise
seeded by the id, and the k texts with the largest keys are kept. That is a
sample of k texts without replacement, with probabilities in proportion to the
weights: texts near the k-th key are drawn by chance, far from it they are
almost sure to be in or out.

k is set before any text is weighed: the number of texts times the share of
good ones among all labels, plus two standard errors of that share (or
keep_share, if given). Only the target is sampled: at most about max_labels
good labels, chosen by a hash of the id. Counts, weights and the selection
cover all rows.

Cases: null and empty texts have weight 0, no key and are not kept. Ids may be
of any type. Null ids are scored, with one noise value for all of them; they
are never labelled. Repeated rows have equal keys, and all rows with the k-th
largest key are kept. Without good or without bad labels all texts with words
are kept. Empty tables give empty results. Extra columns, of any names, are
carried by selected() and not read by scored().
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import cut, sample_bound, sampled
from ._text import mix, slices, word_hashes

BITS = 17
PRIOR = 5.0
TEMPERED = 32


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words and pairs, the text of each)."""
    words, first = word_hashes(texts, marks=True)
    own = np.repeat(np.arange(len(texts)), np.diff(first))
    pairs = mix(words[:-1] * np.uint64(0x9FB21C651E98DF25) + words[1:])[own[:-1] == own[1:]] if len(words) > 1 else words[:0]
    own_pairs = own[:-1][own[:-1] == own[1:]] if len(words) > 1 else own[:0]
    shift = np.uint64(64 - BITS)
    return (np.concatenate([words, pairs]) >> shift).astype(np.int64), np.concatenate([own, own_pairs])


def noise(hashes: np.ndarray, seed: int) -> np.ndarray:
    """A Gumbel value for each id's hash."""
    h = mix(hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    u = ((h >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
    return -np.log(-np.log(u))


@dataclass
class Weights:
    ratio: np.ndarray
    seed: int
    share: float  # of the texts that are to be kept
    least: float = -np.inf  # the k-th largest key

    def weigh(self, hashes: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log weights, numbers of n-grams, keys)"""
        at, own = buckets(texts)
        n = np.bincount(own, minlength=len(texts))
        weight = np.bincount(own, weights=self.ratio[at], minlength=len(texts)) * np.minimum(1.0, TEMPERED / np.maximum(n, 1))
        return weight, n, np.where(n > 0, weight + noise(hashes, self.seed), np.nan)


def _hashed(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def good_share(good: int, bad: int) -> float:
    """The share of good ones in all labels, and two standard errors; 1 if a kind is missing."""
    n = good + bad
    if not good or not bad:
        return 1.0
    p = good / n
    return min(1.0, p + 2 * math.sqrt(p * (1 - p) / n))


def fitted(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labels: int = 20_000, keep_share: float | None = None, seed: int = 7) -> Weights:
    """The log ratios, and the share to keep."""
    spark = df.sparkSession
    told = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    sizes = {r[0]: r[1] for r in told.groupBy("quality").count().collect()}  # two rows
    chosen = told.filter((F.col("quality") == 1) & sampled(sample_bound(max_labels, sizes.get(1, 0)), "label", "doc_id"))
    known = np.sort(np.array([r[0] for r in chosen.select(F.xxhash64(F.col("doc_id").cast(df.schema[id_col].dataType))).collect()], dtype=np.int64))  # about max_labels ids
    if sizes.get(1, 0) and not len(known):
        raise ValueError("no label was chosen")
    target_ids = spark.sparkContext.broadcast(known)
    ident = F.col(f"`{id_col}`")
    rows = df.select(F.when(ident.isNotNull(), F.xxhash64(ident)).alias("h"), F.col(f"`{text_col}`").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch, texts in slices(batches):
            at, own = buckets(texts)
            raw += np.bincount(at, minlength=1 << BITS)
            named = np.isin(_hashed(batch.column(0).fill_null(0)), target_ids.value) & ~_hashed(batch.column(0).is_null()).astype(bool)
            target += np.bincount(at[named[own]], minlength=1 << BITS)
        filled = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array(raw[filled]), pa.array(target[filled])], names=["bucket", "n", "good"])

    counts = rows.mapInArrow(count, "bucket int, n long, good long").groupBy("bucket").agg(F.sum("n"), F.sum("good"))
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for b, n, g in counts.toLocalIterator():  # 2**BITS rows at most
        raw[b], target[b] = n, g
    expected = raw * (target.sum() / max(raw.sum(), 1.0))
    share = good_share(sizes.get(1, 0), sizes.get(0, 0)) if keep_share is None else keep_share
    return Weights(np.log((target + PRIOR) / (expected + PRIOR)), seed, share)


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 1024, enough: int = 10_000) -> float:
    """The exact k-th largest value, by narrowing a histogram until few values are left."""
    if k <= 0:
        return np.inf
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if n <= k:
        return -np.inf
    while n > enough and low < high:
        part = F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / F.lit((high - low) / bins)))
        inside = df.filter(F.col(column).between(low, high))
        found = sorted(inside.groupBy(part.alias("b")).agg(F.min(column), F.max(column), F.count("*")).collect(), reverse=True)  # bins rows
        for _, least, most, c in found:
            if k <= c:
                low, high, n = least, most, c
                break
            k -= c
    top = df.filter(F.col(column).between(low, high)).orderBy(F.desc(column)).select(column).limit(k) if low < high else None
    return float(low) if top is None else float(top.agg(F.min(column)).first()[0])


def weighed(df: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, log_weight, n_features and key for each row of df."""
    ident = F.col(f"`{id_col}`")
    rows = df.select(ident.alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(ident).alias("h"))
    shared = df.sparkSession.sparkContext.broadcast(weights)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            weight, n, key = shared.value.weigh(_hashed(batch.column(2)), texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight), pa.array(n, pa.int64()), pa.array(key, from_pandas=True)], names=[id_col, "log_weight", "n_features", "key"])

    fields = [(id_col, rows.schema["id"].dataType), ("log_weight", T.DoubleType()), ("n_features", T.LongType()), ("key", T.DoubleType())]
    return rows.mapInArrow(run, T.StructType([T.StructField(*f) for f in fields]))


def scored(df: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, log_weight, n_features, key and kept for each row of df; sets weights.least, the k-th largest key.

    Texts are read once; the k-th key is found in the table that is written.
    """
    table = cut(weighed(df, weights, id_col, text_col))
    k = math.ceil(weights.share * table.count())
    weights.least = kth_largest(table.filter("n_features > 0"), "key", k)
    return table.withColumn("kept", (F.col("n_features") > 0) & (F.col("key") >= weights.least))


def selected(df: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows of df, with df's columns; weighed once more where they are read, so texts are not shuffled."""
    scored(df, weights, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(weights)
    text_at = [c.lower() for c in df.columns].index(text_col.lower())
    # texts are sent once, in their rows, since Spark's batches are by rows
    rows = df.select(F.xxhash64(F.col(f"`{id_col}`")).alias("h"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = (pa.RecordBatch.from_arrays([b.column(0), b.column(1).field(text_at), b.column(1)], names=["h", "text", "row"]) for b in batches)
        for batch, texts in slices(named):
            _, n, key = shared.value.weigh(_hashed(batch.column(0)), texts)
            yield batch.select(["row"]).filter(pa.array((n > 0) & (key >= shared.value.least)))

    return rows.mapInArrow(run, T.StructType([T.StructField("row", T.StructType(df.schema.fields))])).select("row.*")
