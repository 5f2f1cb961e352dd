"""Language identification by bit-sliced Bloom filters of character n-grams.

Each slot of one table holds a bit for every language, so the AND of the slots
that an n-gram hashes to gives all languages whose training text holds it. A
text's n-grams are counted by language; a language with fill f in its slice
answers falsely with probability f^k, and the count is corrected for that:
(hits - n p) / (1 - p). The language with the largest corrected count is
predicted; the score is its share of all corrected counts.

Training: of each language, at most about max_rows over the number of languages
labelled rows, chosen by a hash of the id, so rare languages are learned from
all their rows; of their n-grams, by texts' pieces, the max_grams most frequent ones for each
language that occur min_count times or more and are not over ratio times as
frequent in another language. Of over max_langs labels the ones with most rows
are learned. So model and broadcast are bounded (table_bits, a word for each 64
languages) whatever the input.

Cases: a null text, or one without letters, gives "und" with score 0. A text
none of whose n-grams is known gives the language with most training rows, with
score 0. Of languages with equal counts the first by name is predicted. Null
ids and repeated rows pass through, a result row for each input row (in
training, repeated rows count as often as they are there). Without training
rows every text gives "und". Texts of over PIECE characters are counted in
pieces, cut at spaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import sample_bound, sampled
from ._text import mix, slices

SIZES = (3, 4)
PIECE = 1 << 20  # characters whose n-grams are held at once
SLICE = 1 << 20  # bytes of text, likewise
UND = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram hashes, the text of each one, whether a text has letters).

    Over lower-case letters, with one space for anything else and around a text.
    """
    joined = np.frombuffer("".join(f" {t.lower()} " for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t.lower()) + 2 for t in texts])
    letter = _letters()[joined]
    has = np.zeros(len(texts), dtype=bool)
    has[owner[letter]] = True
    keep = letter | np.append(False, letter[:-1]) | np.append(letter[1:], False)
    # a space after a letter and the one before the next letter are one, unless they are the same already
    both = ~letter & np.append(False, ~letter[:-1]) & keep & np.append(False, keep[:-1]) & (owner == np.append(-1, owner[:-1]))
    keep &= ~both
    chars = np.where(letter, joined, 32)[keep].astype(np.uint64)
    own = owner[keep]
    out, at = [], []
    for n in SIZES:
        if len(chars) >= n:
            packed = np.zeros(len(chars) - n + 1, dtype=np.uint64)
            for k in range(n):
                packed = packed * np.uint64(0x1000003D) + chars[k : len(chars) - n + 1 + k]
            same = own[: len(own) - n + 1] == own[n - 1 :]
            out.append(mix(packed[same] ^ np.uint64(n << 60)))
            at.append(own[: len(own) - n + 1][same])
    return (np.concatenate(out), np.concatenate(at), has) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64), has)


def pieces(text: str, size: int = PIECE) -> list[str]:
    """The text cut at spaces, or else anywhere, into parts of at most size characters."""
    out, at = [], 0
    while len(text) - at > size:
        end = text.rfind(" ", at, at + size)
        end = end if end > at else at + size
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


class BitSlicedFilter:
    def __init__(self, langs: list[str], rows: list[int], known: list[np.ndarray], hashes: int = 3, table_bits: int = 22):
        self.langs, self.hashes, self.bits = langs, hashes, table_bits
        self.default = int(np.argmax(rows)) if rows else -1
        kinds = (np.uint8, np.uint16, np.uint32, np.uint64)
        kind = next((k for k in kinds if np.dtype(k).itemsize * 8 >= len(langs)), np.uint64)
        self.width = np.dtype(kind).itemsize * 8
        self.tables = [np.zeros(1 << table_bits, dtype=kind) for _ in range(-(-len(langs) // self.width))]
        for k, g in enumerate(known):
            table, bit = self.tables[k // self.width], kind(1 << k % self.width)
            for slots in self._slots(g):
                table[slots] |= bit
        fill = [np.count_nonzero(self._bit(self.tables, k)) / (1 << table_bits) for k in range(len(langs))]
        self.false = np.array(fill) ** hashes

    def _bit(self, words: list[np.ndarray], k: int) -> np.ndarray:
        word = words[k // self.width]
        return word >> word.dtype.type(k % self.width) & word.dtype.type(1)

    def _slots(self, g: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(self.hashes):
            yield (mix(g + np.uint64(0x51ED27 * (k + 1))) >> np.uint64(64 - self.bits)).astype(np.int64)

    def languages(self, g: np.ndarray) -> list[np.ndarray]:
        """A bit mask of the languages that hold each n-gram, in words."""
        masks: list[np.ndarray] = []
        for slots in self._slots(g):
            masks = [m & t[slots] for m, t in zip(masks, self.tables)] if masks else [t[slots] for t in self.tables]
        return masks

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n-grams that each language answers for, by language and text; n-grams of each text; whether it has letters)"""
        g, own, has = grams(texts)
        masks = self.languages(g)
        n = np.bincount(own, minlength=len(texts)).astype(float)
        found = [np.bincount(own, weights=self._bit(masks, k), minlength=len(texts)) for k in range(len(self.langs))]
        return (np.stack(found) if found else np.zeros((0, len(texts)))), n, has

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        parts = [pieces(t) for t in texts]
        first = np.cumsum([0, *map(len, parts)])[:-1]
        hits, n, has = self.hits([p for ps in parts for p in ps])
        if len(first):
            hits, n, has = np.add.reduceat(hits, first, axis=1), np.add.reduceat(n, first), np.logical_or.reduceat(has, first)
        sure = np.maximum((hits - n * self.false[:, None]) / (1 - self.false[:, None]), 0)
        total = sure.sum(axis=0)
        names, scores = [], []
        for k in range(len(texts)):
            if not has[k] or not self.langs:
                names.append(UND), scores.append(0.0)
            elif total[k] <= 0:
                names.append(self.langs[self.default]), scores.append(0.0)
            else:
                best = int(np.argmax(sure[:, k]))
                names.append(self.langs[best]), scores.append(float(sure[best, k] / total[k]))
        return names, scores


def training_rows(rows: DataFrame, max_rows: int, max_langs: int) -> tuple[DataFrame, dict[str, int]]:
    """(text, lang of the chosen rows; the number of rows of each language that is learned)"""
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs)
    sizes = {r["lang"]: r["n"] for r in counts.collect()}
    each = max(1, max_rows // max(1, len(sizes)))
    bounds = rows.sparkSession.createDataFrame([(lang, sample_bound(each, n)) for lang, n in sizes.items()], "lang string, bound long")
    chosen = rows.join(F.broadcast(bounds), "lang").filter(sampled(F.col("bound"), "train", "id"))  # at most max_langs rows
    return chosen.select("lang", "text"), sizes


def gram_counts(chosen: DataFrame) -> DataFrame:
    """(lang, gram, n) over rows (lang, text)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, size=SLICE):
            parts = [pieces(t.decode()) for t in texts]
            langs = np.repeat(np.array(batch.column(0).to_pylist()), [len(p) for p in parts])
            g, own, _ = grams([p for ps in parts for p in ps])
            for lang in np.unique(langs):
                values, counts = np.unique(g[(langs == lang)[own]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])

    return chosen.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def trained(rows: DataFrame, max_rows: int = 20_000, max_grams: int = 65_536, min_count: int = 3, ratio: float = 20.0, max_langs: int = 256) -> BitSlicedFilter:
    """rows: id, text, lang, all labelled."""
    chosen, sizes = training_rows(rows, max_rows, max_langs)
    counts = gram_counts(chosen).filter(F.col("n") >= min_count)
    by_lang, by_gram = W.partitionBy("lang"), W.partitionBy("gram")
    part = counts.withColumn("part", F.col("n") / F.sum("n").over(by_lang))
    own = part.withColumn("most", F.max("part").over(by_gram)).filter(F.col("part") * ratio >= F.col("most"))
    top = own.withColumn("place", F.row_number().over(by_lang.orderBy(F.desc("n"), "gram"))).filter(F.col("place") <= max_grams)
    known: dict[str, list[int]] = {}
    for r in top.select("lang", "gram").toLocalIterator():  # bounded by languages times max_grams
        known.setdefault(r["lang"], []).append(r["gram"])
    langs = sorted(known)
    return BitSlicedFilter(langs, [sizes[x] for x in langs], [np.array(known[x], dtype=np.int64).view(np.uint64) for x in langs])


def identified(df: DataFrame, model: BitSlicedFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score for each row of df."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, size=SLICE):
            names, scores = shared.value.predict([t.decode() for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    return rows.mapInArrow(run, T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
