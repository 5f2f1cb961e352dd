"""Exact token counts of every prefix, for a sentencepiece BPE model.

No piece holds a space mark after another character, so a text falls into
chunks (space marks and the characters up to the next one) that are encoded
apart. Within a chunk, dynamic programming over prefixes gives the count at
each place: of the pieces that end there exactly one is compatible with the
last piece of the prefix before it. The counts at all places of a chunk are
stored; with the sums over chunks they are the count at every prefix of the
text, so truncation and budget questions are looked up, and nothing is encoded
again. Distinct chunks are counted once for a worker process, within a bounded cache.

Cases: a null text counts as empty (0 tokens). Null ids, repeated rows and
empty tables pass through, a result row for each input row. Very long texts are
processed whole. Input columns other than id and text are not read.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from operator import itemgetter

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bpe_core import Bounded, Merges

SPACE = "▁"
LAST = itemgetter(-1)


def merge_tables(model: sentencepiece.SentencePieceProcessor) -> Merges:
    """Pieces by rank; each one's last merge comes from merging its characters by rank."""
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
    scores = {model.id_to_piece(k): model.get_score(k) for k in range(model.get_piece_size())}
    pieces.sort(key=lambda p: -scores[p])
    number = {p: k for k, p in enumerate(pieces)}
    rank, parts = [-1] * len(pieces), [None] * len(pieces)
    for k, piece in enumerate(pieces):
        if len(piece) > 1:
            symbols = list(piece)
            while len(symbols) > 2:
                joint = [number.get(a + b, len(pieces)) for a, b in zip(symbols, symbols[1:])]
                best = min(joint)
                if best >= k:
                    break
                at = joint.index(best)
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            if len(symbols) == 2 and all(s in number for s in symbols):
                rank[k], parts[k] = k, (number[symbols[0]], number[symbols[1]])
            else:
                raise ValueError(f"piece {piece!r} is not made by merges")
    return Merges(pieces, rank, parts)


class PrefixCounter:
    def __init__(self, path: str):
        self.merges = merge_tables(sentencepiece.SentencePieceProcessor(model_file=path))
        singles = {t for t in self.merges.tokens if len(t) == 1}
        self._known = singles
        self._chunks = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.stored = Bounded(96 << 20, lambda c: array("I", self.prefixes(c)))

    def chunks(self, text: str) -> list[str]:
        return self._chunks.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def prefixes(self, chunk: str) -> list[int]:
        """Counts at every place of a chunk; a character that no piece has counts one for each byte."""
        out, known, done = [0], self._known, 0
        while done < len(chunk):
            stop = done
            while stop < len(chunk) and chunk[stop] in known:
                stop += 1
            if stop > done:
                base = out[-1]
                out += [base + c for c in self.merges.prefix_counts(chunk[done:stop])[1:]]
                done = stop
            else:
                out.append(out[-1] + len(chunk[done].encode()))
                done += 1
        return out

    def count(self, text: str) -> int:
        return sum(map(LAST, map(self.stored.__getitem__, self.chunks(text))))

    def table(self, text: str) -> PrefixTable:
        return PrefixTable(self, text)


class PrefixTable:
    """The stored counts of a text's prefixes; places count characters of the text."""

    def __init__(self, counter: PrefixCounter, text: str):
        chunks = counter.chunks(text)
        self.inner = list(map(counter.stored.__getitem__, chunks))  # equal chunks share one array
        self.ends = [0, *accumulate(map(len, chunks))]  # with the space mark before the text
        self.sums = [0, *accumulate(map(LAST, self.inner))]

    def at(self, place: int) -> int:
        """The number of tokens of text[:place]."""
        if place <= 0:
            return 0
        k = bisect_left(self.ends, place + 1)
        return self.sums[k - 1] + self.inner[k - 1][place + 1 - self.ends[k - 1]]

    def longest(self, budget: int) -> int:
        """The longest prefix, in characters, that has at most budget tokens."""
        if not self.inner or self.sums[-1] <= budget:
            return max(0, self.ends[-1] - 1)
        k = bisect_left(self.sums, budget + 1)  # the first chunk end beyond the budget
        most = max(i for i, c in enumerate(self.inner[k - 1]) if self.sums[k - 1] + c <= budget)
        return max(0, self.ends[k - 1] + most - 1)


@lru_cache(maxsize=2)
def loaded(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(df: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit, and fit_chars: the characters that limit tokens reach."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType(
        [
            T.StructField(id_col, rows.schema["id"].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
            T.StructField("fit_chars", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                counts = [counter.count(t) for t in texts]
                fit = [counter.table(t).longest(limit) if n > limit else len(t) for t, n in zip(texts, counts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(t.encode()) for t in texts], pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array([n > limit for n in counts], pa.bool_()),
                        pa.array(fit, pa.int64()),
                    ],
                    names=schema.names,
                )

    return rows.mapInArrow(run, schema)
