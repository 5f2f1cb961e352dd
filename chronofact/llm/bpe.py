"""BPE encoding and decoding with a word-level vocabulary file (tokenizers JSON).

Encoding is by backtracking (see _bpe_core): Aho-Corasick gives the longest
token at a place, a pair-compatibility table says whether it may follow the
token before, so a word's exact merges come in linear time. Each distinct word
is encoded once for a worker process, within a bounded cache. Decoding gathers
slices of one byte string by an offset table.

Cases: a null text counts as empty and gives no ids and an empty text. Null
ids, repeated rows and empty tables pass through, a result row for each input
row. Very long texts are processed whole. Input columns other than id and text
are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, pre_tokenizers

from ._bpe_core import Bounded, Merges
from ._common import released
from ._text import slices

CACHE = 32 << 20  # bytes of a generation of words, and of pairs, in each worker: two generations each, and two workers to an executor of two cores
END = "\U0010fffd"  # stands for the end-of-word mark inside token texts
WHITE = "\t-\r \x85\xa0  -     　"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"  # fixed values of the vocabulary's word pattern


def byte_alphabet() -> dict[int, str]:
    """A printable character for each byte: itself where it is one, else from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        shown = [""] * size
        for t, k in vocab.items():
            shown[k] = t
        texts = [t[: -len(suffix)] + END if t.endswith(suffix) else t for t in shown]
        rank, parts = [-1] * size, [None] * size
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            k = vocab[a + b]
            rank[k], parts[k] = r, (vocab[a], vocab[b])
        self.merges = Merges(texts, rank, parts, CACHE)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, k in self.special.items():
            shown[k] = t
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self._plain = re.compile(rf"{CONTRACTIONS}|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")
        self._library = Tokenizer.from_file(path).normalizer
        self._split = pre_tokenizers.Split(Regex(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]), "removed", invert=True)
        self._words = regex.compile(rf"{CONTRACTIONS}|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
        self._alphabet = byte_alphabet()
        self._encoded = Bounded(CACHE, self._encode_word)
        pieces = [t.encode() + b" " for t in shown]
        self._blob = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self._offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])

    def _encode_word(self, word: str) -> bytes:
        symbols = "".join(self._alphabet[b] for b in word.encode()) + END
        return np.array(self.merges.encode(symbols), dtype="<u4").tobytes()

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return self._plain.findall(text.lower())
        if not "".join(text.split()).isprintable() and any(unicodedata.category(c) == "Cn" for c in set(text)):
            # assigned in a later Unicode version than Python's, or never: the library has a version of its own
            return [w for w, _ in self._split.pre_tokenize_str(self._library.normalize_str(text))]
        # character by character in effect: only a capital sigma depends on what follows
        return self._words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if "<|" not in text:
            return b"".join(map(self._encoded.__getitem__, self.words(text)))
        return b"".join(
            self.special[part].to_bytes(4, "little") if part in self.special else b"".join(map(self._encoded.__getitem__, self.words(part)))
            for part in self._special.split(text)
        )

    def decode(self, ids: bytes) -> bytes:
        """The tokens' texts, with spaces between them, as UTF-8."""
        k = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        if not len(k):
            return b""
        begin, size = self._offsets[k], self._offsets[k + 1] - self._offsets[k]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)
        return self._blob[at].tobytes()[:-1]


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBPE:
    coder = WordBPE(path)
    released()
    return coder


def encoded(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256, and of ids (binary) and decoded (string) those in outputs."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kinds = {"ids": T.BinaryType(), "decoded": T.StringType()}
    schema = T.StructType(
        [
            T.StructField(id_col, rows.schema["id"].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
            *[T.StructField(o, kinds[o]) for o in outputs],
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        coder = loaded(vocab_path)
        for whole in batches:
            for batch, raw in slices((whole,)):
                ids = [coder.encode(t.decode()) for t in raw]
                texts = [coder.decode(x) for x in ids]
                columns = {
                    id_col: batch.column(0),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts]),
                }
                if "ids" in outputs:
                    columns["ids"] = pa.array(ids, pa.binary())
                if "decoded" in outputs:
                    columns["decoded"] = pa.array([x.decode() for x in texts], pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
            released()

    return rows.mapInArrow(run, schema)
