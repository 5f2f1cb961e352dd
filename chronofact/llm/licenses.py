"""License scans: a trained paragraph classifier, confirmed by template comparison.

Every line of every text is scored by sparse logistic regression over hashed
words and word pairs (lower case, weights averaged over the line). A first
model separates licence notices from other text; the second names the family
(a licence and its version), or "unknown". It must then be confirmed: at least
MIN_SHARE of the word pairs of one of the family's templates occur in the
notice, and what tells the family from its kin is told: the version, the
elements of a Creative Commons licence, the clauses of a BSD one, the kind of
a GNU one. What is a notice but has no confirmed family is "unknown".

A notice inside other text would vanish in the average over a long line. So a
line that is none as a whole, or has more than LONG words, is also scored by
all its windows of WINDOWS words; windows found that overlap are one span. In a
span the windows with a confirmed family that hold most pairs of a template are
notices, as far as they do not overlap; a span without any is "unknown" if one
of its windows has p > 0.9. So such a span may hold up to a window of text
beside it. A paragraph is a run of lines that are not blank: a notice that is
wrapped over two lines of it is found in the windows across their border, if
its family is confirmed. An unknown notice has at least half of its words once.

Training: the templates are made by rule from names and versions; the models
are fitted on variants of them, on notices of no family, on sentences that use
a notice's words otherwise, and on at most about max_negatives lines of the
corpus, chosen by a hash of id and place, with four windows of each. Lines that
hold half of a template are not taken. The probability that a family needs and
the temperature are calibrated with a model that has never seen every fourth
family: their variants must come out as unknown. So the models are bounded and
fitted on the driver; scans cover every line.

Cases: null, empty and wordless texts have no paragraphs, and a row with empty
lists. Null ids, repeated rows and very long texts pass through whole, a result
row for each input row. Equal probabilities go to the first family by name.
Input columns other than id and text are not read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import sample_bound, sampled
from ._text import mix, slices, word_hashes

BITS = 15
MIN_SHARE = 0.6
UNKNOWN = "unknown"
WINDOWS = (6, 9, 14, 20)  # words; the longest template has 18
DENSE = 8 << 20  # cells of a training table that is held whole
LONG = 40
LINE = 4000  # characters of a line that are fitted at most; scans are of whole lines
SPAN_LOGIT = 2.2  # p > 0.9: with so many windows, a few of prose are over 0.5
WORDS = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0d]+")  # as word_hashes finds them, with marks

# Names of public licences, their versions, and sentences of their texts that are used as notices.
VERSIONED = {
    "agpl": ("GNU Affero General Public License", "AGPL", ["3.0"]),
    "apache": ("Apache License", "Apache", ["1.1", "2.0"]),
    "artistic": ("Artistic License", "Artistic", ["1.0", "2.0"]),
    "epl": ("Eclipse Public License", "EPL", ["1.0", "2.0"]),
    "gpl": ("GNU General Public License", "GPL", ["2.0", "3.0"]),
    "lgpl": ("GNU Lesser General Public License", "LGPL", ["2.1", "3.0"]),
    "mpl": ("Mozilla Public License", "MPL", ["1.1", "2.0"]),
}
NAMED = {"agpl": "affero", "apache": "apache", "artistic": "artistic", "epl": "eclipse", "gpl": "gnu", "lgpl": "lesser", "mpl": "mozilla"}  # the telling word of each name
COMMONS = {"by": "Attribution", "nc": "NonCommercial", "sa": "ShareAlike", "nd": "NoDerivatives"}
COMMONS_KINDS, COMMONS_VERSIONS = ["by", "by-nc", "by-nc-nd", "by-nc-sa", "by-nd", "by-sa"], ["2.0", "3.0", "4.0"]
PLAIN = {
    "bsd-2-clause": ["Released under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause", "Licensed under the Simplified BSD License, two clauses"],
    "bsd-3-clause": ["Released under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause", "Licensed under the New BSD License, three clauses"],
    "cc0-1.0": ["released under CC0 1.0 Universal Public Domain Dedication", "dedicated to the public domain under CC0", "SPDX-License-Identifier: CC0-1.0"],
    "isc": ["Released under the ISC License", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"],
    "mit": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MIT", "Licensed under the MIT License"],
    "unlicense": ["This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense"],
}
SENTENCES = {"apache-2.0": ["you may not use this file except in compliance with the License"]}
OTHER_NOTICES = ["All rights reserved under the terms of our own license", "Use is subject to the license agreement", "Licensed for personal use only", "distributed under the Example Community License", "This material is licensed to subscribers", "released under a custom license", "Redistribution and use in source and binary forms, with or without modification, are permitted", "under the terms of the GNU General Public License as published by the Free Software Foundation", "Licensed under the terms found in the LICENSE file", "Copyright by the authors, all rights reserved", "Licensed under the Foo Private License", "Use of this data is governed by the license of its owner"]
# Sentences with a notice's words that are no notice; {} stands for a word of the corpus.
OTHER_USES = ["he lost his driver's license on the way {}", "she will license new taxi drivers in the {}", "the bar had its liquor license renewed {}", "poetic license allows a {}", "a hunting license is needed for {}", "the copyright of songs was the topic of the {}", "the public went to the general {} in the mountains", "they released the {} under the bridge", "he was granted permission to leave {} early", "the permission to build a {} was refused", "free of charge, they gave a copy of the {} to any person", "the terms of the {} were read under the old tree", "Apache helicopters flew over the {}", "students at MIT wrote software for a {}", "the eclipse was public and {}", "the Mozilla browser opened a {}", "the work of this {} is known", "version 2 of the {} came out in May", "the marriage license cost a {}", "the creative commons of the {} were a meeting place", "public domain names for a {} are cheap"]


def made_templates() -> dict[str, list[str]]:
    """Notices by family, from names and versions."""
    out = {name: list(lines) for name, lines in PLAIN.items()}
    for kind, (name, short, versions) in VERSIONED.items():
        for v in versions:
            spoken = v.removesuffix(".0") if kind.endswith("gpl") else v
            out[f"{kind}-{v}"] = [f"{name}, version {spoken}", f"This work is licensed under the {name}, version {spoken}", f"Released under the {name} {v}", f"subject to the terms of the {name}, v. {v}", f"SPDX-License-Identifier: {short}-{v}", f"Licensed under {short} {v}", f"Licensed under the {short}v{spoken}", *SENTENCES.get(f"{kind}-{v}", [])]
    for kind in COMMONS_KINDS:
        whole = "-".join(COMMONS[x] for x in kind.split("-"))
        for v in COMMONS_VERSIONS:
            out[f"cc-{kind}-{v}"] = [f"Creative Commons {whole} {v}", f"Licensed under CC {kind.upper()} {v}", f"licensed under a Creative Commons {whole} {v} International License", f"SPDX-License-Identifier: CC-{kind.upper()}-{v}"]
    return dict(sorted(out.items()))


TEMPLATES = made_templates()


def told(family: str, text: str) -> bool:
    """Whether a notice tells the family from its kin."""
    words = set(re.findall(r"[a-z]+|\d+(?:\.\d+)*", text.lower()))
    if family.startswith("cc-"):
        kind, version = family[3:].rsplit("-", 1)
        named = {x for x, whole in COMMONS.items() if words & {x, whole.lower(), whole.lower().removesuffix("atives") + "s"} or x != "by" and whole.lower() in text.lower().replace("-", "").replace(" ", "")}
        return named == set(kind.split("-")) and _has_version(words, version)
    if family.startswith("bsd-"):
        two = bool(words & {"2", "two", "simplified", "freebsd"})
        three = bool(words & {"3", "three", "new", "revised", "modified"})
        return "bsd" in words and (two, three) == (family == "bsd-2-clause", family == "bsd-3-clause")
    kind = next((k for k in VERSIONED if family.startswith(f"{k}-")), None)
    if kind is None:
        return True
    if not words & {NAMED[kind], kind, f"{kind}v"}:
        return False
    if kind.endswith("gpl"):
        named = "agpl" if words & {"affero", "agpl", "agplv"} else "lgpl" if words & {"lesser", "library", "lgpl", "lgplv"} else "gpl"
        if named != kind:
            return False
    sentences = SENTENCES.get(family, [])
    return _has_version(words, family.rsplit("-", 1)[1]) or any(x.lower() in text.lower() for x in sentences)


def _has_version(words: set[str], version: str) -> bool:
    return bool({version, version.removesuffix(".0")} & words)


def paragraph_features(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, line of each one, number for each line)"""
    words, first = word_hashes(lines, lower=True, marks=True)
    own = np.repeat(np.arange(len(lines)), np.diff(first))
    same = own[:-1] == own[1:] if len(words) > 1 else np.zeros(0, dtype=bool)
    pairs = mix(words[:-1] * np.uint64(0x9FB21C651E98DF25) + words[1:])[same] if len(words) > 1 else words[:0]
    at = (np.concatenate([words, pairs]) >> np.uint64(64 - BITS)).astype(np.int64)
    own = np.concatenate([own, own[:-1][same]]) if len(words) > 1 else own
    return at, own, np.bincount(own, minlength=len(lines))


def varied(line: bytes) -> bool:
    """Whether at least half of the words are different ones; a word said over and over is no notice of its own."""
    words = line.lower().split()
    return 2 * len(set(words)) >= len(words)


def word_pairs(line: bytes) -> set:
    words = word_hashes([line], lower=True, marks=True)[0].tolist()
    return set(zip(words, words[1:])) or set(words)


@dataclass
class Softmax:
    weights: np.ndarray  # classes x buckets
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, lines: list[bytes]) -> np.ndarray:
        at, own, n = paragraph_features(lines)
        sums = np.stack([np.bincount(own, weights=w[at], minlength=len(lines)) for w in self.weights], axis=1)
        return (sums / np.maximum(n, 1)[:, None] + self.bias) / self.temperature

    def probabilities(self, lines: list[bytes]) -> np.ndarray:
        z = self.logits(lines)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fitted_softmax(lines: list[bytes], classes: np.ndarray, n_classes: int, steps: int = 200, rate: float = 40.0, decay: float = 1e-5) -> Softmax:
    """Full-batch gradient descent with momentum."""
    at, own, n = paragraph_features(lines)
    used, compact = np.unique(at, return_inverse=True)
    value = (1.0 / np.maximum(n, 1)[own]).astype(np.float32)
    if len(lines) * len(used) <= DENSE:
        x = np.zeros((len(lines), len(used)), dtype=np.float32)
        np.add.at(x, (own, compact), value)
        forward, backward = (lambda w: x @ w), (lambda miss: x.T @ miss)
    else:  # by their features, column by column
        summed = lambda to, by, m, size: np.stack([np.bincount(to, weights=m[by, c] * value, minlength=size) for c in range(m.shape[1])], axis=1).astype(np.float32)
        forward, backward = (lambda w: summed(own, compact, w, len(lines))), (lambda miss: summed(compact, own, miss, len(used)))
    w, b = np.zeros((len(used), n_classes), dtype=np.float32), np.zeros(n_classes, dtype=np.float32)
    speed = np.zeros_like(w)
    truth = np.eye(n_classes, dtype=np.float32)[classes]
    scale = np.float32(rate * max(1.0, n_classes / 12))  # a class has its share of the lines only
    for _ in range(steps):
        z = forward(w) + b
        e = np.exp(z - z.max(axis=1, keepdims=True))
        miss = (e / e.sum(axis=1, keepdims=True) - truth) / np.float32(len(lines))
        speed = np.float32(0.9) * speed - scale * (backward(miss) + np.float32(decay) * w)
        w = w + speed
        b = b - scale / 40 * miss.sum(axis=0)
    whole = np.zeros((n_classes, 1 << BITS))
    whole[:, used] = w.T
    return Softmax(whole, b.astype(float))


def variants(text: str, rng: random.Random, count: int) -> list[bytes]:
    """text as it is, and with other openings, endings and a word left out."""
    out = [text, text + ".", text.lower()]
    while len(out) < count:
        words = text.split()
        if len(words) > 6 and rng.random() < 0.5:
            words.pop(rng.randrange(len(words)))
        opening = rng.choice(["", "", "This work is ", "The content is ", "This document is ", "Copyright 2020. "])
        out.append(opening + " ".join(words) + rng.choice(["", ".", " (see LICENSE).", ";"]))
    return [t.encode() for t in out]


@dataclass
class Scanner:
    notice: Softmax
    family: Softmax
    names: list[str]
    templates: list[list[set]]
    least: float = 0.5  # the probability that a family needs

    def windows(self, lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(line, first word, end, logit) of each window of words that is a notice."""
        words, first = word_hashes(lines, lower=True, marks=True)
        own = np.repeat(np.arange(len(lines)), np.diff(first))
        weight = (self.notice.weights[1] - self.notice.weights[0]) / self.notice.temperature
        bias = (self.notice.bias[1] - self.notice.bias[0]) / self.notice.temperature
        sums = lambda h: np.append(0.0, np.cumsum(weight[(h >> np.uint64(64 - BITS)).astype(np.int64)]))
        of_words, of_pairs = sums(words), sums(mix(words[:-1] * np.uint64(0x9FB21C651E98DF25) + words[1:]))
        found = []
        for size in WINDOWS:
            n = len(words) - size + 1
            if n > 0:
                z = (of_words[size:] - of_words[:n] + of_pairs[size - 1 :] - of_pairs[:n]) / (2 * size - 1) + bias
                at = np.flatnonzero((z > 0) & (own[:n] == own[size - 1 :]))
                found.append((own[at], at - first[own[at]], at - first[own[at]] + size, z[at]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4

    def judged(self, texts: list[bytes]) -> list[tuple[str, float, int]]:
        """(family or UNKNOWN, probability, the most word pairs that it has of one of its templates) of each notice."""
        out = []
        for text, p in zip(texts, self.family.probabilities(texts)):
            best = int(np.argmax(p))
            own = word_pairs(text)
            share = self.share(best, own) if best < len(self.names) else 0.0
            sure = p[best] >= self.least and share >= MIN_SHARE and told(self.names[best], text.decode(errors="replace"))
            held = max(len(t & own) for t in self.templates[best]) if sure else 0
            out.append((self.names[best] if sure else UNKNOWN, float(p[best]), held))
        return out

    def share(self, family: int, pairs: set) -> float:
        """The largest share of one of the family's templates that pairs hold."""
        return max(len(t & pairs) / len(t) for t in self.templates[family])

    def across(self, lines: list[bytes], borders: list[int]) -> list[tuple[int, int, int, str, float]]:
        """(line, begin, end in the next line, family, probability) of confirmed notices over the end of a line."""
        tails = [[m.span() for m in WORDS.finditer(lines[k])][-WINDOWS[-1] :] for k in borders]
        heads = [[m.span() for m in WORDS.finditer(lines[k + 1])][: WINDOWS[-1]] for k in borders]
        joined = [lines[k][t[0][0] :] + b" " + lines[k + 1][: h[-1][1]] for k, t, h in zip(borders, tails, heads)]
        line, begins, ends, logits = self.windows(joined)
        over = np.array([begins[i] < len(tails[k]) < ends[i] for i, k in enumerate(line)], dtype=bool)
        order = np.flatnonzero(over)[np.argsort(line[over], kind="stable")] if over.any() else np.zeros(0, np.int64)
        out = []
        for k in np.unique(line[order]):
            mine = order[line[order] == k]
            cut = tails[k][0][0]
            size = len(lines[borders[k]]) - cut
            for b, e, family, p in self.inside(joined[k], begins[mine], ends[mine], logits[mine]):
                if family != UNKNOWN:
                    out.append((borders[k], cut + b, e - size - 1, family, p))
        return out

    def inside(self, line: bytes, begins: np.ndarray, ends: np.ndarray, logits: np.ndarray) -> list[tuple[int, int, str, float]]:
        """(begin, end, family or UNKNOWN, probability) of each notice in a line's windows, in bytes."""
        at = [m.span() for m in WORDS.finditer(line)]
        order = np.lexsort((ends, begins))
        begins, ends, logits = begins[order], ends[order], logits[order]
        cuts = np.flatnonzero(begins[1:] >= np.maximum.accumulate(ends)[:-1]) + 1
        out = []
        for b, e, z in zip(np.split(begins, cuts), np.split(ends, cuts), np.split(logits, cuts)):
            judged = self.judged([line[at[x][0] : at[y - 1][1]] for x, y in zip(b, e)])
            sure = sorted((k for k in range(len(b)) if judged[k][0] != UNKNOWN), key=lambda k: (-judged[k][2], -judged[k][1], b[k]))
            taken = np.zeros(int(e.max() - b[0]), dtype=bool)
            for k in sure:
                own = taken[b[k] - b[0] : e[k] - b[0]]
                if not own.any():
                    own[:] = True
                    out.append((at[b[k]][0], at[e[k] - 1][1], *judged[k][:2]))
            top = int(np.argmax(z))
            if not sure and z[top] > SPAN_LOGIT and varied(line[at[b[top]][0] : at[e[top] - 1][1]]):
                out.append((at[b[0]][0], at[e.max() - 1][1], UNKNOWN, judged[top][1]))
        return sorted(out)

    def scan(self, lines: list[bytes], follows: list[bool]) -> list[tuple[int, int, int, int, str, float]]:
        """(line, begin, last line, end, family or UNKNOWN, probability) of each notice; begin and end in bytes of the lines.

        follows: whether a line continues the one before it.
        """
        if not lines:
            return []
        whole = self.notice.probabilities(lines)[:, 1] > 0.5
        n_words = np.diff(word_hashes(lines, marks=True)[1])
        rest = np.flatnonzero((~whole & (n_words > WINDOWS[0])) | (n_words > LONG))
        line, begins, ends, logits = self.windows([lines[k] for k in rest])
        order = np.argsort(line, kind="stable")
        line, begins, ends, logits = line[order], begins[order], ends[order], logits[order]
        held, first = np.unique(line, return_index=True)
        found = {int(rest[k]): self.inside(lines[rest[k]], *x) for k, *x in zip(held, *(np.split(x, first[1:]) for x in (begins, ends, logits)))}
        found = {k: x for k, x in found.items() if x}
        plain = [int(k) for k in np.flatnonzero(whole) if k not in found]
        for k, (family, p, _) in zip(plain, self.judged([lines[k] for k in plain]) if plain else []):
            if family != UNKNOWN or varied(lines[k]):
                found[k] = [(0, len(lines[k]), family, p)]
        known = {k for k, xs in found.items() if any(x[2] != UNKNOWN for x in xs)}
        borders = [k for k in range(len(lines) - 1) if follows[k + 1] and n_words[k] and n_words[k + 1] and not {k, k + 1} & known]
        wrapped = self.across(lines, borders) if borders else []
        for k, *_ in wrapped:  # what was an unknown notice on one of the lines is this one
            found.pop(k, None), found.pop(k + 1, None)
        out = [(k, x[0], k, *x[1:]) for k, xs in found.items() for x in xs] + [(k, b, k + 1, *x) for k, b, *x in wrapped]
        return sorted(out)


def notices_of(names: list[str], rng: random.Random, count: int = 7) -> tuple[list[bytes], list[int]]:
    """Variants of the families' templates and of notices of no family; the last class is the latter."""
    lines, classes = [], []
    for c, templates in enumerate([*(TEMPLATES[n] for n in names), OTHER_NOTICES]):
        for t in templates:
            v = variants(t, rng, count)
            lines += v
            classes += [c] * len(v)
    return lines, classes


def calibrated(seed: int) -> tuple[float, float]:
    """(temperature, least probability), from a model that has not seen every fourth family."""
    rng = random.Random(seed)
    names = list(TEMPLATES)
    strange, familiar = names[::4], [n for n in names if n not in names[::4]]
    lines, classes = notices_of(familiar, rng)
    model = fitted_softmax(lines, np.array(classes), len(familiar) + 1)
    mine, classes = notices_of(familiar, rng, 5)  # other variants
    others = [v for n in strange for t in TEMPLATES[n] for v in variants(t, rng, 3)]
    y = np.array(classes)

    def loss(temperature: float) -> float:
        model.temperature = temperature
        return -float(np.mean(np.log(model.probabilities(mine)[np.arange(len(y)), y] + 1e-12)))

    model.temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
    right = model.probabilities(mine)[y < len(familiar)][np.arange((y < len(familiar)).sum()), y[y < len(familiar)]]
    wrong = model.probabilities(others)[:, :-1].max(axis=1)
    steps = [k / 20 for k in range(2, 16)]
    best = max(steps, key=lambda x: (float(np.mean(right >= x)) + 0.5 * float(np.mean(wrong < x)), -x))
    return model.temperature, best


def trained(negatives: list[bytes], seed: int = 3) -> Scanner:
    rng = random.Random(seed)
    names = list(TEMPLATES)
    temperature, least = calibrated(seed)
    lines, classes = notices_of(names, rng)
    family = fitted_softmax(lines, np.array(classes), len(names) + 1)
    family.temperature = temperature
    templates = [[word_pairs(t.encode()) for t in TEMPLATES[n]] for n in names]
    known = [t for ts in templates for t in ts]
    plain = [x for x in negatives if not any(2 * len(t & pairs) >= len(t) for pairs in [word_pairs(x)] for t in known)]
    words = [w.decode(errors="replace") for x in plain[:200] for w in x.split()[:3]] or ["word"]
    uses = [form.format(rng.choice(words)).encode() for form in OTHER_USES for _ in range(6)]
    parts = []
    for text in plain + uses:
        tokens = text.split()
        for size in WINDOWS:
            at = rng.randrange(max(1, len(tokens) - size + 1))
            parts.append(b" ".join(tokens[at : at + size]))
    others = plain + uses + parts
    notice = fitted_softmax(lines + others, np.array([1] * len(lines) + [0] * len(others)), 2)
    return Scanner(notice, family, names, templates, least)


def fitted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_negatives: int = 2000) -> Scanner:
    """A scanner whose other-text class is the corpus; about max_negatives of its lines are fitted."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("text is not null")
    lines = rows.select("id", F.posexplode(F.split("text", "\n")).alias("at", "line")).filter(F.length(F.trim("line")) > 0)
    n = rows.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0  # lines, blank ones too
    chosen = lines.filter(sampled(sample_bound(max_negatives, n), "negative", "id", "at")).select(F.substring("line", 1, LINE).alias("line"))
    return trained([r[0].encode() for r in chosen.collect()] or [b"word"])


def scanned(df: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, and for each notice of the text: its first line, begin and end (characters), family, probability."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(scanner)  # of fixed size
    item = pa.struct([("line", pa.int32()), ("begin", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("probability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            parts = [t.split(b"\n") for t in texts]
            first = np.cumsum([0, *map(len, parts)])
            follows = [k > 0 and bool(ls[k].strip()) and bool(ls[k - 1].strip()) for ls in parts for k in range(len(ls))]
            notices: list[list[dict]] = [[] for _ in texts]
            for k, b, last, e, family, p in shared.value.scan([x for ls in parts for x in ls], follows):
                doc = int(np.searchsorted(first, k, side="right")) - 1
                line, last = k - int(first[doc]), last - int(first[doc])
                starts = lambda x: sum(len(y.decode()) + 1 for y in parts[doc][:x])  # noqa: B023, E731
                begin = starts(line) + len(parts[doc][line][:b].decode())
                notices[doc].append({"line": line, "begin": begin, "end": starts(last) + len(parts[doc][last][:e].decode()), "family": family, "probability": p})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(notices, pa.list_(item))], names=[id_col, "notices"])

    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("notices", T.ArrayType(T._parse_datatype_string("struct<line:int,begin:bigint,end:bigint,family:string,probability:double>")))])
    return rows.mapInArrow(run, schema)
