"""N-gram Jaccard self-join by vertical partitioning.

The global order of word n-grams is that of their 64-bit hashes. It is cut into
fragments; a document's n-gram set falls into one segment for each fragment.

1. Equal sets are collapsed to one class.
2. Candidates. Two sets with similarity t or more differ in at most
   D = n (1 - t) / t n-grams, n being the smaller size, so they agree in all
   but D of their segments. Sets of like size are cut into the same number of
   fragments, D + L of them filled or more. The first D + L segments of two
   linked sets then have at least as many in common as the smaller L says. These
   segments (for small sets, single n-grams) are counted over all classes, in
   waves of the key space, and ordered rarest first; of those with c in common,
   the first D + L - c + 1 suffice by the prefix principle. Segments that occur
   once fill the prefixes of unlike documents, which are then out, and L leaves
   room to pass over hot ones. So hot passages and lines make no candidates.
   Of long texts the first MOST segments are enough: fragments are dealt by
   hash, each of them differs with probability 0.54 at most, so that fewer than
   SURE of MOST agree is as rare as a clash of 64-bit hashes (1 in 10**20).
3. Overlaps. A candidate pair's overlap is counted apart in each coarse
   fragment of the order, and the counts are summed for each pair.
4. Links. In rounds, the members of a segment are compared with one leader only,
   another one each time, and components are formed; segments whose members are
   all in one component go. When comparing all pairs that are still apart costs
   no more than reading the segments a few times, or leaders leave most of these
   pairs apart, the last round does that: members outside a segment's largest component are
   compared with the rest. Pairs whose n-gram bits have too many odd differences
   are never compared. So a large group of near copies costs about its size,
   yet no component loses a link. Segments with the same members count once.

Few sets fill fewer fragments than D + L (under one in 10**9), and then 2. does
not hold. Sets of these sizes, and of those that partners may have, get single
n-grams as further segments of their own kind, so their links are found too.

Cases: a null or wordless text has an empty set and no links; a text with fewer
words than n has its whole word sequence as one n-gram. Rows with a null id are
given no component (null) and link nothing. Rows that share an id are one
document's versions: each has its own row, and a link of one is not passed on
by the others. Empty tables give empty results. Input columns other than id and
text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import Scratch, swept
from ._text import mix, slices, word_hashes
from .components import connected

SMALL = 6  # sets of under 2**SMALL n-grams use single n-grams as segments
SPREAD = 1.6  # fragments for each n-gram that two sets of a class may differ in
MOST, SURE = 200, 32
COARSE = 8192  # n-grams in a coarse fragment, about
PARITY = 8
BITS = [f"p{k}" for k in range(PARITY)]
CHEAP = 4  # pairs for each row of the index that are compared without further leaders
LEFT = 0.8  # share of the pairs that a round of leaders may leave, if another one is to follow
FEATURES = "doc_id {id}, rid long, text_key long, n long, sid binary, own array<long>, low array<long>, deficient int, " + ", ".join(f"p{k} long" for k in range(PARITY))


def slack(far: int) -> int:
    """L, for sets that may differ in far n-grams; it does not fall as far grows."""
    return far * 3 // 20 + 1


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams, ASCII letters in lower case."""
    words, first = word_hashes(texts, lower=True)
    grams = words
    if n > 1 and len(words) >= n:
        grams = words[: len(words) - n + 1]
        for k in range(1, n):
            grams = mix(grams * np.uint64(0x9FB21C651E98DF25) + words[k : len(words) - n + 1 + k])
    for k in range(len(texts)):
        b, e = first[k], first[k + 1]
        if e - b >= n:
            yield np.unique(grams[b : e - n + 1])
        elif e > b:
            whole = np.array([e - b], dtype=np.uint64)
            for w in words[b:e]:
                whole = mix(whole * np.uint64(0x9FB21C651E98DF25) + w)
            yield whole
        else:
            yield np.zeros(0, dtype=np.uint64)


def set_id(s: np.ndarray) -> bytes:
    return np.array([np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5))), np.add.reduce(mix(s + np.uint64(0x5DEECE66D)))], dtype=np.uint64).tobytes()


def parity(s: np.ndarray) -> np.ndarray:
    bits = np.bincount((mix(s ^ np.uint64(0x77)) >> np.uint64(64 - 9)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def segment_keys(s: np.ndarray, fragments: int) -> np.ndarray:
    """A key for each filled fragment; fragments 0: for each n-gram."""
    if not fragments:
        return mix(s ^ np.uint64(0xC0FFEE))
    at = ((s >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
    begin = np.flatnonzero(np.diff(at, prepend=np.uint64(1 << 40)))
    return mix(np.add.reduceat(mix(s ^ np.uint64(0xFACADE)), begin) + at[begin] * np.uint64(0x9E3779B97F4A7C15) + mix(np.array([fragments], dtype=np.uint64)))


def features(df: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int, spread: float = SPREAD, single: frozenset[int] = frozenset()) -> DataFrame:
    """A row for each row of df: its set's size, id and parity bits, and its first segments.

    own has those of its size class, low those of the class below if partners
    may be in it. deficient is the size class if there are too few, else -1.
    With single, own has the first single n-grams of sets of these classes only.
    """
    text = F.col(f"`{text_col}`")
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("rid"), F.xxhash64(text).alias("text_key"))
    far = (den - num) / num

    def fragments(size_class: int) -> int:
        return 0 if size_class < SMALL or far > 0.3 else int(np.ceil(2 ** (size_class + 1) * far * spread))

    def first_segments(s: np.ndarray, k: int, largest: int) -> tuple[np.ndarray, bool]:
        """As many as a partner of at most largest n-grams needs, and whether they are too few."""
        d = min(len(s), largest) * (den - num) // num
        enough = min(d + slack(d), MOST) if k else d + slack(d)
        keys = segment_keys(s, k).view(np.int64)[:enough]
        return keys, len(keys) < min(len(s), enough)

    def segments(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        nothing, size_class = np.zeros(0, np.int64), len(s).bit_length() - 1
        if single:
            return (first_segments(mix(s ^ np.uint64(0x51461E)), 0, len(s))[0] if size_class in single else nothing), nothing, -1
        k, (own, short), low = fragments(size_class), first_segments(s, fragments(size_class), len(s)), nothing
        # smaller partners may be in the class below
        if size_class and num * len(s) <= den * (2**size_class - 1) and (k2 := fragments(size_class - 1)) != k:
            low, few = first_segments(s, k2, 2**size_class - 1)
            short = short or few
        return own, low, size_class if short else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            sizes, sids, own, low, deficient, bits = [], [], [], [], [], []
            for s in shingle_sets(texts, n):
                sizes.append(len(s))
                sids.append(set_id(s))
                for made, part in zip((own, low, deficient), segments(s) if len(s) else (s.view(np.int64), s.view(np.int64), -1)):
                    made.append(part)
                bits.append(parity(s))
            table = np.stack(bits) if bits else np.zeros((0, PARITY), np.int64)
            as_list = lambda parts: pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum([len(x) for x in parts])]), pa.int32()),
                pa.array(np.concatenate([np.zeros(0, np.int64), *[np.asarray(x, np.int64) for x in parts]])),
            )
            columns = [batch.column(0), batch.column(2), batch.column(3), pa.array(sizes, pa.int64()), pa.array(sids, pa.binary()), as_list(own), as_list(low), pa.array(deficient, pa.int32()), *[pa.array(table[:, k]) for k in range(PARITY)]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "rid", "text_key", "n", "sid", "own", "low", "deficient", *BITS])

    return rows.mapInArrow(run, FEATURES.format(id=rows.schema["doc_id"].dataType.simpleString()))


def coarse_level(n):
    """Sets of up to COARSE n-grams are compared whole, larger ones in 2**level fragments."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)) / COARSE))).cast("int")


def coarse_sets(texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(cid, level, frag, grams) from rows (cid, sid, text); only texts with that set. Repeated rows give repeated sets."""

    def level_of(size: int) -> int:
        return max(0, int(np.ceil(np.log2(max(size, 1) / COARSE))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, parts in slices(batches, 2):
            cids, sids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[tuple[int, int, int, bytes]] = []
            for cid, sid, s in zip(cids, sids, shingle_sets(parts, n)):
                if set_id(s) != sid:
                    continue
                for level in {level_of(len(s)), level_of(len(s) * den // num + 1)}:
                    at = ((s >> np.uint64(32)) << np.uint64(level)) >> np.uint64(32)
                    ends = np.searchsorted(at, np.arange(1, (1 << level) + 1).astype(np.uint64))
                    begin = 0
                    for frag, end in enumerate(ends):
                        if end > begin:
                            out.append((cid, level, frag, s[begin:end].tobytes()))
                        begin = end
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["cid", "level", "frag", "grams"])

    return texts.select("cid", "sid", "text").mapInArrow(run, "cid long, level int, frag int, grams binary")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common) for pairs (a, b, level): partial overlaps by fragment, summed for each pair."""
    # b is often one leader for very many a: its sets are repeated for salted parts of its pairs
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / 256).cast("int").alias("parts"))
    salted = pairs.join(parts, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    of_b = (
        sets.join(parts.withColumnRenamed("b", "cid"), "cid")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(F.col("cid").alias("b"), "level", "frag", "salt", F.col("grams").alias("grams_b"))
    )
    of_a = sets.select(F.col("cid").alias("a"), "level", "frag", F.col("grams").alias("grams_a"))
    joined = salted.join(of_a, ["a", "level"]).join(of_b, ["b", "level", "frag", "salt"]).select("a", "b", "frag", "grams_a", "grams_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for x, y in zip(batch.column(3), batch.column(4)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                counts.append(int(np.count_nonzero(y[at] == x)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(counts, pa.int64())], names=["a", "b", "frag", "part"])

    parts = joined.mapInArrow(run, "a long, b long, frag int, part long").groupBy("a", "b", "frag").agg(F.max("part").alias("part"))
    return parts.groupBy("a", "b").agg(F.sum("part").alias("common"))


def prefix_index(sides: list[DataFrame], about: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """(cid, key, n, parity bits): the rarest segments of each class, as many as the prefix principle asks for.

    sides: for each kind of segments, (cid, ks). Of segments with the same members one is left.
    """
    rows = reduce(DataFrame.unionByName, [s.select((F.col("cid") * 4 + k).alias("ref"), F.explode("ks").alias("key")) for k, s in enumerate(sides)])
    waves = 1 if num * 8 > den * 7 else 2  # more segments for lower similarities: their exchanges are held one after the other
    parts = []
    for wave in range(waves):
        mine = rows.filter(F.pmod("key", F.lit(waves)) == wave)
        counts = mine.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
        parts.append(scratch.cut(mine.join(counts, "key").select("ref", "key", "c")))
        del mine, counts
        swept(scratch.spark)
    shared = reduce(DataFrame.unionByName, parts)
    by_ref = W.partitionBy("ref")
    ranked = shared.select(F.floor(F.col("ref") / 4).alias("cid"), "key", F.row_number().over(by_ref.orderBy("c", "key")).alias("place"), F.count("*").over(by_ref).alias("common"))
    # a partner has num / den as many n-grams or more, so c is its slack at least
    partner = F.floor(F.floor((F.col("n") * num + den - 1) / F.lit(den)) * (den - num) / F.lit(num))
    agreed = F.least(F.floor(partner * 3 / 20) + 1, F.lit(SURE))
    # the prefix has all segments but agreed - 1; those that occur once come first in it
    index = scratch.cut(ranked.join(about, "cid").filter(F.col("place") <= F.col("common") - agreed + 1).select("cid", "key", "n", *BITS))
    scratch.drop(*parts)
    members = index.groupBy("key").agg(F.count("*").alias("c"), *[F.bit_xor(F.xxhash64("cid", F.lit(k))).alias(f"x{k}") for k in range(2)]).filter("c > 1")
    once = scratch.cut(index.join(members.groupBy("c", "x0", "x1").agg(F.min("key").alias("key")).select("key"), "key", "left_semi"))
    scratch.drop(index)
    return once


def candidates(left: DataFrame, right: DataFrame, num: int, den: int, extra) -> DataFrame:
    """(a, b, level, both, ra, rb): pairs that share a key, are in different components and may be near by size and parity."""
    x, y = left.alias("x"), right.alias("y")
    c = lambda s, k: F.col(f"{s}.{k}")
    apart = sum((F.bit_count(c("x", b).bitwiseXOR(c("y", b))) for b in BITS), F.lit(0))
    both = c("x", "n") + c("y", "n")
    near = (apart * (den + num) <= both * (den - num)) & (c("x", "n") * den >= c("y", "n") * num) & (c("y", "n") * den >= c("x", "n") * num)
    return (
        x.join(y, (c("x", "key") == c("y", "key")) & (c("x", "root") != c("y", "root")) & extra(c) & near)
        .select(c("x", "cid").alias("a"), c("y", "cid").alias("b"), coarse_level(F.greatest(c("x", "n"), c("y", "n"))).alias("level"), both.alias("both"), c("x", "root").alias("ra"), c("y", "root").alias("rb"))
        .distinct()
    )


def linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v): the components of pairs that are near."""
    common = overlaps(pairs, sets)
    near = common.join(pairs, ["a", "b"]).filter(den * F.col("common") >= num * (F.col("both") - F.col("common")))
    return near.select(F.least("ra", "rb").alias("u"), F.greatest("ra", "rb").alias("v")).distinct()


def merged(roots: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """roots (node, root), with the components that links (u, v) join made one."""
    found = connected(links, scratch)
    if roots is None:
        return scratch.cut(found)
    found = scratch.cut(found)
    moved = roots.join(found.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    out = scratch.cut(moved.unionByName(found.join(roots.select("node"), "node", "left_anti")))
    scratch.drop(found, roots)
    return out


def components_of(index: DataFrame, sets: DataFrame, num: int, den: int, scratch: Scratch, cheap: int = CHEAP) -> DataFrame | None:
    """(node, root) of the classes that have links; None without any."""
    roots, step, before, led = None, 0, float("inf"), True
    while True:
        placed = index.withColumn("root", F.col("cid")) if roots is None else index.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        placed = scratch.cut(placed.select("cid", "key", "n", *BITS, "root"))
        head = F.struct(F.xxhash64("cid", F.lit(step)).alias("h"), "cid", "n", "root", *BITS)
        by_root = placed.groupBy("key", "root").agg(F.count("*").alias("m"), F.min(head).alias("s"))
        size, same = F.sum("m"), F.sum(F.col("m").cast("double") * F.col("m"))
        groups = by_root.groupBy("key").agg(F.count("*").alias("n_roots"), F.max(F.struct("m", "root"))["root"].alias("major"), ((size * size - same) / 2).alias("pairs"), size.alias("members"), F.min("s").alias("s"))
        groups = scratch.cut(groups.filter("n_roots > 1").drop("n_roots"))
        pairs_left, rows_left = groups.agg(F.sum("pairs"), F.sum("members")).first()
        if not rows_left:
            scratch.drop(placed, groups, *([index] if step else []))
            return roots
        last = not led or pairs_left <= cheap * rows_left or pairs_left > LEFT * before
        before = pairs_left
        apart = scratch.cut(placed.join(groups.select("key", "major"), "key"))  # segments within one component say nothing more
        scratch.drop(placed)
        if last:
            major = lambda c: (c("y", "root") == c("y", "major")) | (c("x", "cid") < c("y", "cid"))
            pairs = candidates(apart.filter("root != major"), apart, num, den, major)
        else:
            pairs = candidates(apart, groups.select("key", "s.cid", "s.n", "s.root", *[f"s.{b}" for b in BITS]), num, den, lambda c: F.lit(True))
        pairs = scratch.cut(pairs)
        led = False
        if not pairs.isEmpty():
            links = scratch.cut(linked(pairs, sets, num, den))
            if not links.isEmpty():
                led, roots = True, merged(roots, links, scratch)
            scratch.drop(links)
        scratch.drop(pairs, groups)
        if step:
            scratch.drop(index)
        index, step = apart.drop("root", "major"), step + 1
        scratch.move(apart, index)
        swept(scratch.spark)
        if last:
            scratch.drop(index)
            return roots


def near_duplicates(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", spread: float = SPREAD) -> DataFrame:
    """A row for each row of df, linked at num / den or more.

    id_col, n_shingles, component_id, class_size, and text_key (the text's
    xxhash64) and first: whether the row stands for its component. That is the
    one with the smallest id; of rows that share it, with the smallest text_key.
    """
    scratch = Scratch(df.sparkSession, "jaccard")
    found = scratch.cut(features(df, id_col, text_col, n, num, den, spread))
    short = found.agg(F.collect_set(F.when(F.col("deficient") >= 0, F.col("deficient")))).first()[0]  # size classes: 64 at most
    live = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    firsts = [F.first(c).alias(c) for c in ("n", *BITS)]
    best = F.min(F.struct("doc_id", "text_key", "rid")).alias("best")
    about = scratch.cut(found.filter(live).groupBy("sid").agg(F.min("rid").alias("cid"), best, F.count("*").alias("class_size"), *firsts))
    rows = scratch.cut(found.select("doc_id", "rid", "text_key", "n", "sid", F.shiftright("rid", 33).alias("run")))
    keyed = scratch.cut(found.filter(live).groupBy("sid").agg(F.min("rid").alias("cid"), F.first("own").alias("own"), F.first("low").alias("low")).select("cid", "own", "low"))
    scratch.drop(found)
    sides = [keyed.select("cid", F.col(c).alias("ks")) for c in ("own", "low")]
    if short:
        near_classes = frozenset(c + k for c in short for k in (-1, 0, 1))
        more = features(df, id_col, text_col, n, num, den, single=near_classes).filter(live & (F.size("own") > 0)).groupBy("sid").agg(F.first("own").alias("ks"))
        sides.append(scratch.cut(more.join(about.select("sid", "cid"), "sid").select("cid", "ks")))
    swept(df.sparkSession)
    index = prefix_index(sides, about.select("cid", "n", *BITS), num, den, scratch)
    scratch.drop(keyed, *sides[2:])
    swept(df.sparkSession)
    held = about.join(index.select("cid").distinct(), "cid", "left_semi").select("cid", "sid", F.col("best.doc_id").alias("doc_id"))
    texts = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).join(held, "doc_id")
    sets = scratch.cut(coarse_sets(texts, n, num, den))
    swept(df.sparkSession)
    roots = components_of(index, sets, num, den, scratch)
    scratch.drop(sets, index)
    named = about.select("sid", "cid", "best", "class_size")
    if roots is not None:
        rooted = named.join(roots.withColumnRenamed("node", "cid"), "cid").select("cid", "root", "best")
        least = rooted.groupBy("root").agg(F.min("best").alias("whole"))
        named = named.join(rooted.join(least, "root").select("cid", "whole"), "cid", "left").withColumn("best", F.coalesce("whole", "best"))
    # run by run, so that the rows of a set that a third of all rows have are not one task's
    decided = rows.filter(live).select("run", "sid").distinct().join(named.select("sid", "class_size", "best"), "sid").withColumn("known", F.lit(True))
    lone = F.col("known").isNull()
    return rows.join(decided, ["run", "sid"], "left").select(
        F.col("doc_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(live, F.col("best.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(live, F.col("class_size")).otherwise(F.lit(1)).alias("class_size"),
        "text_key",
        (~live | lone | (F.col("best.rid") == F.col("rid"))).alias("first"),
    )


def deduplicated(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stand for their components, with df's columns; rows with a null id or without words stay.

    Rows that repeat both id and text stand or fall together.
    """
    found = near_duplicates(df, n, num, den, id_col, text_col)
    key = [F.col(f"`{id_col}`").alias("_id"), F.col("text_key").alias("_key")]
    gone = found.select(*key, "first").filter(F.col("_id").isNotNull()).groupBy("_id", "_key").agg(F.max("first").alias("kept")).filter("not kept")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(f"`{id_col}`").alias("_own"), F.xxhash64(F.col(f"`{text_col}`")).alias("_text"))
    return rows.join(gone, (F.col("_own") == F.col("_id")) & (F.col("_text") == F.col("_key")), "left_anti").select("_row.*")
