"""Each operator against a plain version, and on nulls, empty tables, repeated rows and clashing names."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chronofact.llm import bpe, components, dedup, importance, jaccard_join, langid, licenses, mixing, quality_rules, sharding, token_counts
from chronofact.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], SCHEMA)


def prose(rng, n, letters="abcdefg"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = [(None, "no id", "en", "a"), (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "same", "en", "b"), (4, "same", "en", "b"), (5, "same", None, "b")]
    for i in range(10, 60):
        out.append((i, prose(rng, rng.randint(1, 80)) + rng.choice(["", ".", "\nHome\n", "\n\nMénage Über."]), rng.choice(["en", "de"]), rng.choice("abbb")))
    out.append((60, "word " * 30_000, "en", "b"))
    return out


def clashing(df):
    for name in ("kept", "shard", "slot", "size", "rows", "h", "n", "key", "rid", "run", "digest", "row", "id", "root", "epoch", "block", "_row", "place"):
        df = df.withColumn(name, F.lit("x"))
    return df


def test_sharding(spark, rows):
    df = clashing(docs_of(spark, rows))
    out = sharding.external_shuffle(df, 7, bucket_bytes=2000).select("row.doc_id", "row.shard", F.col("shard").alias("own"), "slot", "size", "row.text").collect()
    assert Counter((r[0], r[5]) for r in out) == Counter((i, t) for i, t, *_ in rows)
    by = defaultdict(list)
    for r in out:
        assert r[4] == len((r[5] or "").encode()) + 16
        by[r[2]].append(r[3])
    sizes = [len(v) for v in by.values()]
    assert len(by) == 7 and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    order = [r[0] for r in sorted(out, key=lambda r: (r[2], r[3]))]
    assert order != sorted(order, key=lambda i: -1 if i is None else i)
    assert sharding.external_shuffle(df.limit(0), 7).count() == 0


def test_fisher_yates(spark):
    """The native permutation against a plain one with the same draws."""
    n, seed, bucket = 37, 42, 5
    draws = spark.range(1).select(F.array(*[F.pmod(F.xxhash64(F.lit(seed), F.lit(bucket).cast("long"), F.lit(k)), F.lit(k).cast("long")) for k in range(1, n + 1)])).first()[0]
    rest, out = list(range(n)), []
    for left in range(n, 0, -1):
        j = draws[left - 1]
        out.append(rest[j])
        rest[j] = rest[left - 1]
        rest.pop()
    found = spark.range(1).select(sharding.fisher_yates(F.lit(n), F.lit(seed), F.lit(bucket).cast("long"))).first()[0]
    assert found == out and sorted(out) == list(range(n)) and out != list(range(n))
    df = docs_of(spark, [(i, "x" * (i % 7), "en", "a") for i in range(500)]).coalesce(1)
    once, again = (sorted((r.shard, r.slot, r[2]) for r in sharding.external_shuffle(d, 4, bucket_rows=20).select("shard", "slot", "row.doc_id").collect()) for d in (df, df))
    assert once == again


def test_written_shards(spark, rows, tmp_path):
    df = docs_of(spark, rows)
    sharding.write_shards(sharding.external_shuffle(df, 3), str(tmp_path / "s"), file_rows=5)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(rows) and back.select("shard").distinct().count() == 3


def base_counts(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, rows):
    more = [(100, "a b c a b c a b c", "en", "a"), (101, "line one.\nline one.\n\nline one.", "en", "a"), (102, "A|B <x> #1 $2\x0bz", "en", "a"), (103, "é ü 漢字 é ü 漢字 é", "en", "a")]
    good = " ".join(f"word{i}" for i in range(70)) + "."
    more += [(104, good, "en", "a"), (105, good + "\nHome\nAccept all cookie settings now please friend.", "en", "a"), (106, "\n".join(f"item{i} | next{i}" for i in range(60)), "en", "a")]
    df = clashing(docs_of(spark, rows + more))
    out = {(r.doc_id): r for r in quality_rules.quality_rules(df).collect()}
    for i, t, *_ in rows + more:
        r = out[i]
        counts = base_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts, i
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
    assert out[104].kept and out[105].kept and not out[106].kept and not out[1].kept
    assert out[105].clean_text == good
    assert quality_rules.quality_rules(df.limit(0)).count() == 0


def plain_line_passes(line):
    words = WORD.findall(line)
    marks = sum(c in quality_rules.SYMBOLS for c in line)
    parts = sum(c in "|>»•" for c in line) + 1
    ended = line.rstrip(" \t\n\x0b\x0c\r")[-1:] in set(quality_rules.TERMINAL)
    punctuation = marks * 5 <= len(words) and line.count("!") * 5 <= len(words) + 4 and (ended or len(words) >= quality_rules.SHORT_LINE)
    bare = re.sub(r"^[^a-zà-ÿ]*|[^a-zà-ÿ]*$", "", line.lower())
    navigation = bare not in quality_rules.MENU and (parts == 1 or parts * 3 < len(words))
    return punctuation and navigation and not any(p in line.lower() for p in quality_rules.PHRASES)


def test_quality_lines_against_a_plain_version(spark):
    rng = random.Random(31)
    ends = ["", ".", "!", "。", "؟", "…", " .", ".\t", "|", "|", ">", "!!", '"', "»"]
    bits = ["word", "Home", "menu", "Cookie", "click here", "a|b", "#", "*", "!", "ü", "漢字。", "All Rights Reserved", "x", "y z w"]
    texts = ["\n".join(" ".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) + rng.choice(ends) for _ in range(rng.randint(1, 8))) for _ in range(300)]
    texts += ["[Home]", "- log in -", "  Back to Top  ", "short line", "शब्द है।", "x\r\ny.", "a b c\x0b."]
    for r in quality_rules.quality_rules(docs_of(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect():
        lines = [x for x in texts[r.doc_id].split("\n") if WORD.search(x)]
        good = [x for x in lines if plain_line_passes(x)]
        assert r.clean_text == "\n".join(good), texts[r.doc_id]
        left, solid = (sum(len(w) for x in xs for w in WORD.findall(x)) for xs in (good, lines))
        assert r.left_chars == left and r.kept == (not r.base_failed and 100 * left >= 50 * solid)


def test_repeated_windows_whose_hashes_share_their_high_bits(spark):
    """With few bits of the hash left, unlike windows meet; counts stay exact."""
    rng = random.Random(32)
    words = [rng.choice(["a", "b", "c", "d", "e", "f", "g"]) for _ in range(400)]
    slow = F.split(F.lit(" ".join(words)), " ")
    real = F.xxhash64
    try:
        quality_rules.F.xxhash64 = lambda *c: F.shiftrightunsigned(real(*c), 50)  # so all high bits are equal
        found = spark.range(1).select(quality_rules.repeated_words(slow)).first()[0]
    finally:
        quality_rules.F.xxhash64 = real
    hashes = [r for r in spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(397)), lambda i: F.shiftrightunsigned(F.xxhash64(F.get(slow, i), F.get(slow, i + 1), F.get(slow, i + 2)), 50))).first()[0]]
    counts = Counter(hashes)
    assert found == len({k for i, h in enumerate(hashes) if counts[h] > 1 for k in (i, i + 1, i + 2)})


def brute_components(rows, n, num, den):
    sets = []
    for i, t, *_ in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
                continue
            o = len(sets[a] & sets[b])
            if den * o >= num * (len(sets[a]) + len(sets[b]) - o):
                up[find(a)] = find(b)
    low = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            low[find(k)] = min(low.get(find(k), r[0]), r[0])
    return Counter((r[0], len(s), None if r[0] is None else low[find(k)]) for k, (r, s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80)])
def test_jaccard_join(spark, rows, n, num):
    rng = random.Random(n)
    made = list(rows)
    for k in range(12):
        base = prose(rng, rng.choice([4, 20, 63, 66, 130, 260, 300])).split(" ")
        for c in range(5):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(["zz", "THE", "q"])
            made.append((1000 + 10 * k + c, " ".join(copy), "en", "a"))
    found = jaccard_join.near_duplicates(clashing(docs_of(spark, made)), n, num, 100).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(made, n, num, 100)


def test_jaccard_join_of_a_quoted_passage(spark):
    """The leaders of the passage's keys are texts that quote it, too long to be near anything."""
    rng = random.Random(0)
    passage = prose(rng, 12).split(" ")
    made = [(1, " ".join(passage), "en", "a"), (2, " ".join([*passage[:-1], "zz"]), "en", "a")]
    made += [(10 + k, " ".join([*passage[:-1], *prose(rng, 19, "hijklmn").split(" ")]), "en", "a") for k in range(40)]
    found = jaccard_join.near_duplicates(docs_of(spark, made).coalesce(1), 3, 80, 100).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(made, 3, 80, 100)


def changed(rng, words, k):
    out = list(words)
    for at in rng.sample(range(len(out)), k):
        out[at] = "".join(rng.choice("xyzw") for _ in range(8))
    return out


def compared(spark, made, n, num, **how):
    found = jaccard_join.near_duplicates(docs_of(spark, made), n, num, 100, **how).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(made, n, num, 100)
    return found


def test_jaccard_join_of_long_sets(spark):
    """Sets of over COARSE n-grams, whose overlaps are counted in fragments, near the limit on both sides."""
    rng = random.Random(21)
    base = prose(rng, 11_000, "abcdefghijklmn").split(" ")
    made = [(k, " ".join(changed(rng, base, c)), "en", "a") for k, c in enumerate([0, 100, 230, 260, 300, 500])]
    made += [(100 + k, " ".join(changed(rng, base[:c], 40)), "en", "a") for k, c in enumerate([9_500, 8_700])]
    compared(spark, made, 5, 80)


def test_jaccard_join_of_a_large_group_of_near_copies(spark):
    rng = random.Random(22)
    base = prose(rng, 60, "abcdefghijklmn").split(" ")
    made = [(k, " ".join(changed(rng, base, rng.randint(0, 3))), "en", "a") for k in range(1000)]
    made += [(2000 + k, " ".join([*base[:20], *prose(rng, 25, "hijklmn").split(" ")]), "en", "a") for k in range(60)]
    found = compared(spark, made, 5, 80)
    assert max(Counter(r.component_id for r in found).values()) > 300


def test_jaccard_join_at_the_limit(spark):
    """9m n-grams in common of 10m in all but m: similar; with one more that differs: not."""
    rng = random.Random(23)
    made = []
    for k, m in enumerate([2, 5, 9, 30, 77, 200]):
        words = prose(rng, 9 * m + 4, "abcdefghijklmn").split(" ")
        size = len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
        for extra in (0, 1):
            tail = size // 9 + extra  # words at the end that differ take as many n-grams
            made.append((100 * k + extra + 1, " ".join([*words[: len(words) - tail], *changed(rng, words[-tail:], tail)]), "en", "a"))
        made.append((100 * k, " ".join(words), "en", "a"))
    compared(spark, made, 5, 80)


def test_jaccard_join_with_few_fragments(spark):
    """So few fragments that sets fill too few: single n-grams are added for their sizes."""
    rng = random.Random(24)
    made = []
    for k in range(25):
        base = prose(rng, rng.choice([70, 118, 126, 130, 150, 240, 255, 300, 500, 640]), "abcdefghijklmn").split(" ")
        made += [(10 * k + c, " ".join(changed(rng, base, rng.randint(0, len(base) // 40))), "en", "a") for c in range(4)]
    df = docs_of(spark, made)
    assert jaccard_join.features(df, "doc_id", "text", 5, 80, 100, 1.05).filter("deficient >= 0").count() > 10
    assert jaccard_join.features(df, "doc_id", "text", 5, 80, 100).filter("deficient >= 0").count() == 0
    compared(spark, made, 5, 80, spread=1.05)


def test_near_duplicates_rows_with_one_id(spark):
    """Decisions are by row: versions of an id stand or fall by their own text."""
    base = [f"w{k}" for k in range(60)]
    near = [*base[:-1], "other"]
    made = [(1, " ".join(base), "en", "a"), (1, "a text of its own", "en", "a"), (2, " ".join(near), "en", "a"), (2, "one more alone", "en", "a"), (None, " ".join(base), "en", "a"), (None, None, "en", "a"), (3, None, "en", "a"), (4, "", "en", "a"), (2, " ".join(near), "en", "a")]
    df = clashing(docs_of(spark, made))
    kept = jaccard_join.deduplicated(df)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((i, t) for i, t, *_ in made if t != " ".join(near))
    assert jaccard_join.deduplicated(df.limit(0)).count() == 0


def test_jaccard_join_of_nothing(spark):
    df = docs_of(spark, [(1, "a", "en", "a")])
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0
    assert [(r.doc_id, r.component_id) for r in jaccard_join.near_duplicates(df).collect()] == [(1, 1)]


def test_segments_agree_in_all_but_the_differing_fragments():
    import numpy as np

    rng = np.random.default_rng(0)
    for size in (64, 100, 127, 500, 5000):
        s = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        k = int(np.ceil(2 ** (size.bit_length()) * 0.25 * 1.25))
        keys = jaccard_join.segment_keys(s, k)
        d = size // 5
        changed = np.unique(np.concatenate([s[rng.permutation(len(s))[d:]], rng.integers(0, 2**64, d // 2, dtype=np.uint64)]))
        assert len(keys) - len(set(keys.tolist()) & set(jaccard_join.segment_keys(changed, k).tolist())) <= d + d // 2


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)]
    found = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        up[max(a, b)] = min(a, b)
    nodes = {x for u, v in edges if u != v for x in (u, v)}
    assert found == {x: find(x) for x in nodes}
    assert components.connected(spark.createDataFrame([], "u long, v long")).count() == 0


def labelled(spark, n=300):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randint(20, 90)).split(" ")
        bad = i % 5 == 0
        rows.append((i, " ".join(w + "***" if bad else w for w in words), "en", "a"))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1, 0))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_importance(spark):
    rows, labels = labelled(spark)
    odd = [(None, "good words here", "en", "a"), (9001, None, "en", "a"), (9002, "", "en", "a"), (9003, "*** " * 300_000, "en", "a"), (0, rows[0][1], "en", "a")]
    df = clashing(docs_of(spark, rows + odd)).drop("kept", "key")
    weights = importance.fitted(df, labels)
    good = sum(r.quality for r in labels.collect())
    p = good / 150
    assert math.isclose(weights.share, p + 2 * math.sqrt(p * (1 - p) / 150))
    out = importance.scored(df, weights).collect()
    kept = {r.doc_id: r.kept for r in out}
    assert all(kept[i] for i in range(300) if i % 5)
    assert sum(kept[i] for i in range(300) if i % 5 == 0) < 40
    assert not kept[9001] and not kept[9002]
    keys = sorted((r.key for r in out if r.key is not None), reverse=True)
    assert weights.least == keys[math.ceil(weights.share * len(out)) - 1]
    assert Counter(r.doc_id for r in importance.selected(df, weights).collect()) == Counter(r.doc_id for r in out if r.kept)
    empty = importance.fitted(df.limit(0), labels.limit(0))
    assert importance.scored(df.limit(0), empty).count() == 0
    names = df.withColumn("doc_id", F.concat(F.lit("x"), F.col("doc_id")))
    named = importance.scored(names, importance.fitted(names, labels.withColumn("doc_id", F.concat(F.lit("x"), F.col("doc_id"))))).collect()
    assert all(r.kept for r in named if r.doc_id and r.doc_id[1:].isdigit() and int(r.doc_id[1:]) < 300 and int(r.doc_id[1:]) % 5)


def test_importance_keys_are_weights_and_noise(spark):
    """Held against a plain version of ratios, temperature, and top k."""
    rows, labels = labelled(spark, 60)
    df = docs_of(spark, rows)
    weights = importance.fitted(df, labels, keep_share=0.5)
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    raw, target = Counter(), Counter()
    bags = {i: importance.buckets([t.encode()])[0].tolist() for i, t, *_ in rows}
    for i, at in bags.items():
        raw.update(at)
        target.update(at if i in good else [])
    scale = sum(target.values()) / sum(raw.values())
    ratio = {b: math.log((target[b] + importance.PRIOR) / (raw[b] * scale + importance.PRIOR)) for b in raw}
    out = {r.doc_id: r for r in importance.scored(df, weights).collect()}
    for i, at in bags.items():
        assert math.isclose(out[i].log_weight, sum(ratio[b] for b in at) * min(1, importance.TEMPERED / len(at)), abs_tol=1e-9)
    best = sorted(out.values(), key=lambda r: -r.key)[:30]
    assert {r.doc_id for r in best} == {i for i, r in out.items() if r.kept}


def test_importance_sampling_follows_the_weights():
    """Texts near the k-th key are drawn by chance: their rates rise with the weight, and no threshold gives the choice."""
    import numpy as np

    rng = np.random.default_rng(0)
    weight, k = np.sort(rng.normal(0, 1, 2000)), 1000
    rate = np.zeros(2000)
    for seed in range(60):
        key = weight + importance.noise(rng.integers(-(2**62), 2**62, 2000), seed)
        rate += key >= np.sort(key)[-k]
    rate /= 60
    fifths = [rate[j : j + 400].mean() for j in range(0, 2000, 400)]
    assert fifths == sorted(fifths) and 0.05 < fifths[0] < 0.4 and 0.6 < fifths[4] < 0.98
    # inclusion of a draw without replacement: 1 - exp(-w * c), with c so that k are drawn
    low, high = 0.0, 100.0
    for _ in range(60):
        c = (low + high) / 2
        low, high = (c, high) if (1 - np.exp(-np.exp(weight) * c)).sum() < k else (low, c)
    assert np.abs([fifths[j] - (1 - np.exp(-np.exp(weight[400 * j : 400 * j + 400]) * c)).mean() for j in range(5)]).max() < 0.03


def test_sample_bounds_at_any_size():
    from chronofact.llm._common import sample_bound

    for n in (1, 10, 20_001, 10**8, 10**11, 10**15):
        share = sample_bound(20_000, n) / 2**63
        assert 0 < share <= 1 and math.isclose(share, min(1, 20_000 / n), rel_tol=1e-6)


def test_kth_largest(spark):
    rng = random.Random(2)
    values = [rng.choice([rng.gauss(0, 1), 0.5]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    ordered = sorted(values, reverse=True)
    for k in (1, 10, 700, 1500, 2999):
        assert importance.kth_largest(df, "x", k, bins=16, enough=50) == ordered[k - 1]


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(6)
    letters = "abcdefghij   \t\n'stdréèàüß½ΣσςİI中文日本́e🙂0123!?.,-_<|>endoftext\x00\x1c\x85ɏᲉ"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    parts = ["the", "internationalization", "don't", "WE'VE", "<|endoftext|>", "<|startoftext|>", "<s>", "<0x0A>", "aaaaaaaa", "    ", "\n\n", "......"]
    out += [rng.choice(["", " "]).join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(300)]
    return [*out, None, "", "x" * 20_000, "Καλημέρα ΟΔΟΣ " * 50]


def test_bpe_against_the_library(spark, odd_texts):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    df = docs_of(spark, [(i, t, "en", "a") for i, t in enumerate(odd_texts)])
    for r in bpe.encoded(df, path).collect():
        ids = library.encode(odd_texts[r.doc_id] or "", add_special_tokens=False).ids
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert bytes(r.ids) == packed and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(packed).hexdigest()
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encoded(df.limit(0), path).count() == 0
    assert Counter(r.doc_id for r in bpe.encoded(clashing(df.limit(9)), path).collect()) == Counter(range(9))


def test_token_counts_against_the_library(spark, odd_texts):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    df = docs_of(spark, [(i, t, "en", "a") for i, t in enumerate(odd_texts)])
    for r in token_counts.token_counts(df, path, 20).collect():
        t = odd_texts[r.doc_id] or ""
        assert r.n_tokens == len(library.encode(t)) and r.n_bytes == len(t.encode()) and r.over_limit == (r.n_tokens > 20)
        assert len(library.encode(t[: r.fit_chars])) <= 20 and (r.fit_chars == len(t) or len(t) > 300 or len(library.encode(t[: r.fit_chars + 1])) > 20)
    counter = token_counts.loaded(path)
    for t in [t for t in odd_texts[:80] if t]:
        table, each = counter.table(t), [len(library.encode(t[:i])) for i in range(len(t) + 1)]
        assert [table.at(i) for i in range(len(t) + 1)] == each
        for budget in (1, 4, 9):
            assert table.longest(budget) == max(i for i, c in enumerate(each) if c <= budget)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(spark, rows, keep):
    df = clashing(docs_of(spark, rows)).repartition(5)
    out = dedup.exact_dedup(df, keep=keep, fan_in=2).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    assert len(out) == len(rows)
    kept = Counter()
    for r in out:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        ids = [i for i in groups[text] if i is not None]
        assert r.group_size == len(groups[text])
        assert r.keep_id == (None if not ids else max(ids) if keep == "largest" or len(ids) == 0 else min(ids))
        kept[text] += r.kept
    assert all(kept[t] == 1 for t in groups)
    assert dedup.deduplicated(docs_of(spark, rows), keep=keep).count() == len(groups)
    assert dedup.exact_dedup(df.limit(0)).count() == 0


def test_language_id(spark):
    rng = random.Random(3)
    letters = {"en": "abcdefg", "de": "hijklmn", "xx": "opqrstu"}
    rows = [(i, prose(rng, 40, letters[lang]), lang, "a") for i in range(150) for lang in [rng.choice(list(letters))]]
    model = langid.trained(docs_of(spark, rows[:100]).select(F.col("doc_id").alias("id"), "text", "lang"))
    odd = [(None, "abc bca", None, "a"), (900, None, None, "a"), (901, "123 !!", None, "a"), (902, "", None, "a"), (903, "жжж", None, "a")]
    out = {r.doc_id: r for r in langid.identified(clashing(docs_of(spark, rows[100:] + odd)), model).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang, _ in rows[100:])
    assert all(0 <= r.score <= 1 for r in out.values())
    assert [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and out[903].lang_pred in letters
    nothing = langid.trained(docs_of(spark, rows).limit(0).select(F.col("doc_id").alias("id"), "text", "lang"))
    assert {r.lang_pred for r in langid.identified(docs_of(spark, rows[:5]), nothing).collect()} == {"und"}


def test_language_filter_has_no_false_negatives():
    import numpy as np

    rng = np.random.default_rng(1)
    known = [rng.integers(0, 2**63, 500, dtype=np.uint64) for _ in range(3)]
    f = langid.BitSlicedFilter(["a", "b", "c"], [1, 1, 1], known, table_bits=14)
    for k, g in enumerate(known):
        assert np.all(f.languages(g)[0] >> np.uint8(k) & np.uint8(1))
    other = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    for k in range(3):
        assert abs(np.mean(f.languages(other)[0] >> np.uint8(k) & np.uint8(1)) - f.false[k]) < 0.01


def plain_grams(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    joined = " " + " ".join(letters.split()) + " "
    return [joined[i : i + n] for n in langid.SIZES for i in range(len(joined) - n + 1)] if letters.split() else []


def test_language_counts_and_predictions_against_plain_ones(spark):
    rng = random.Random(13)
    letters = {"en": "abcdefé", "de": "hijkdefü", "xx": "opqrsde"}
    rows = [(i, prose(rng, 25, letters[lang]) + rng.choice([".", " 12!", ""]), lang, "a") for i in range(90) for lang in [rng.choice(list(letters))]]
    training = docs_of(spark, rows[:60]).select(F.col("doc_id").alias("id"), "text", "lang")
    chosen, sizes = langid.training_rows(training, 20_000, 256)
    counts = defaultdict(Counter)
    for _, t, lang, _ in rows[:60]:
        counts[lang].update(plain_grams(t))
    assert sizes == Counter(lang for _, _, lang, _ in rows[:60])
    assert Counter((r.lang, r.n) for r in langid.gram_counts(chosen).collect()) == Counter((lang, n) for lang, c in counts.items() for n in c.values())
    kept = {lang: {g: n for g, n in c.items() if n >= 3} for lang, c in counts.items()}
    part = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in kept.items()}
    known = {lang: {g for g, x in p.items() if x * 20 >= max(q.get(g, 0) for q in part.values())} for lang, p in part.items()}
    model = langid.trained(training)
    assert {lang: len(g) for lang, g in known.items()} == {lang: sum(n for n in [len(known[lang])]) for lang in model.langs}
    for r in langid.identified(docs_of(spark, rows[60:]), model).collect():
        own = plain_grams(next(t for i, t, *_ in rows if i == r.doc_id))
        hits = {lang: sum(g in known[lang] for g in own) for lang in sorted(known)}
        best = max(sorted(hits), key=lambda x: hits[x])
        assert r.lang_pred == best and abs(r.score - hits[best] / sum(hits.values())) < 0.02


def test_languages_are_many_and_sampled_apart(spark):
    alphabet = [chr(c) for c in range(0x4E00, 0x4E00 + 400)]
    rng = random.Random(5)
    text = lambda k: prose(rng, 30, alphabet[4 * k : 4 * k + 4])
    rows = [(i, text(k), f"l{k:03}", "a") for i, k in enumerate([k for k in range(100) for _ in range(4)] + [0] * 2000)]
    training = docs_of(spark, rows).select(F.col("doc_id").alias("id"), "text", "lang")
    chosen, sizes = langid.training_rows(training, 2000, 256)
    by = {r.lang: r["count"] for r in chosen.groupBy("lang").count().collect()}
    assert len(sizes) == 100 and sizes["l000"] == 2004 and by["l000"] < 60 and all(by[f"l{k:03}"] == 4 for k in range(1, 100))
    model = langid.trained(training, max_rows=2000)
    assert len(model.langs) == 100 and len(model.tables) == 2
    tests = docs_of(spark, [(k, text(k), None, "a") for k in range(100)])
    assert all(r.lang_pred == f"l{r.doc_id:03}" for r in langid.identified(tests, model).collect())
    assert len(langid.trained(training, max_langs=5).langs) == 5


def test_long_texts_are_done_in_parts(monkeypatch):
    from chronofact.llm import _text

    text = ("one two  three\nfour " * 50 + "x" * 300 + " five").encode()
    whole = _text.word_hashes([b"a b", text, b""], lower=True)
    monkeypatch.setattr(_text, "SLICE_BYTES", 64)
    monkeypatch.setattr(_text.parts_of, "__defaults__", (64,))
    parts = _text.word_hashes([b"a b", text, b""], lower=True)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    assert b"".join(_text.parts_of(text)) == text and max(map(len, _text.parts_of(text))) <= 310
    t = "ab cd" * 50
    assert "".join(langid.pieces(t, 20)) == t and max(map(len, langid.pieces(t, 20))) <= 20


def test_license_scans(spark):
    rng = random.Random(8)
    notices = {"mit": "Released under the MIT License.", "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.", "apache-2.0": "Licensed under the Apache License, Version 2.0.", "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0."}
    rows = [(i, prose(rng, 30), "en", "a") for i in range(60)]
    rows += [(100 + k, f"{prose(rng, 30)}\n{t}\n{prose(rng, 5)}", "en", "a") for k, t in enumerate(notices.values())]
    rows += [(200, None, "en", "a"), (201, "", "en", "a"), (None, notices["mit"], "en", "a"), (202, "Licensed under the Foo Private License, all rights reserved under the terms of our own license", "en", "a")]
    df = clashing(docs_of(spark, rows))
    out = {r.doc_id: r.notices for r in licenses.scanned(df, licenses.fitted(df)).collect()}
    texts = {i: t for i, t, *_ in rows}
    assert all(not out[i] for i in [*range(60), 200, 201])
    for k, (family, line) in enumerate(notices.items()):
        (n,) = out[100 + k]
        assert n.family == family and texts[100 + k][n.begin : n.end] == line and n.line == 1
    assert [n.family for n in out[None]] == ["mit"]
    assert all(n.family == licenses.UNKNOWN for n in out[202])
    assert licenses.scanned(df.limit(0), licenses.fitted(df)).count() == 0


@pytest.fixture(scope="module")
def scanner():
    rng = random.Random(28)
    return licenses.trained([prose(rng, 20, "abcdefghijklmnop").encode() for _ in range(300)])


def families(scanner, *lines):
    return [x[4] for x in scanner.scan([t.encode() for t in lines], [k > 0 for k in range(len(lines))])]


@pytest.mark.parametrize(
    "line,family",
    [
        ("This program is licensed under the GNU General Public License, version 2.", "gpl-2.0"),
        ("This work is licensed under the GNU General Public License, version 3", "gpl-3.0"),
        ("SPDX-License-Identifier: GPL-2.0", "gpl-2.0"),
        ("SPDX-License-Identifier: LGPL-2.1", "lgpl-2.1"),
        ("SPDX-License-Identifier: BSD-2-Clause", "bsd-2-clause"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
        ("Licensed under CC BY 3.0", "cc-by-3.0"),
        ("Licensed under CC BY-NC-SA 2.0", "cc-by-nc-sa-2.0"),
        ("Creative Commons Attribution-NoDerivatives 4.0 International License", "cc-by-nd-4.0"),
        ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    ],
)
def test_license_families(scanner, line, family):
    assert families(scanner, line) == [family]


@pytest.mark.parametrize(
    "line,allowed",
    [
        ("GNU General Public License, version 2", {"gpl-2.0"}),
        ("CC BY 3.0", {"cc-by-3.0"}),
        ("Apache License, Version 1.1", {"apache-1.1"}),
        ("Released under the Apache License 1.0", set()),
        ("Mozilla Public License, version 1.1", {"mpl-1.1"}),
        ("Attribution-NoDerivatives 4.0", {"cc-by-nd-4.0"}),
        ("BSD-2-Clause", {"bsd-2-clause"}),
        ("Licensed under the Gnat Community License, version 3", set()),
    ],
)
def test_license_kin_is_told_apart(scanner, line, allowed):
    assert set(families(scanner, line)) <= allowed | {licenses.UNKNOWN}


@pytest.mark.parametrize("line", ["He lost his driver's license on the way home", "Next year the town will license new taxi drivers", "free of charge, the museum gave the public a general tour", "she released the dog under the old bridge"])
def test_a_notices_words_are_no_notice(scanner, line):
    assert families(scanner, line) == []


def test_license_notice_over_two_lines(scanner):
    assert families(scanner, "It says: This work is licensed under the GNU", "General Public License, version 2. And so on") == ["gpl-2.0"]
    assert families(scanner, "It says: This work is licensed under the GNU", "", "General Public License, version 2. And so on") != ["gpl-2.0"]


def test_template_comparison_is_the_share_of_pairs(scanner):
    text = b"licensed under the Apache License, Version 2.0"
    k = scanner.names.index("apache-2.0")
    pairs = licenses.word_pairs(text)
    plain = lambda t: {p for w in [re.findall(r"[a-z0-9]+|[^a-z0-9\s]+", t.lower())] for p in zip(w, w[1:])}
    own = plain(text.decode())
    assert math.isclose(scanner.share(k, pairs), max(len(plain(t) & own) / len(plain(t)) for t in licenses.TEMPLATES["apache-2.0"]))


def test_license_notices_inside_long_lines(spark):
    rng = random.Random(18)
    notices = {"mit": "Released under the MIT License.", "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.", "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.", "unknown": "Use is subject to the license agreement."}
    rows = [(i, prose(rng, 500), "en", "a") for i in range(40)]
    rows += [(100 + k, f"é\n{prose(rng, 250)} {t} {prose(rng, 250)}", "en", "a") for k, t in enumerate(notices.values())]
    rows.append((200, f"{prose(rng, 200)} {notices['mit']} {prose(rng, 200)} {notices['gpl-3.0']} {prose(rng, 100)}", "en", "a"))
    df = docs_of(spark, rows)
    out = {r.doc_id: r.notices for r in licenses.scanned(df, licenses.fitted(df)).collect()}
    assert all(not out[i] for i in range(40))
    texts = {i: t for i, t, *_ in rows}
    for k, (family, notice) in enumerate(notices.items()):
        (n,) = out[100 + k]
        assert n.family == family and n.line == 1
        # the span may have words more or one less at its ends
        assert " ".join(notice.split()[1:-1]) in texts[100 + k][n.begin : n.end] and n.end - n.begin < len(notice) + 250
    assert [n.family for n in out[200]] == ["mit", "gpl-3.0"]


def test_mixing_weights():
    a, budget, w, repeats = mixing.planned_repeats([900, 90, 10, 0], 3.0, None)
    assert math.isclose(max(repeats), 3.0, rel_tol=1e-6) and math.isclose(min(repeats), 1.0)
    assert math.isclose(sum(w), 1.0) and 0 < a < 1
    for t, x, r in zip([900, 90, 10], w, repeats):
        assert math.isclose(r * t / budget, x, rel_tol=1e-9)
    a, _, w, _ = mixing.planned_repeats([900, 90, 10], None, 0.9)
    assert math.isclose(mixing.entropy(w), 0.9, rel_tol=1e-6)
    assert mixing.planned_repeats([5, 5], 1.0, None)[3] == [1.0, 1.0]


def test_mixing(spark, rows):
    made = [r for r in rows if r[0] != 60] + [(2000 + k, "one two three", "en", "big") for k in range(400)] + [(3000 + k, "four five", "en", "small") for k in range(30)]
    df = clashing(docs_of(spark, made))
    out = mixing.mixed(df, max_repeats=2.5, block_tokens=300).collect()
    tokens, mixed = Counter(), Counter()
    for i, t, _, s in made:
        tokens[s] += len(WORD.findall(t or ""))
    times = Counter((r.doc_id, r.text) for r in out)
    assert set(times) == {(i, t) for i, t, *_ in made}
    for r in out:
        mixed[r.source] += r.n_tokens
        assert 0 <= r.mix_key < 1 and r.n_tokens == len(WORD.findall(r.text or ""))
    blocks = max(r.block for r in out) + 1
    assert blocks == math.ceil(mixing.planned_repeats(list(tokens.values()), 2.5, None)[1] / 300)
    held = Counter((r.source, r.block) for r in out for _ in range(r.n_tokens))
    for s, total in mixed.items():
        most = max((len(WORD.findall(t or "")) for _, t, _, x in made if x == s), default=0)
        for b in range(blocks):  # each source has its budget in each block, but for a document at each end
            assert abs(held[s, b] - total / blocks) <= 2 * most + 1
    _, _, _, repeats = mixing.planned_repeats(list(tokens.values()), 2.5, None)
    longest = {s: max(len(WORD.findall(t or "")) for _, t, _, x in made if x == s) for s in tokens}
    for s, r in zip(tokens, repeats):
        assert r * tokens[s] - longest[s] - 1 <= mixed[s] <= r * tokens[s] + 1e-6
        per = [times[i, t] / made.count((i, t, lang, s)) for i, t, lang, x in made if x == s]
        assert max(per) - min(per) <= 1
    assert mixing.mixed(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mixed(df, max_sources=2)


def test_mixing_blocks_are_those_of_running_sums(spark):
    """Blocks against a plain walk along each source's layout."""
    rng = random.Random(3)
    made = [(i, prose(rng, rng.randint(0, 30)), "en", rng.choice("aab")) for i in range(300)]
    out = mixing.mixed(docs_of(spark, made), max_repeats=1.7, block_tokens=500).collect()
    again = docs_of(spark, [(r.doc_id, r.text, r.source, str(r.epoch)) for r in out]).withColumnRenamed("lang", "own").withColumn("epoch", F.col("source").cast("int"))
    hashes = {(r.doc_id, r.epoch): r.h for r in again.select("doc_id", "epoch", mixing._hash(F.col("own"), F.col("epoch"), F.col("doc_id"), 11).alias("h")).collect()}
    blocks = max(r.block for r in out) + 1
    assert blocks > 5
    for s in "ab":
        mine = sorted((r for r in out if r.source == s), key=lambda r: (r.epoch, hashes[r.doc_id, r.epoch]))
        total, run = sum(r.n_tokens for r in mine), 0
        for r in mine:
            assert r.block == min(blocks - 1, run * blocks // total)
            run += r.n_tokens


def test_word_hashes():
    from chronofact.llm._text import word_hashes

    texts = [b"", b"a b a", b" \t", "é  B\nb".encode(), b"x"]
    words, first = word_hashes(texts, lower=True)
    counts = [first[k + 1] - first[k] for k in range(len(texts))]
    assert counts == [0, 3, 0, 3, 1]
    assert words[0] == words[2] and words[1] == words[4] == words[5] and len(set(words.tolist())) == 4
