"""The pipeline's stages, each against a plain version on its own input."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows = []
    for i in range(160):
        bad = i % 8 == 7
        rows.append((i, " ".join(word() + ("$$$" if bad else "") for _ in range(60)), "en", "big" if i % 3 else "small"))
    for k in range(20):
        rows.append((1000 + k, rows[k][1], "en", "big"))  # exact copies
        w = rows[30 + k][1].split(" ")
        w[5] = "changed"
        rows.append((2000 + k, " ".join(w), "en", "big"))  # near copies
    d = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(i, t, lang, s, len(t)) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 0 if i % 8 == 7 else 1, 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.collect())
        if k < 4:
            assert docs.columns == columns
    quality, exact, near, mix, coded = kept
    bad = {i for i in range(160) if i % 8 == 7}
    copied_bad = {1000 + i for i in range(20) if i in bad} | {2000 + k for k in range(20) if 30 + k in bad}
    gone = set(first) - {r.doc_id for r in quality}
    assert gone <= bad | copied_bad and len(gone) >= len(bad | copied_bad) - 15  # the share has two standard errors of room
    texts = {}
    for r in sorted(quality, key=lambda r: r.doc_id):
        texts.setdefault(r.text, r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(texts.values())

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    rows = sorted(exact, key=lambda r: r.doc_id)
    up = {r.doc_id: r.doc_id for r in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in rows:
        for b in rows:
            if b.doc_id < a.doc_id:
                x, y = grams(a.text), grams(b.text)
                if len(x & y) >= 0.8 * len(x | y):
                    u, v = find(a.doc_id), find(b.doc_id)
                    up[max(u, v)] = min(u, v)
    assert sorted(r.doc_id for r in near) == sorted({find(i) for i in up})
    times = Counter(r.doc_id for r in mix)
    assert set(times) == {r.doc_id for r in near} and max(times.values()) <= 2
    assert len(coded) == len(mix) and Counter(r.doc_id for r in coded) == times
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(corpus_pipeline.vocabulary("word_bpe_49k.json"))
    for r in coded[:40]:
        ids = library.encode(first[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()


def test_run_gives_the_stages_result(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    by = lambda df: Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect())
    out = by(corpus_pipeline.run(spark, folder))
    assert out == by(docs) and sum(out.values()) > 100


def test_run_on_odd_rows(spark, folder, tmp_path):
    """Null ids, null and empty texts, repeated ids and rows, and columns with names that stages use."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    base = " ".join(f"word{k}" for k in range(60))
    odd = [(None, base), (None, None), (5001, None), (5002, ""), (5003, "one"), (5003, "two of one id"), (5004, base + " x"), (5004, base + " x")]
    more = spark.createDataFrame([(i, t, "en", None, 0) for i, t in odd], docs.schema)
    names = ("kept", "key", "n_tokens", "epoch", "block", "_id", "_key", "row", "text_key", "first", "h")
    wide = docs.unionByName(more)
    for n in names:
        wide = wide.withColumn(n, F.lit("own"))
    wide.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    last = wide.columns
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == last
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.filter("key <> 'own' or n_tokens <> 'own'").count() == 0
    assert {r.text for r in docs.filter("doc_id = 5003").collect()} == {"one", "two of one id"}
    assert docs.filter("doc_id = 5004").count() <= 2 and corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_run_on_nothing(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_encoding_holds_little_in_a_worker():
    """What a million distinct words leave in a worker: about 30 MB of words beside the dicts' tables, not some 90."""
    import itertools
    import sys

    from chronofact.llm import bpe

    coder = bpe.WordBPE(corpus_pipeline.vocabulary("word_bpe_49k.json"))
    words = map("".join, itertools.product("abcdefghij", repeat=6))
    while some := list(itertools.islice(words, 20_000)):
        coder.encode(" ".join(some))
    held = sum(sys.getsizeof(k) + sys.getsizeof(v) for part in (coder._encoded, coder._encoded.old) for k, v in part.items())
    assert 0 < held < 45 << 20
    assert coder._encoded.limit + coder.merges._fits.limit <= 64 << 20


def test_mixing_starts_no_python_workers(spark, folder):
    """The table of sources is a part of the plan, not an RDD that Python workers make."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = corpus_pipeline.mix_sources(spark, docs, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan and "LogicalRDD" not in plan


def test_selection_sends_texts_once(spark, folder):
    """The rows that go to Python hold the text within the row only."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.quality_classifier(spark, docs, folder)
    plan = out._jdf.queryExecution().analyzed().toString()
    sent = next(line for line in plan.splitlines() if "struct(doc_id" in line)
    assert " AS text#" not in sent
