"""Every stage of the pipeline, and the whole, against plain versions; nulls, empty tables and clashing columns."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from revloom.llm import packing, quality

STRIP = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, keys string, component_id long, score double, h long"


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_lines(docs):
    key = lambda line: line.strip(STRIP).lower()
    first, seen = {}, Counter()
    for i, text in docs:
        if i is not None:
            for k in {key(x) for x in (text or "").split("\n")}:
                seen[k, i] = 1
                first[k] = min(first.get(k, i), i)
    many = {k for k, n in Counter(k for k, _ in seen).items() if n > 1 and len(k) >= 10}
    return [(i, text if i is None or text is None else "\n".join(x for x in text.split("\n") if key(x) not in many or first[key(x)] == i)) for i, text in docs]


def plain_near(docs):
    sets, ids = {}, [i for i, _ in docs if i is not None]
    for i, text in docs:
        if i is not None:
            sets[i] = shingles(text)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(i, t) for i, t in docs if i is None or find(i) == i]


def plain_clean(docs, items):
    sets = [s for s in map(shingles, items) if s]
    return [(i, t) for i, t in docs if i is None or not any(4 * len(s & shingles(t)) >= 3 * len(s) for s in sets)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    vocabulary = [f"word{k}" for k in range(300)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [prose(14) for _ in range(6)] + ["short item here", None, ""]
    good = [f"{prose(rng.randint(30, 90))}.\n{prose(20)}." for _ in range(60)]
    good += ["\n".join(f"{x.rpartition(' ')[0]} changed{k}." for x in t.split("\n")) for k, t in enumerate(good[:12])]  # near copies without a common line
    good += [f"{t} extra" for t in good[:8]] + good[:5] + [f"{prose(40)} {x} {prose(30)}." for x in items[:4]] + [f"A Line That Many Hold\n{prose(25)}.\n a line that many hold " for _ in range(5)]
    bad = ["!!! $$$ ### " * rng.randint(3, 30) for _ in range(40)]
    texts = good + bad + ["", None, prose(9000) + "."]
    rng.shuffle(texts)
    docs = [(k, t, "en", "s", len(t or ""), "k", 1, 0.5, 7) for k, t in enumerate(texts)]
    docs += [docs[3], (None, good[10], "en", "s", 5, "k", 1, 0.5, 7)]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(items)], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(k, int(t in good), 0) for k, t in enumerate(texts) if t], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, items


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)


def test_stages_and_whole(spark, folder):
    at, items = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "ngram_join", "decontamination", "packing"]

    scored = {r.doc_id: r.predicted for r in quality.score(docs, spark.read.parquet(f"{at}/labels.parquet")).collect()}
    kept = pairs(stages["quality"](spark, docs, at))
    want = sorted((p for p in pairs(docs) if scored[p[0]]), key=repr)
    assert kept == want and 20 < len(want) < len(pairs(docs))

    for name, plain in (("line_dedup", plain_lines), ("ngram_join", plain_near), ("decontamination", lambda d: plain_clean(d, items))):  # each on all documents
        got = stages[name](spark, docs, at)
        assert got.columns == docs.columns and pairs(got) == sorted(plain(pairs(docs)), key=repr), name
    relined = stages["line_dedup"](spark, docs, at).where("text is not null")
    assert relined.where(F.col("n_chars") != F.length("text")).isEmpty()

    left = plain_clean(plain_near(plain_lines(want)), items)
    assert len(left) < len(plain_near(plain_lines(want))) < len(want)
    whole = corpus_pipeline.run(spark, at).collect()
    assert sorted((repr(r.doc_id), r.n_tokens) for r in whole) == sorted((repr(i), len(words(t)) + 1) for i, t in left)
    edges = packing.best_edges(*map(__import__("numpy").array, zip(*sorted(Counter(len(words(t)) + 1 for _, t in left).items()), strict=True)), 8)
    assert {r.bucket_edge for r in whole} == set(edges) and all(r.bucket_edge == min(e for e in edges if e >= r.n_tokens) for r in whole)


def test_empty_tables(spark, folder, tmp_path):
    at, _ = folder
    empty = str(tmp_path)
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{at}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
    docs = spark.read.parquet(f"{at}/documents.parquet")
    assert pairs(dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, empty)) == pairs(docs)
    assert dict(corpus_pipeline.STAGES)["quality"](spark, docs, empty).count() == docs.count()  # nothing was learned: a score of one half
