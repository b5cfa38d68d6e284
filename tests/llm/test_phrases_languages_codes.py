"""Phrase mining, language identification and vector codes against plain versions, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from revloom.llm import language_id, phrases, vector_codes

SCHEMA = "doc_id long, text string, lang string, source string, word string, n long, rank long, pair long, hash long, size int, prefix string, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "w", 1, 1, 1, 1, 1, "p", 0.5) for i, t, lang in rows], SCHEMA)


def plain_phrases(rows, least, longest, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().lower()):
            w = re.findall(rb"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, c in f.items():
        frequent = {p: a for p, a in c.items() if a >= least}
        inside = defaultdict(int)
        for p, a in frequent.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside[p[i:j]], a)
        found = []
        for p, a in frequent.items():
            if len(p) > 1 and inside[p] < a:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, b" ".join(p), c[p[:k]], c[p[k:]]))
        out |= {(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])}
    return out


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(12)] + ["Été", "naïve", "x-y", "it's"]
    line = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t ", ", ", ".\n", "! "]) for _ in range(n))
    rows = [(k, line(rng.randint(0, 60)), rng.choice(["en", "de", None])) for k in range(80)]
    rows += [(200 + k, f"{line(5)} once upon a time there was {line(3)}", "en") for k in range(9)] + [(300 + k, "hot pair " + line(1), "en") for k in range(60)]
    return [*rows, (90, None, "en"), (91, "", "de"), (92, " .,; \n", None), (0, rows[0][1], "en"), (None, "w1 w2 w3 w1 w2 w3", "und"), (93, "w1 w2 " * 40_000, "fr"), (94, "x" * 9000 + " y", "fr")]


@pytest.mark.parametrize("most, share, group", [(4_000_000, 2000, 1_000_000), (0, 2000, 1_000_000), (4_000_000, 2000, 20), (0, 2000, 5)])
def test_phrases(spark, talk, most, share, group, monkeypatch):
    monkeypatch.setattr(phrases, "FEW", 5)
    if not most:  # hash codes; the share of pairs that may be hot isn't bounded by a table then
        monkeypatch.setattr(phrases, "MOST", 0)
    got = phrases.mine(frame(spark, talk).repartition(5), least=6, longest=5, top=40, most=most or 1, share=share, group=group).collect()
    assert {tuple(r) for r in got} == plain_phrases(talk, 6, 5, 40) and len(got) == len({tuple(r) for r in got})


def test_phrases_of_two_words(spark, talk):
    assert {tuple(r) for r in phrases.mine(frame(spark, talk), least=4, longest=2, top=10).collect()} == plain_phrases(talk, 4, 2, 10)


def test_no_phrases(spark):
    assert phrases.mine(frame(spark, [])).count() == 0
    assert phrases.mine(frame(spark, [(1, None, None), (2, "a b", "en")])).count() == 0


def test_products_beyond_64_bits(spark):
    rows = spark.createDataFrame([(9_000_000_000_000_000, 9_100_000_000_000_000, 9_200_000_000_000_000, 90_000_000_000_000_000)], "a long, l long, r long, n long")
    got = rows.selectExpr("cast(1000 as decimal(4, 0)) * cast(a as decimal(19, 0)) * cast(n as decimal(19, 0)) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))").first()[0]
    assert got == 1000 * 9_000_000_000_000_000 * 90_000_000_000_000_000 // (9_100_000_000_000_000 * 9_200_000_000_000_000)


def plain_grams(text):
    c = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        p = f"_{w}_"
        c.update(p[i : i + n] for n in (1, 2, 3) for i in range(len(p) - n + 1) if p[i : i + n] != "_")
    return c


def ranks(c):
    return {g: k for k, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:300])}


def plain_languages(rows):
    by = defaultdict(Counter)
    for i, text, lang in rows:
        if lang is not None and text is not None and (i is None or zlib.crc32(str(i).encode()) % 4 != 2):
            by[lang] += plain_grams(text)
    known = {lang: ranks(c) for lang, c in by.items() if c}
    out = Counter()
    for i, text, _ in rows:
        own = ranks(plain_grams(text or ""))
        held = i is not None and zlib.crc32(str(i).encode()) % 4 == 2
        if not own or not known:
            out[i, held, "und", 0.0] += 1
            continue
        distance, lang = min((sum(abs(k - p[g]) if g in p else 300 for g, k in own.items()), lang.encode()) for lang, p in known.items())
        out[i, held, lang.decode(), 1.0 - distance / (300 * len(own))] += 1
    return out


def test_languages(spark, monkeypatch):
    rng = random.Random(9)
    words = {"en": ["the", "thing", "with", "Ships"], "de": ["über", "schön", "straße", "ich"], "el": ["λόγος", "ΣΟΦΟΣ", "και"], "ja": ["日本語", "言葉", "本"]}
    rows = [(k, " ".join(rng.choices(words[lang], k=rng.randint(1, 40))) + rng.choice(["", ". 12_3", "\n-"]), lang) for k in range(120) for lang in [rng.choice(list(words))]]
    rows += [(900, None, "en"), (901, "", "de"), (902, "12 _ .", "ja"), (903, "the", None), (None, "schön", "de"), (0, rows[0][1], rows[0][2]), (904, "the thing " * 60_000, "en"), (905, "a" * 5000, "en")]
    docs = frame(spark, rows).repartition(4)

    def got():
        from pyspark.sql import functions as F

        found = language_id.identify(docs, language_id.profiles(docs.where(language_id.learned(F.col("doc_id")))))
        return Counter(tuple(r) for r in found.select("doc_id", ~language_id.learned(F.col("doc_id")), "lang_pred", "score").collect())

    assert got() == plain_languages(rows)
    monkeypatch.setattr(language_id, "LANGUAGES", 0)
    with pytest.raises(ValueError):
        language_id.profiles(docs)


def test_languages_of_nothing(spark):
    assert language_id.identify(frame(spark, []), {}).count() == 0
    assert {tuple(r) for r in language_id.identify(frame(spark, [(1, "text", "en"), (2, None, None)]), {}).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}


def test_grams_in_parts(monkeypatch):
    text = ("ab cd-ef " * 50 + "日本 ").encode()
    whole = [x.tolist() for x in language_id.grams([text, None, text], [0, 1, 2], 3)]
    monkeypatch.setattr(language_id, "PART", 17)
    assert [x.tolist() for x in language_id.grams([text, None, text], [0, 1, 2], 3)] == whole


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, label, v) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(-(-max(len(v) for _, _, v in kept) // parts), 1) * parts
    size = width // parts
    ints = [[math.floor(256 * np.float64(x)) if abs(x) < 1e9 else int(x) * 256 for x in v] + [0] * (width - len(v)) for _, _, v in kept]
    cut = lambda x, p: x[p * size : (p + 1) * size]
    first = {}
    for (i, _, v), x in zip(kept, ints, strict=True):
        if i is not None and (i not in first or v < first[i][0]):
            first[i] = (v, x)
    start = [first[i][1] for i in sorted(first)[:entries]]
    books = [[cut(x, p) for x in start] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda a, book: min((distance(a, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = defaultdict(list)
            for x in ints:
                own[near(cut(x, p), book)[1]].append(cut(x, p))
            for k, xs in own.items():
                book[k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    said = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by = [], Counter()
    for (i, label, _), x in zip(kept, ints, strict=True):
        each = [near(cut(x, p), books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in each), sum(d for d, _ in each)))
        by[label] += out[-1][3]
    top = (1 << 63) - 1
    return Counter((i, code, min(e, top), min(by[label], top), said) for i, label, code, e in out)


KIND = "vec_id long, label int, embedding array<float>, part int, code string, own string, v string, n long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, label, v, 1, "c", "o", "v", 1) for i, label, v in rows], KIND)


@pytest.mark.parametrize("case", ["usual", "ties", "few", "large"])
def test_codes(spark, case):
    rng = np.random.default_rng(4)
    many, width = (150, 32) if case != "few" else (9, 32)
    x = rng.normal(0, 0.2, (many, width)).astype(np.float32)
    if case == "ties":
        x = np.round(x * 8) / 64
    if case == "large":
        x[7, 3], x[100, 5], x[3, 1] = 3e38, -2e30, 1e7
    rows = [(int(k), int(k % 3) if k % 5 else None, [float(y) for y in v]) for k, v in enumerate(x)]
    rows += [(500, 1, None), (501, 1, [float("nan")] * width), (502, 2, [None] * width), (503, 2, [float("inf")] * width), (2, 1, rows[3][2]), (None, 1, rows[4][2]), (*rows[5],), (504, None, [0.5] * 7), (505, 0, [])]
    got = vector_codes.compress(vectors(spark, rows).repartition(3)).collect()
    assert Counter(tuple(r) for r in got) == plain_codes(rows)


def test_codes_of_nothing(spark):
    assert vector_codes.compress(vectors(spark, [])).count() == 0
    assert vector_codes.compress(vectors(spark, [(1, 1, None)])).count() == 0
    assert [r.code for r in vector_codes.compress(vectors(spark, [(None, 1, [1.0])])).collect()] == ["00" * 16]


@pytest.mark.parametrize("seed", range(4))
def test_nearest(seed):
    """The tree finds what a scan of all entries finds, also among equal and equally near entries."""
    rng = np.random.default_rng(seed)
    entries = rng.integers(-3 if seed % 2 else -90, 4 if seed % 2 else 90, (64, 4))
    q = rng.integers(-4 if seed % 2 else -99, 5 if seed % 2 else 99, (3000, 4))
    d = ((q[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    index, best = vector_codes.Tree(entries).nearest(q)
    assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
