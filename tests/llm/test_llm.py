"""Each operator against a plain version, and on nulls, empty texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from revloom.llm import bloom, common, components, decontamination, gif_media, hmm, html_extract, license_scan, line_dedup, ngram_join, packing, quality, rans_tokens

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th int, keys string, node string, score string"
VOCABULARY = [f"w{k}" for k in range(400)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "k", "n", "x") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choices(VOCABULARY, k=n))
    base = [prose(rng.randint(1, 120)) for _ in range(40)]
    near = [" ".join(w if rng.random() > 0.02 else "changed" for w in base[k].split()) for k in range(0, 40, 3)]
    shared = prose(60)
    long_line = "a common line of text"
    out = [*base, *near, *base[:6], *(prose(20) + "\n" + shared + "\n" + prose(30) for _ in range(8)), *(f"{long_line}\n{prose(8)}\n {long_line.upper()} " for _ in range(4))]
    out += ["", None, "   \n\t", "one", "one two", "ONE two", "ünï çödé ünï çödé ünï çödé", prose(9000), "under the MIT license", "Apache  License, version 2 CC-BY-NC 4.0 cc by nc"]
    return list(enumerate(out)) + [(0, out[0]), (None, out[1]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts).repartition(5).cache()


def shingles(text):
    w = WORD.findall((text or "").encode().lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_packing(spark, docs, texts):
    got = packing.pack(docs, buckets=3, budget=400).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in texts)
    assert sorted(r.n_tokens for r in got) == sorted(len(WORD.findall((t or "").encode())) + 1 for _, t in texts)
    for key, group in itertools.groupby(sorted(got, key=lambda r: (r.bucket, r.batch_id)), key=lambda r: (r.bucket, r.batch_id)):
        g = list(group)
        assert len(g) == 1 or len(g) * g[0].bucket_edge <= 400, key
    assert packing.pack(frame(spark, [])).count() == 0


@pytest.mark.parametrize("buckets", [1, 2, 3, 9])
def test_best_edges(buckets):
    """The least padding of all ways to cut the lengths, tried one by one."""
    rng = random.Random(buckets)
    for _ in range(40):
        lengths = np.array(sorted(rng.sample(range(1, 60), rng.randint(1, 8))))
        counts = np.array([rng.randint(1, 9) for _ in lengths])
        pad = lambda edges: sum(int(c) * (min(e for e in edges if e >= n) - int(n)) for n, c in zip(lengths, counts, strict=True))  # noqa: E731,B023
        ways = [(*w, int(lengths[-1])) for k in range(min(buckets, len(lengths))) for w in itertools.combinations(lengths[:-1].tolist(), k)]
        got = packing.best_edges(lengths, counts, buckets)
        assert len(got) <= buckets and got == sorted(set(got)) and pad(got) == min(map(pad, ways))
    assert packing.best_edges(np.zeros(0, int), np.zeros(0, int), buckets) == []


def test_packing_plainly(spark, docs, texts):
    """Batches and padding against a plain version with one shard: in each bucket documents by doc_id and length, as many to a batch as its edge allows."""
    got = sorted(((r.n_tokens, r.bucket, r.bucket_edge, r.batch_id, r.padding) for r in packing.pack(docs, 3, 400).collect()))
    rows = sorted(((i is not None, i or 0, len(WORD.findall((t or "").encode())) + 1) for i, t in texts))
    hist = Counter(n for *_, n in rows)
    edges = packing.best_edges(np.array(sorted(hist)), np.array([hist[k] for k in sorted(hist)]), 3)
    want, seen = [], Counter()
    for *_, n in rows:
        k = next(i for i, e in enumerate(edges) if n <= e)
        want.append((n, k, edges[k], seen[k] // max(1, 400 // edges[k]), edges[k] - n))
        seen[k] += 1
    assert got == sorted(want)
    many = packing.pack(docs, 3, 400, rows_per_shard=7).collect()
    assert sorted((r.n_tokens, r.bucket, r.padding) for r in many) == sorted((n, b, p) for n, b, _, _, p in want)
    full = Counter((r.bucket, r.batch_id) for r in many)
    assert full.keys() == Counter((b, k) for _, b, _, k, _ in want).keys() and all(full[b, k] == c for (b, k), c in Counter((b, k) for _, b, _, k, _ in want).items())


def lines_plainly(texts):
    held = {}
    key = lambda x: x.strip(b" \t\n\x0b\x0c\r").lower()
    for i, t in texts:
        if i is not None:
            for x in (t or "").encode().split(b"\n"):
                if len(key(x).decode()) >= 10:
                    held.setdefault(key(x), set()).add(i)
    out = []
    for i, t in texts:
        lines = (t or "").encode().split(b"\n")
        kept = [x for x in lines if i is None or len(held.get(key(x), ())) < 2 or min(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup(spark, docs, texts):
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.dedup_lines(docs).collect()), key=str)
    assert got == lines_plainly(texts) and any(r[2] for r in got)
    again = line_dedup.rewrite(docs)
    rows = again.collect()
    assert again.columns == docs.columns and sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in rows) == sorted(r[3] for r in got)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0
    odd = docs.withColumnsRenamed({"keys": "lost", "th": "__th", "node": "__doc_id", "score": "__keys"})
    assert line_dedup.rewrite(odd).columns == odd.columns and sorted(map(str, (r.text for r in line_dedup.rewrite(odd).collect()))) == sorted(map(str, (r.text for r in rows)))


def test_salted_join(spark):
    """A key with most of the rows is dealt over many tasks; the rows are those of a plain join."""
    rows = spark.range(6000).selectExpr("CASE WHEN id % 3 < 2 THEN 7 WHEN id = 2 THEN NULL ELSE id END AS k", "id AS v")
    info = spark.createDataFrame([(7, 1), (8, 2), (9, 3), (7, 4)], "k long, x int")
    for how in ("inner", "left"):
        assert sorted(map(str, common.salted_join(rows, info, ["k"], how).collect())) == sorted(map(str, rows.join(info, "k", how).collect()))
    assert common.salted_join(rows, info, ["k"]).where("k = 7").groupBy(F.spark_partition_id()).count().count() > 1


def components_plainly(texts):
    sets, up = [(i, shingles(t)) for i, t in texts if i is not None], {}
    root = lambda x: x if up.get(x, x) == x else root(up[x])
    for (a, x), (b, y) in itertools.combinations(enumerate(s for _, s in sets), 2):
        both = len(x & y)
        if x and y and 100 * both >= 75 * (len(x) + len(y) - both):
            p, q = root(a), root(b)
            if p != q:
                up[max(p, q)] = min(p, q)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, len(s), least[root(k)]) for k, (i, s) in enumerate(sets))


def test_ngram_pairs_meet_once(spark):
    """In lists with many pairs, two nodes meet in the first that they share (they met in each)."""
    cols = "list long, heavy boolean, node long, n long, g int, h int, level int, pos int, lo int, hi int, part long, common long, cost long"
    row = lambda k, node, cost: (k, False, node, 100, 9, 9, 1, int(k), 75, 133, 7 if node else 0, 7, cost)
    join = ngram_join.Join.__new__(ngram_join.Join)
    for cost, each in ((10_000, 1), (10, 3)):
        marked = spark.createDataFrame([row(k, node, cost) for k in (1, 2, 3) for node in range(70)], cols)
        assert sorted((r.a, r.b, r.n) for r in join.meeting(join.dealt_once(marked)).collect()) == sorted([(0, b, 200) for b in range(1, 70)] * each)
    some = join.meeting(join.dealt_once(spark.createDataFrame([row(1, node, 10_000) for node in range(70)], cols)), ngram_join.EARLY).collect()
    assert 0 < len(some) < 35 and {r.a for r in some} == {0}


def test_ngram_join(spark, docs, texts):
    got = ngram_join.join(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == components_plainly(texts)
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]
    assert ngram_join.join(frame(spark, [])).count() == 0


def test_ngram_lists_of_the_same_sets_are_one(spark):
    """Two near copies share dozens of keys, of which one list is kept (there was one for each); what a join wrote is gone when it ends, but for the two tables of its result."""
    words = [f"w{i}" for i in range(400)]
    join = ngram_join.Join(frame(spark, [(1, " ".join(words)), (2, " ".join([*words[:-1], "tail"])), (3, "else " * 9)]))
    join.lists()
    assert sorted((r.n, r.lo, r.hi) for r in join.short.collect()) == [(396, 297, 528)] * 2 and join.short.first().times > 20
    folder = common.shared_dir(spark).removeprefix("file://") + "/revloom"
    before = set(os.listdir(folder))
    got = ngram_join.join(frame(spark, [(1, " ".join(words)), (2, " ".join([*words[:-1], "tail"])), (3, "else " * 9)]))
    assert sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before) == ["found", "rows"]
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(1, 1), (2, 1), (3, 3)]


def test_filter_of_hashes_grows_with_the_hashes():
    """What tasks send for a filter follows their hashes, not their number times the filter's size; every hash that comes twice is in it, few others."""
    rng = np.random.default_rng(5)
    h = rng.integers(0, 1 << 64, 40_000, dtype=np.uint64)
    parts = [np.concatenate([p, h[:500], p[:200]]) for p in np.split(h, 8)]
    of = lambda b: b.column(0).to_numpy()
    rows = [r for p in parts for r in bloom.packed_hashes(of)([pa.record_batch({"h": p})])]
    size = lambda rs: sum(len(x.as_py()) for r in rs for c in (1, 2) for x in r.column(c))
    bits = bloom.bits_for(1 << 26, 8)
    assert size(rows) < 0.5 * size([r for p in parts for r in bloom.fill(bits, of)([pa.record_batch({"h": p})])])
    whole = {r.column(0)[0].as_py(): r.column(2)[0].as_py() for r in bloom.fill_segments(bits)(rows)}
    filled = np.concatenate([np.frombuffer(zlib.decompress(whole[k]), np.uint8) for k in range(bloom.SEGMENTS)])
    twice = np.concatenate([h[:500], *(p[:200] for p in np.split(h, 8))])
    assert bloom.has_all(filled, bloom.near_places(twice, bits)).all() and bloom.has_all(filled, bloom.near_places(h, bits)).sum() < len(np.unique(twice)) + 50


def test_small_sets_by_subsets(spark):
    rng = random.Random(8)
    sets = [rng.sample(VOCABULARY[:40], rng.randint(5, 14)) for _ in range(30)]
    near = [[*s[:-1], "tail"] for s in sets[:15]]
    texts = list(enumerate(" ".join(s) for s in [*sets, *near]))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(frame(spark, texts)).collect()) == components_plainly(texts)


def test_keys_meet():
    """Two sets that link share a key, whatever the boundary."""
    rng = random.Random(2)
    for small in (2, 10, 30, 64):
        for _ in range(60):
            n = rng.randint(3, 60)
            a = set(rng.sample(range(1 << 40), n))
            b = set(rng.sample(sorted(a), max(1, n - rng.randint(0, n // 5)))) | set(rng.sample(range(1 << 40), rng.randint(0, n // 6)))
            both = len(a & b)
            if 100 * both < 75 * len(a | b) or a == b:
                continue
            keys = []
            for s, other in ((a, len(b)), (b, len(a))):
                first = np.array(sorted(s)[: len(s) - ngram_join.need(len(s)) + 2], np.uint64)
                got = ngram_join.keys_of(first, np.array([len(first)]), np.array([len(s)]), small)
                keys.append(set(got["key"][(got["lo"] <= other) & (other <= got["hi"])].tolist()))
            assert len(b) < 3 or keys[0] & keys[1]


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)]
    up = {}
    root = lambda x: x if up.get(x, x) == x else root(up[x])
    for a, b in pairs:
        p, q = root(a), root(b)
        if p != q:
            up[max(p, q)] = min(p, q)
    for few in (0, 100):
        got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a int, b int"), few).collect()}
        assert all(got.get(x, x) == root(x) for x in range(61))


def test_decontamination(spark, docs, texts):
    pool = [t for _, t in texts if t and len(t.split()) > 30]
    items = [(k, " ".join(t.split()[5:30])) for k, t in enumerate(pool[:12])] + [(50, "one two"), (51, ""), (52, None), (None, pool[0]), (53, pool[0] + " and more and more")]
    got = decontamination.contaminated(docs, spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id int")).collect()
    held = {}
    for i, t in texts:
        if i is not None:
            held.setdefault(i, set()).update(shingles(t))
    want = sorted((i, k, len(s & shingles(t)), len(shingles(t))) for i, s in held.items() for k, t in items if k is not None and shingles(t) and 4 * len(s & shingles(t)) >= 3 * len(shingles(t)))
    assert sorted((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got) == want and len(want) > 12
    assert decontamination.contaminated(frame(spark, []), frame(spark, []).withColumnRenamed("doc_id", "item_id")).count() == 0


def test_license_scan(spark, docs, texts):
    more = [(900, "This is (under THE mit-license). under the mit license; apache license version 2 x CC_BY_NC"), (901, "released under the GNU General Public License, version 3. SPDX-License-Identifier: MIT"), (902, "unterwegs mit der Bahn")]
    every = [*texts, *more]
    got = license_scan.scan(frame(spark, every)).collect()
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = Counter()
    for i, t in every:
        w = word.findall((t or "").translate(str.maketrans(license_scan.UPPER, license_scan.LOWER)))
        at = [(k, label) for phrase, label in license_scan.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        want[i, len(w), len(at), min(at, default=[None])[0], max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert set(by[900].labels.split(",")) >= {"mit", "apache-2", "cc-by-nc"} and by[901].labels == "gpl-3,mit" and by[902].labels == "" and by[902].score == 0
    assert all(0 <= r.score <= 1 for r in got) and len(license_scan.rules()) > 300


def test_license_containment(spark):
    rows = frame(spark, [(1, "licensed under the gnu general public license version 2 or any later version")])
    assert license_scan.scan(rows).collect()[0].labels == "gpl-2-or-later"


def samples(rx: str) -> list[str]:
    """Texts that an expression takes: for each alternative, without what is optional and with it."""

    def ways(part) -> list[str]:
        out = [""]
        for kind, x in part:
            match str(kind):
                case "LITERAL":
                    got = [chr(x)]
                case "IN":
                    got = [chr(x[0][1] if str(x[0][0]) == "LITERAL" else x[0][1][0])]
                case "BRANCH":
                    got = [w for b in x[1] for w in ways(b)]
                case "SUBPATTERN":
                    got = ways(x[3])
                case "MAX_REPEAT":
                    got = ["", *ways(x[2])[-1:]]
                case "ASSERT_NOT":
                    got = [""]
            out = [a + b for a in out[:40] for b in got] if len(got) < 9 or len(out) < 9 else [a + b for a in out[:2] for b in got]
        return out

    return [w for w in ways(re._parser.parse(rx)) if re.fullmatch(rx, w)]


def test_license_rules_alone(spark):
    """A text that holds nothing but a rule's own match passes all that stands before the rule."""
    every = license_scan.rules()
    for _, _, keywords, rx, _, _ in every:
        got = samples(rx)
        assert got and all(any(k in x for k in keywords) for x in got) and all(re.search(license_scan.GATE, x) for x in got), rx
        assert all(len(k) > 1 for k in keywords)
    texts = [(r[0], min(samples(r[3]), key=len).upper().replace(" ", "-")) for r in every]
    found = license_scan.detections(frame(spark, texts).select("doc_id", "th", "text")).where("doc_id = rank").select("rank").distinct().collect()
    assert sorted(r[0] for r in found) == [r[0] for r in every]


def test_license_identifiers_alone(spark):
    names = {"GPL-2.0": "gpl-2", "MPL-2.0": "mpl-2", "LGPL-2.1": "lgpl-2.1", "AGPL-3.0": "agpl-3", "EPL-2.0": "epl-2", "EUPL-1.2": "eupl-1.2", "CDDL-1.0": "cddl-1", "BSL-1.0": "boost-1", "OFL-1.1": "ofl-1.1", "PSF-2.0": "python-2", "MS-PL": "ms-pl", "ODbL-1.0": "odbl-1"}
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(frame(spark, [(k, f"SPDX-License-Identifier: {x}") for k, x in enumerate(names)])).collect()}
    assert got == {k: (x, 0.99) for k, x in enumerate(names.values())}


def test_license_statements(spark):
    gpl = "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
    said = {
        "All rights reserved.": "all-rights-reserved", "It was released into the public domain.": "public-domain", "Proprietary and confidential": "proprietary", "see the GNU General Public License": "gpl", "GNU Lesser General Public License": "lgpl",
        "GNU General Public License version 3": "gpl-3", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit", bsd: "bsd", gpl: "gpl-2-or-later", "This is free and unencumbered software released into the public domain.": "unlicense",
        "http://www.apache.org/licenses/LICENSE-2.0": "apache-2", "some rights in the domain": "", "the gnu reserved all": "",
    }
    got = {r.doc_id: (r.labels, r.score > 0) for r in license_scan.scan(frame(spark, list(enumerate(said)))).collect()}
    assert got == {k: (x, x != "") for k, x in enumerate(said.values())}


def test_html():
    head = "<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=x>Menu</a></nav><div class='ad'>Buy, now. Buy!</div>"
    body = "<article><h1>Big &amp; news</h1><p>One,  two.\n three&nbsp;four. <b>Five, six</b>.<br>Seven.<p>Eight, nine; ten. Eleven, twelve.</p><script>var a='</p>'</script><div id=comments><p>Nice, post. I agree, fully.</p></div></article>"
    assert html_extract.main_text(head + body + "<aside>More</aside><footer>&copy; Me</footer></body></html>") == "Big & news\n\nOne, two. three four. Five, six. Seven.\n\nEight, nine; ten. Eleven, twelve."
    for page in (None, "", "<html></html>", "<", "<p", "</p></p>", "<!-- x", "<script>never ends", "a < b"):
        assert isinstance(html_extract.main_text(page), str)


def test_html_parts():
    """Content outside of the largest part stays; what no path of content holds goes, inside the container too."""
    say = lambda name, n: " ".join(f"{name} {k}, and so on, it says." for k in range(n))
    p = lambda name, n: f"<p>{say(name, n)}</p>"
    long, short = say("long", 40), say("short", 7)
    assert html_extract.main_text(f"<body><main><article>{p('long', 40)}</article><section>{p('short', 7)}</section></main></body>") == f"{long}\n\n{short}"
    assert html_extract.main_text(f"<body><div><div>{p('short', 7)}</div><div>{p('long', 40)}</div></div></body>") == f"{short}\n\n{long}"
    assert html_extract.main_text(f"<body><article>{p('long', 40)}</article><article>{p('short', 7)}</article></body>") == f"{long}\n\n{short}"
    links = "<ul>" + "".join(f"<li><a href=x>Link {k}</a></li>" for k in range(30)) + "</ul>"
    page = f"<body><article><h1>Head</h1>{p('long', 20)}<h2>Part</h2><p>One <b>bold</b> word, and more, as said.</p>{links}</article></body>"
    assert html_extract.main_text(page) == f"Head\n\n{say('long', 20)}\n\nPart\n\nOne bold word, and more, as said."


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<body><p>Hello, world. It is, here.</p>"), (None, None, None), (1, "u", "")], "page_id long, url string, html string")
    assert sorted(((r.page_id, r.text, r.n_chars) for r in html_extract.extract(pages).collect()), key=str) == sorted([(1, "Hello, world. It is, here.", 26), (None, "", 0), (1, "", 0)], key=str)


def test_gif_round_trip():
    rng = random.Random(1)
    for n in (1, 2, 7, 40):
        for data in (rng.randbytes(576 * n), b"ab" * 288 * n, b"\xff" * 576 * n):
            assert b"".join(f.samples.tobytes() for f in gif_media.decode(gif_media.encode(data))) == data
    for data in (rng.randbytes(20_000), b"ab" * 30_000, b"x"):
        assert gif_media.lzw_decode(gif_media.lzw_encode(data), 8, len(data)).tobytes() == data


def test_gif_frames():
    """Local palette, transparency, disposal and interlace, by hand: 2 x 8 pixels."""
    block = lambda s: b"\x08" + gif_media.sub_blocks(gif_media.lzw_encode(bytes(s)))
    image = lambda flags, s, w=2, h=8: b"\x2c\0\0\0\0" + w.to_bytes(2, "little") + h.to_bytes(2, "little") + bytes([flags]) + block(s)
    control = lambda disposal, clear: b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None), 5, 0, clear or 0, 0])
    stored = [r for row in gif_media.interlaced(8) for r in (row, row)]
    data = b"GIF89a\x02\0\x08\0\xf7\0\0" + gif_media.GREY + control(1, None) + image(0x40, stored) + control(2, 9) + image(0, [9] * 15 + [200]) + control(0, None) + image(0, [7], 1, 1) + b"\x3b"
    first, second, third = gif_media.decode(data)
    assert first.pixels[:, 0, 0].tolist() == list(range(8)) and first.delay_ms == 50
    assert second.pixels[:, 0, 0].tolist() == list(range(8)) and second.pixels[7, 1, 0] == 200
    assert third.pixels[0, 0].tolist() == [7, 7, 7, 255] and third.pixels[..., 3].sum() == 255
    assert list(gif_media.decode(b"junk")) == [] and len(list(gif_media.decode(data[:1200]))) <= 3


def test_gif_rows(spark, docs, texts):
    stored = gif_media.store(docs)
    got = gif_media.features(docs).collect()
    pay = lambda t: t + b"\xff" * (-len(t) % 576 if t else 576)
    want = sorted(((i, len(t := (x or "").encode()), len(pay(t)), hashlib.sha256(pay(t)).hexdigest(), zlib.crc32(pay(t)[-32:])) for i, x in texts), key=str)
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=str) == want
    f = gif_media.frames(stored.withColumnRenamed("doc_id", "id")).collect()
    assert len(f) >= len(texts) and all(sum(r.red) + r.transparent == r.width * r.height for r in f)
    media = {r.doc_id: r.media for r in stored.collect()}
    for r in got:
        shown = [x.pixels for x in gif_media.decode(media[r.doc_id])] if r.doc_id is not None else None
        if shown is not None and r.n_bytes == len((dict(texts).get(r.doc_id) or "").encode()):
            red = [sum(int(((p[..., 3] > 0) & (p[..., 0] // 32 == k)).sum()) for p in shown) for k in range(8)]
            assert r.feature == f"{len(shown)}:{100 * len(shown)}:{','.join(map(str, red))}"
            assert (r.media_bytes, r.media_sha256) == (len(media[r.doc_id]), hashlib.sha256(media[r.doc_id]).hexdigest())
    assert gif_media.features(frame(spark, [])).count() == 0


def test_hmm(docs, texts):
    got = hmm.score(docs).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    toks = [(i, [*WORD.findall((t or "").encode().lower()), None]) for i, t in texts]
    c = Counter(w for i, ws in toks if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, out(i), len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 5)) for i, ws in toks), key=str)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got), key=str) == want
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_forward_is_exact():
    rng = np.random.default_rng(2)
    pi, move, emit = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T
    obs = rng.integers(0, 5, 9)
    starts, lengths = np.array([0, 4, 5]), np.array([4, 1, 4])
    got = hmm.forward(obs, starts, lengths, pi, move, emit, False)
    for s, n, x in zip(starts, lengths, got, strict=True):
        p = sum(pi[z[0]] * emit[obs[s], z[0]] * math.prod(move[z[k - 1], z[k]] * emit[obs[s + k], z[k]] for k in range(1, n)) for z in itertools.product(range(3), repeat=int(n)))
        assert abs(math.log10(p) - x) < 1e-9


def test_expected_counts():
    """Baum-Welch's counts against sums over all ways through the states, for sequences of different lengths."""
    rng = np.random.default_rng(5)
    k, pi, move, emit = 2, rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), 2), np.zeros((hmm.CLASSES, 2))
    emit[:4] = rng.dirichlet(np.ones(4), 2).T
    obs, starts, lengths = rng.integers(0, 4, 9), np.array([0, 5, 6]), np.array([5, 1, 3])
    first, moves, emissions, whole = np.zeros(k), np.zeros((k, k)), np.zeros((hmm.CLASSES, k)), 0.0
    for s, n in zip(starts, lengths, strict=True):
        ways = [(z, pi[z[0]] * emit[obs[s], z[0]] * math.prod(move[z[i - 1], z[i]] * emit[obs[s + i], z[i]] for i in range(1, n))) for z in itertools.product(range(k), repeat=int(n))]
        p = sum(w for _, w in ways)
        whole += math.log10(p)
        for z, w in ways:
            first[z[0]] += w / p
            for i in range(n):
                emissions[obs[s + i], z[i]] += w / p
                if i:
                    moves[z[i - 1], z[i]] += w / p
    got = hmm.expected(obs, starts, lengths, pi, move, emit)
    for x, y in zip(got, (first, moves, emissions, whole), strict=True):
        assert np.allclose(x, y, atol=1e-5)


def test_hmm_score_plainly(spark):
    """The score end to end: scaled forward over classes with the model fitted by hand on the same texts, times words within classes; likelihood doesn't fall from pass to pass."""
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choices(VOCABULARY[:60], k=rng.randint(0, 30)))) for i in range(80)]
    got = {r.doc_id: r.score for r in hmm.score(frame(spark, texts)).collect()}
    train = [t.encode() for i, t in texts if zlib.crc32(str(i).encode()) % 10]
    by_hash = sorted((r.k, r.doc_id) for r in frame(spark, texts).select("doc_id", F.xxhash64("doc_id", F.lit(3)).alias("k")).collect())
    model, said = hmm.Model.start([dict(texts)[i].encode() for _, i in by_hash if zlib.crc32(str(i).encode()) % 10]), []
    batch = lambda ts: hmm.pa.RecordBatch.from_pydict({"text": hmm.pa.array(ts, hmm.pa.binary())})
    while len(said) < hmm.PASSES and (len(said) < 2 or said[-1] - said[-2] >= hmm.GAIN * abs(said[-2])):
        sums = model.counts([batch(train)])
        said.append(sums[-1])
        model = model.after(sums)
    assert all(b > a - 1 for a, b in itertools.pairwise(said))
    h, cls, _ = hmm.with_ends(train)
    counts, of = Counter(h.tolist()), dict(zip(h.tolist(), cls.tolist(), strict=True))
    n, v = Counter(), Counter()
    for w, c in counts.items():
        n[of[w]] += c
        v[of[w]] += 1
    for i, t in texts:
        h, cls, _ = hmm.with_ends([t.encode()])
        a, want = None, 0.0
        for k, c in enumerate(cls):
            a = model.emit[c].astype(float) * (model.pi if a is None else a @ model.move)
            want += math.log10(a.sum()) + (math.log10((counts[int(h[k])] + 0.1) / (n[c] + 0.1 * (v[c] + 1))) if k + 1 < len(cls) else 0)
            a = a / a.sum()
        assert abs(got[i] - want) < 0.02 + 1e-3 * abs(want), i
    assert hmm.score(frame(spark, [])).count() == 0


def test_quality(spark):
    rng = random.Random(9)
    good = lambda: " ".join(rng.choices(VOCABULARY, k=60)).capitalize() + "."
    bad = lambda: " ".join(w + "$$$" for w in rng.choices(VOCABULARY[:5], k=60))
    texts = [(i, good() if i % 3 else bad()) for i in range(240)] + [(240, ""), (241, None), (None, "x"), (1, "again, a text.")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(240)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(frame(spark, texts), labels, 64).collect()
    held = [r for r in got if r.held_out and r.doc_id < 240 and r.doc_id != 1]
    assert len(got) == len(texts) and held and sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    kept = quality.keep_good(frame(spark, texts), labels)
    assert kept.columns == frame(spark, []).columns and {r.doc_id for r in kept.collect()} >= {i for i in range(240) if i % 3}
    assert {r.score for r in quality.score(frame(spark, texts[:3]), labels.limit(0)).collect()} == {0.5}


def test_isotonic():
    xs, ys = quality.isotonic(np.arange(6.0), np.array([0, 0.5, 0.2, 0.6, 0.4, 1]), np.ones(6))
    assert np.allclose(ys, [0, 0.35, 0.5, 1]) and np.allclose(xs, [0, 1.5, 3.5, 5])


def test_rans_coder():
    rng = np.random.default_rng(4)
    ids = np.concatenate([rng.zipf(1.3, 300_000) % 5000, [65535]]).astype(np.uint16)
    freq = rans_tokens.normalised(np.bincount(ids, minlength=1 << 16))
    assert freq.sum() == 1 << rans_tokens.SCALE
    coder = rans_tokens.Coder(freq)
    for part in (ids, ids[:1], ids[:513], ids[:0]):
        data = coder.encode(part, [len(part)])
        assert (coder.decode(data)[0] == part).all()
    data = coder.encode(ids, [len(ids)])
    n, _, lanes, _, points, words = coder.parse(data)
    assert len(points) > 2 and (coder.part(n, lanes, points[1], points[2][0], words) == ids[points[1][0] * lanes : points[2][0] * lanes]).all()
    broken = bytearray(data)
    broken[-3] ^= 1
    with pytest.raises((ValueError, IndexError)):
        coder.decode(bytes(broken))


def test_rans_rows(docs, texts):
    from tokenizers import Tokenizer

    got = rans_tokens.read(*rans_tokens.write(docs)).collect()
    t = Tokenizer.from_file(rans_tokens.default_tokenizer())
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0))
    ids = {(i, x): np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for i, x in texts}
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(((i, len(ids[i, x]), zlib.crc32(ids[i, x].tobytes())) for i, x in texts), key=str)
    at = 0
    starts = {}
    for i, x in order:
        starts.setdefault(i, at)
        at += len(ids[i, x])
    once = [i for i, k in Counter(i for i, _ in texts).items() if k == 1]
    by = {r.doc_id: r.start for r in got}
    assert all(by[i] == starts[i] for i in once)


@pytest.mark.parametrize("text", ["a²b ½ x", "tab\x1cx", "don't  stop\n\n now ", "<|endoftext|> x", "x_y __ z", "ünï 日本 語", "१२३ Ⅷ", "", " "])
def test_pieces(text):
    from tokenizers import Tokenizer

    p = rans_tokens.pieces(rans_tokens.default_tokenizer())
    t = Tokenizer.from_file(rans_tokens.default_tokenizer())
    assert np.frombuffer(p([text])[0], "<u2").tolist() == t.encode(text, add_special_tokens=False).ids


def test_pieces_of_any_text():
    """The ids of random texts of signs, letters and all kinds of white space are the library's."""
    from tokenizers import Tokenizer

    p, t, rng = rans_tokens.pieces(rans_tokens.default_tokenizer()), Tokenizer.from_file(rans_tokens.default_tokenizer()), random.Random(12)
    for _ in range(3000):
        text = "".join(rng.choices(["a", "Be", " ", " ", "\n", "\t", "\xa0", "'s", "'", "1", "²", "é", ",", "_", "日", "'ll", "\u2003"], k=rng.randint(0, 12)))
        assert np.frombuffer(p([text])[0], "<u2").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_html_paths_plainly():
    """The selection of paths against one written out anew, on random pages with boilerplate under names that mean nothing; without it other text comes out."""
    rng = random.Random(21)
    sentence = lambda n: " ".join(rng.choices(VOCABULARY, k=n)) + ", and so on."
    for _ in range(30):
        links = "".join(f"<a href=x>{w}</a>" for w in rng.choices(VOCABULARY, k=20))
        parts = [f"<p>{sentence(rng.randint(20, 60))}</p>" for _ in range(rng.randint(3, 9))]
        page = f"<body><div class=x1>{links}</div><div class=x2>" + "".join(parts) + f"</div><div class=x3><ul>{''.join(f'<li>{w}' for w in rng.choices(VOCABULARY, k=12))}</ul></div></body>"
        got = html_extract.nodes(page)
        rows = [(path, text.strip()) for _, path, _, text in got.texts if text.strip()]
        order = list(dict.fromkeys(p for p, _ in rows))
        ratio = lambda f: [sum(f(t) for q, t in rows if q == p) / sum(q == p for q, _ in rows) for p in order]  # noqa: E731,B023
        weigh = lambda xs: [sum(math.exp(-((i - k) ** 2) / 2) * xs[k] for k in range(max(0, i - 2), min(len(xs), i + 3))) / sum(math.exp(-((i - k) ** 2) / 2) for k in range(max(0, i - 2), min(len(xs), i + 3))) for i in range(len(xs))]
        each = [sum(q == p for q, _ in rows) for p in order]
        signs = [x + 0.1 / n for x, n in zip(ratio(lambda t: len(re.findall(r"[.,;:!?]", t))), each, strict=True)]
        fused = [math.sqrt(a * b * c * d) for a, b, c, d in zip(ratio(len), signs, weigh(ratio(len)), weigh(signs), strict=True)]
        cut = 0.02 * float(np.std(fused))
        assert html_extract.content_paths(got) == {p for p, x in zip(order, fused, strict=True) if x >= cut}
        assert html_extract.main_text(page) == "\n\n".join(re.sub("</?p>", "", x) for x in parts)


def test_html_hard_pages():
    """Deep, broken and endless pages take time in proportion to their length."""
    import time

    began, n = time.process_time(), 20_000
    assert html_extract.main_text("<div>x" * n).count("x") == n
    for page in ("<a '" * n, "<a '>" * n + "<a '", "<b>" * n + "<p>x" * n, "<div>" * n + "</p>" * n, "<li>" * n, "<" * n, "<!--" * n, "<ul><li>x" * n, '<p title="a>b">Yes, it is.</p>' * n):
        assert isinstance(html_extract.main_text(page), str)
    assert time.process_time() - began < 20
