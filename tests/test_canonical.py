"""Canonical JSON against a plain version; what a repack keeps."""

import json
import random

from revloom.functions import canonical
from revloom.operators import objects


def free(rng, depth=0):
    kind = rng.choice(["s", "i", "b", "n"] + ["o", "a"] * (3 if depth < 4 else 0))
    if kind == "o":
        return {rng.choice(["a", "B", "é", 'q"x', "z\\y", "", "k1", "k10", "k2"]): free(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    if kind == "a":
        return [free(rng, depth + 1) for _ in range(rng.randint(0, 12))]
    return {"s": rng.choice(["", "text", 'a "b" \\ c', "日本\n", "{}"]), "i": rng.randint(-(10**12), 10**12), "b": rng.random() < 0.5, "n": None}[kind]


def test_canonical(spark):
    rng = random.Random(2)
    values = [free(rng) for _ in range(150)]
    texts = [json.dumps(v, indent=rng.choice([None, 2]), ensure_ascii=False) for v in values]
    rows = [(k, t) for k, t in enumerate(texts)] + [(900, None), (901, "{broken"), (902, "[]"), (903, ' "only" ')]
    got = dict(tuple(r) for r in canonical.canonical(spark.createDataFrame(rows, "id long, json string")).collect())

    def plain(v):
        if isinstance(v, dict):
            return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + plain(v[k]) for k in sorted(v, key=str.encode)) + "}"
        return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, list) else json.dumps(v, ensure_ascii=False)

    assert got == {k: plain(v) for k, v in enumerate(values)} | {900: None, 901: None, 902: "[]", 903: '"only"'}
    assert canonical.canonical(spark.createDataFrame([], "id long, json string")).count() == 0


def test_repack_report(spark):
    things = [("a", "full", 10), ("b", "delta", 2), ("c", "delta", 3), ("d", "delta", 4), ("m", "manifest", 1), ("e", "delta", 5), ("c1", "chunk", 100), ("c2", "chunk", 200), ("m2", "manifest", 1), ("c3", "chunk", 300), ("t", "full", 7)]
    report = objects.repack_report(
        spark.createDataFrame(things, "id string, form string, bytes long"), spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("e", "m")], "id string, base string"),
        spark.createDataFrame([("m", "c1"), ("m", "c2"), ("m2", "c2"), ("m2", "c3")], "src string, dst string"), spark.createDataFrame([("t",)], "node string"), spark.createDataFrame([("t", "c"), ("t", "e")], "src string, dst string"),
    )
    assert {tuple(r) for r in report.collect()} == {("full", 2, 17, 0, 0), ("delta", 3, 10, 1, 4), ("manifest", 1, 1, 1, 1), ("chunk", 2, 300, 1, 300)}
