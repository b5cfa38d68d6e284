"""Language identification by rank-order profiles of character n-grams.

The n-grams (1 to `longest` letters) of a text are those of its words, each word between two marks `_`; a word is a run of letters, lower-cased. A language's profile is the ranks of its `size` most frequent n-grams over
all texts to learn from: every task counts its own, the counts are summed by Spark, and only the profiles reach the driver. A document's profile is made in the same way from its whole text. Its distance to a language
is the sum, over the document's n-grams, of how many ranks each is out of place there, and `size` for one that the profile lacks. The language of the least distance is predicted; score is 1 less the distance over the
greatest that there is (`size` for every n-gram).

Profiles are at most `size` ranks a language. They are sent to all tasks and may have at most LANGUAGES * size ranks together, as many as LANGUAGES full ones; more are an error that says so. `longest` is at most 3.

Defined results: a null text, and one without a letter, is `und` with score 0; so is every text if nothing was learned. A null doc_id isn't held out and is learned from. Rows that repeat a doc_id are scored each. Of equally
frequent n-grams the smaller in byte order ranks first; of equally distant languages the smaller wins. An empty table gives no rows. Texts are taken whole, in parts that end between words. Only doc_id, text and lang are read,
so that other columns may have any names.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, table

LONGEST, SIZE, LANGUAGES = 3, 300, 10_000
PART = 1 << 19
MARK = 0x5F
BETWEEN = re.compile(r"[\W\d_]")


@functools.cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def parts(text: str):
    """The lower-cased text in parts of about PART characters that end between words."""
    text, at = text.lower(), 0
    while len(text) - at > PART and (stop := BETWEEN.search(text, at + PART)):
        yield text[at : stop.end()]
        at = stop.end()
    yield text[at:]


def of_part(texts: list[str], owner: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of lower-cased texts by owner: owner, n-gram (21 bits a code point, shorter ones end with 0), count, in this order."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    point = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[point]
    keep = letter | np.concatenate([[False], letter[:-1]])  # of what stands between words, one mark
    point, letter, owner = np.where(letter, point, MARK)[keep], letter[keep], np.repeat(owner, sizes)[keep]
    if not len(point):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    point, letter, owner = np.concatenate([[MARK], point]), np.concatenate([[False], letter]), np.concatenate([owner[:1], owner])
    alphabet, place = np.unique(point, return_inverse=True)
    base = len(alphabet) + 1
    place = place.astype(np.int64) + 1
    keys, inside = [], np.ones(len(point), bool)
    for n in range(1, longest + 1):
        count = len(point) - n + 1
        if count <= 0:
            break
        if n > 2:
            inside = inside[:count] & letter[n - 2 : n - 2 + count]  # no mark but at the ends
        at = np.flatnonzero(inside[:count] if n > 1 else letter)
        gram = np.zeros(len(at), np.int64)
        for k in range(longest):
            gram = gram * base + (place[at + k] if k < n else 0)
        keys.append((owner[at + (n > 1)], gram))
    owner, gram = (np.concatenate(x) for x in zip(*keys, strict=True))
    span = base**longest
    if (int(owner.max()) + 1) * span < 1 << 62:
        key, count = np.unique(owner * span + gram, return_counts=True)
        owner, gram = key // span, key % span
    else:
        values, gram = np.unique(gram, return_inverse=True)
        key, count = np.unique(owner * len(values) + gram, return_counts=True)
        owner, gram = key // len(values), values[key % len(values)]
    out, alphabet = np.zeros(len(gram), np.int64), np.concatenate([[0], alphabet]).astype(np.int64)
    for k in range(longest):
        out = out << 21 | alphabet[gram // base ** (longest - 1 - k) % base]
    return owner, out, count


def merged(some: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Several results of of_part as one."""
    if len(some) == 1:
        return some[0]
    owner, gram, count = (np.concatenate(x) for x in zip(*some, strict=True))
    order = np.lexsort((gram, owner))
    owner, gram, count = owner[order], gram[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])])) if len(owner) else np.zeros(0, np.int64)
    return owner[first], gram[first], np.add.reduceat(count, first) if len(first) else count


def grams(texts: list[bytes | None], owner: list[int], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of whole texts by owner."""
    some, size, out = [], 0, []
    for text, k in zip(texts, owner, strict=True):
        for part in parts((text or b"").decode("utf-8", "replace")):
            some.append((part, k))
            size += len(part)
            if size > PART:
                out.append(of_part([x for x, _ in some], np.array([k for _, k in some]), longest))
                some, size = [], 0
    if some or not out:
        out.append(of_part([x for x, _ in some], np.array([k for _, k in some], np.int64), longest))
    return merged(out)


def count_grams(longest: int):
    """For mapInArrow: the n-gram counts of a task's languages."""

    def run(batches):
        known: dict[str, int] = {}
        held = []
        for b in (x for whole in batches for x in slices(whole, 1)):
            owner = [known.setdefault(lang, len(known)) for lang in b.column(0).to_pylist()]
            held.append(grams(b.column(1).to_pylist(), owner, longest))
            if sum(len(x[0]) for x in held) > 2_000_000:
                held = [merged(held)]
        if held:
            owner, gram, count = merged(held)
            yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()).take(pa.array(owner)), pa.array(gram), pa.array(count, pa.int64())], names=["lang", "gram", "n"])

    return run


def learned(doc_id):
    """Not held out: crc32(doc_id as text) mod 4 isn't 2; nor is a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(True))


def profiles(docs: DataFrame, longest: int = LONGEST, size: int = SIZE) -> dict[str, np.ndarray]:
    """Each language's n-grams in the order of their ranks."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.col("text").cast("binary").alias("text"))
    counts = rows.mapInArrow(count_grams(longest), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    got = ranked.limit(LANGUAGES * size + 1).collect()  # the bound of what is sent
    if len(got) > LANGUAGES * size:
        raise ValueError(f"the profiles have more than {LANGUAGES * size} n-grams")
    out: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r["lang"].encode(), r["rank"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.int64) for k, v in out.items()}


def nearest(owner: np.ndarray, gram: np.ndarray, count: np.ndarray, n: int, known: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of n owners: the index of the nearest profile, its distance, and the number of n-grams compared (0: none)."""
    order = np.lexsort((gram, -count, owner))
    owner, gram = owner[order], gram[order]
    used = np.bincount(owner, minlength=n)
    rank = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(used)[:-1]]), used)
    top = rank < size
    owner, gram, rank = owner[top], gram[top], rank[top]
    best, least = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    for k, profile in enumerate(known):
        by_value = np.argsort(profile)
        at = np.minimum(np.searchsorted(profile, gram, sorter=by_value), len(profile) - 1)
        there = by_value[at]
        off = np.where(profile[there] == gram, np.abs(rank - there), size)
        distance = np.bincount(owner, off, n).astype(np.int64)
        less = distance < least
        best[less], least[less] = k, distance[less]
    return best, least, np.minimum(used, size)


def identify(docs: DataFrame, known: dict[str, np.ndarray], longest: int = LONGEST, size: int = SIZE) -> DataFrame:
    """One row per document: doc_id, lang_pred, score."""
    names = [*known, "und"]
    sent = docs.sparkSession.sparkContext.broadcast(list(known.values()))

    def run(batches):
        for b in (x for whole in batches for x in slices(whole, 1)):
            n = len(b)
            best, distance, used = nearest(*grams(b.column(1).to_pylist(), list(range(n)), longest), n, sent.value, size)
            seen = (used > 0) & (len(names) > 1)
            score = np.where(seen, 1.0 - np.where(seen, distance, 0) / np.maximum(used * size, 1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([names[k] for k in np.where(seen, best, len(names) - 1)], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, profiles(docs.where(learned(F.col("doc_id")))))
    return found.select("doc_id", (~learned(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


ORACLE = r"""
WITH crc_table AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i::BIGINT] || list_transform(range(8), lambda x: 0::BIGINT), lambda a, b: CASE WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS row, doc_id, lang, text, coalesce(xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 4 = 2, false) AS held_out FROM documents, crc_table),
w AS (SELECT row, w, count(*) AS c FROM (SELECT row, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM d) GROUP BY ALL),
g AS (SELECT row, g, sum(c)::BIGINT AS c FROM (SELECT row, c, substr('_' || w || '_', i, n) AS g FROM (SELECT row, w, c, n, unnest(range(1, length(w) + 4 - n)) AS i FROM w, range(1, 4) r(n))) WHERE g <> '_' GROUP BY ALL),
ranked AS (SELECT row, g, rank, max(rank) OVER (PARTITION BY row) AS used FROM (SELECT row, g, row_number() OVER (PARTITION BY row ORDER BY c DESC, g) AS rank FROM g) WHERE rank <= 300),
profile AS (SELECT * FROM (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(c) DESC, g) AS rank FROM g JOIN d USING (row) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, g) WHERE rank <= 300),
shared AS (SELECT r.row, p.lang, sum(300 - abs(r.rank - p.rank)) AS won FROM ranked r JOIN profile p USING (g) GROUP BY ALL),
far AS (SELECT row, lang, used, used * 300 - coalesce(won, 0) AS distance FROM (SELECT DISTINCT row, used FROM ranked) CROSS JOIN (SELECT DISTINCT lang FROM profile) LEFT JOIN shared USING (row, lang)),
best AS (SELECT row, min(used) AS used, arg_min(lang, (distance, lang)) AS lang_pred, min(distance) AS distance FROM far GROUP BY row)
SELECT doc_id, held_out, coalesce(lang_pred, 'und') AS lang_pred, coalesce(1.0::DOUBLE - distance::DOUBLE / (used * 300)::DOUBLE, 0) AS score FROM d LEFT JOIN best USING (row)
"""
