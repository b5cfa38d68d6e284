"""Phrase collocations by prefix-projected pattern growth.

Three passes over whole texts. The first counts words. The second counts pairs of neighbouring frequent words, which prunes the third: that one projects an occurrence pointer for every place where a frequent
pair begins, together with what can still follow it (at most `longest` words, up to the first pair that isn't frequent). Equal projections of a task are one with a count. Prefixes are dealt into buckets of about BUCKET
pointers, and a task packs its pointers to each bucket into one row. All pointers of a prefix so meet in one task, which grows it to the right, depth first: the pointers of a prefix are a range of sorted rows, the ranges
of its extensions lie inside it, and a range below the threshold isn't entered.

A prefix is a pair. A pair with more than 1 / SHARE of all pointers or with more than GROUP of them is hot: its pointers are dealt out by one word more (and so on while the last pair is hot), and the shorter prefixes
of these come as counts. So a group has at most that many pointers, or one row for each task of the third pass.

Words are numbers to all but the first and the last step: their places in the sorted 64-bit hashes of the frequent words, while these are at most `most`, else the hashes themselves, with a Bloom filter of at most
128 MB to tell the frequent ones. No two words of a language share a hash: this is checked over all words, and another hash is taken where two do. Pairs are told by a sorted table of at most `most` or a Bloom filter
in the same way; what a filter lets through by mistake is counted like anything else and falls at the threshold.

Each part of a cut is looked up in the table of all counts by salted_join, so that a common first word doesn't meet in one task. A candidate lies inside a longer one of the same count just when it lies inside one that is
longer by a word: counts can only fall along the way.

Defined results: a null text is empty, a null language is `und`. doc_id isn't read, so rows that repeat one count as often as they occur. An empty table gives no rows. Texts are taken whole, in parts that end with a piece.
Of equal scores the higher count comes first, then the phrase in byte order. Only text and lang are read, so that other columns may have any names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bloom import bits_for, built, has_all, opened, places
from .common import salted_join, slices, table, written
from .tokens import mix

LEAST, LONGEST, TOP = 100, 5, 2000
MOST, GROUP, BUCKET, SHARE, FEW = 4_000_000, 1_000_000, 250_000, 2000, 1000
PART, HELD = 1 << 19, 1_000_000

STOP = re.compile(rb"[.,;:!?\x0A-\x0D]")
AS_BLANKS = bytes(32 if chr(c) in ".,;:!?" else c for c in range(256))
KIND = np.zeros(256, np.uint8)  # 1 blank, 2 end of a piece
KIND[[0x20, 0x09]] = 1
KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2
ODD = np.uint64(0x9E3779B97F4A7C15)


def parts(text: bytes | None):
    """The text in parts of about PART bytes that end with a piece."""
    text, at = text or b"", 0
    while len(text) - at > PART and (stop := STOP.search(text, at + PART)):
        yield text[at : stop.end()]
        at = stop.end()
    yield text[at:] if at else text


def grouped(batches):
    """(language, parts of texts of about PART bytes together) of the rows lang, text."""
    for b in (x for whole in batches for x in slices(whole, 1)):
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for part in parts(text):
                some = by.setdefault(lang, [])
                some.append(part)
                if sum(map(len, some)) >= PART:
                    yield lang, by.pop(lang)
        yield from by.items()


class Hash:
    """64-bit hashes of words, never 0: a polynomial over a random table of their bytes, mixed with their length."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.base = rng.integers(1, 1 << 63, 1, dtype=np.uint64) | np.uint64(1)
        self.powers = self.base ** np.arange(1 << 12, dtype=np.uint64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words in order, and the number of each word's piece. Texts don't share pieces."""
        raw = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
        kind = KIND[raw]
        where = np.flatnonzero(kind == 0)
        if not len(where):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(where) > 1) + 1])
        lengths = np.diff(np.concatenate([starts, [len(where)]]))
        inside = np.arange(len(where)) - np.repeat(starts, lengths)
        weights = self.powers[inside & 0xFFF]
        if lengths.max() > len(self.powers):
            far = np.flatnonzero(inside > 0xFFF)
            weights[far] *= (self.powers[-1:] * self.base) ** (inside[far] >> 12).astype(np.uint64)
        sums = np.add.reduceat(self.table[raw[where]] * weights, starts)
        return np.maximum(mix(sums + lengths.astype(np.uint64) * ODD), np.uint64(1)), np.searchsorted(np.flatnonzero(kind == 2), where[starts])


def count_words(batches):
    def rows(lang, seen):
        return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(seen), pa.string()), "word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    held: dict[str, Counter] = {}
    for lang, texts in grouped(batches):
        seen = held.setdefault(lang, Counter())
        for t in texts:
            seen.update(t.lower().translate(AS_BLANKS).split())
        if sum(map(len, held.values())) > HELD:
            yield from (rows(k, v) for k, v in held.items())
            held = {}
    yield from (rows(k, v) for k, v in held.items() if v)


def hashed(seed: int):
    def run(batches):
        of = Hash(seed)
        for b in (x for whole in batches for x in slices(whole, 1)):
            h, _ = of(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(h.view(np.int64))], names=["lang", "word", "n", "hash"])

    return run


class Known:
    """Which 64-bit numbers a language has, for tasks: sorted arrays where there are at most `most` in all, else a Bloom filter."""

    def __init__(self, df: DataFrame, column: str, most: int):
        rows = df.select("lang", F.col(column).alias("v"))
        self.exact = (n := rows.count()) <= most
        self.bits = bits_for(n, 16)
        if self.exact:
            got = rows.toArrow().combine_chunks()
            by = {lang: np.sort(got.filter(pc.equal(got["lang"], lang))["v"].to_numpy().view(np.uint64)) for lang in got["lang"].unique().to_pylist()}
            self.data = df.sparkSession.sparkContext.broadcast(by)
        else:
            self.data = built(rows, lambda b: np.concatenate([_own(lang, b.filter(pc.equal(b.column(0), lang)).column(1).to_numpy().view(np.uint64)) for lang in b.column(0).unique().to_pylist()] or [np.zeros(0, np.uint64)]), self.bits, "once")

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "open"}

    def at(self, lang: str, v: np.ndarray) -> np.ndarray:
        """Where each number is in the sorted array (from 0), or 0 for one that is in the filter; -1 for the others."""
        if self.exact:
            have = self.data.value.get(lang)
            if have is None or not len(have):
                return np.full(len(v), -1, np.int64)
            k = np.minimum(np.searchsorted(have, v), len(have) - 1)
            return np.where(have[k] == v, k, -1)
        if "open" not in self.__dict__:
            self.open = opened(self.data)
        return np.where(has_all(self.open, places(_own(lang, v), self.bits)), 0, -1)


def _own(lang: str, v: np.ndarray) -> np.ndarray:
    return mix(v ^ np.uint64(hash_of(lang)))


def hash_of(lang: str) -> int:
    return int.from_bytes(lang.encode()[:8], "little") * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF


def codes(words: Known, of: Hash, lang: str, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all words in order, 0 for one that isn't frequent; and whether each stands before a frequent one of its own piece and is one itself."""
    h, piece = of(texts)
    at = words.at(lang, h)
    code = np.where(at >= 0, (at + 1).astype(np.uint64) if words.exact else h, np.uint64(0))
    return code, (code[:-1] > 0) & (code[1:] > 0) & (piece[:-1] == piece[1:])


def pair_of(words: Known, code: np.ndarray, at: np.ndarray) -> np.ndarray:
    if words.exact:
        return code[at] << np.uint64(32) | code[at + 1]
    return mix(code[at] * ODD + code[at + 1])


def count_pairs(words: Known, seed: int):
    def run(batches):
        of, held = Hash(seed), {}

        def rows(lang, p, n):
            return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(p), pa.string()), "pair": pa.array(p.view(np.int64)), "n": pa.array(n, pa.int64())})

        for lang, texts in grouped(batches):
            code, both = codes(words, of, lang, texts)
            some = held.setdefault(lang, [])
            some.append(np.unique(pair_of(words, code, np.flatnonzero(both)), return_counts=True))
            if sum(len(p) for p, _ in some) > HELD:
                p, n = merged(some)
                held[lang] = [(p, n)]
                if len(p) > HELD // 2:
                    yield rows(lang, p, n)
                    held[lang] = []
        for lang, some in held.items():
            if some:
                yield rows(lang, *merged(some))

    return run


def merged(some: list) -> tuple[np.ndarray, np.ndarray]:
    p, where = np.unique(np.concatenate([x for x, _ in some]), return_inverse=True)
    return p, np.bincount(where, np.concatenate([n for _, n in some]), len(p)).astype(np.int64)


def bucket_of(lang: str, m: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each row's prefix."""
    h = np.full(len(m), hash_of(lang), np.uint64)
    for k in range(1, m.shape[1] - 1):
        h = np.where(m[:, 0] >= k, mix(h * ODD + m[:, k]), h)
    return (h % np.uint64(buckets)).astype(np.int64)


def project(words: Known, pairs: Known, hot: Known, seed: int, longest: int, buckets: int):
    """For mapInArrow: lang, bucket, pointers. A row has a task's pointers to the prefixes of one bucket, packed."""

    def run(batches):
        of, held = Hash(seed), {}

        def rows(lang, m):
            bucket = bucket_of(lang, m, buckets)
            order = np.argsort(bucket, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) > 0]))
            packed = [pack(m[own], words.exact) for own in np.split(order, first[1:])]
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(packed), pa.string()), pa.array(bucket[order[first]]), pa.array(packed, pa.binary())], names=["lang", "bucket", "pointers"])

        for lang, texts in grouped(batches):
            code, both = codes(words, of, lang, texts)
            at = np.flatnonzero(both)
            pair = pair_of(words, code, at)
            ok, very = np.zeros(len(code) + longest, bool), np.zeros(len(code) + longest, bool)
            ok[at] = pairs.at(lang, pair) >= 0
            very[at] = ok[at] & (hot.at(lang, pair) >= 0)
            start = np.flatnonzero(ok)
            if not len(start):
                continue
            length, prefix = np.ones(len(start), np.int64), np.full(len(start), 2)
            goes, dealt = np.ones(len(start), bool), np.ones(len(start), bool)
            for k in range(longest - 1):
                goes &= ok[start + k]
                length += goes
                dealt &= very[start + k]
                prefix += dealt
            prefix = np.minimum(prefix, length)
            padded = np.concatenate([code, np.zeros(longest, np.uint64)])
            window = np.where(np.arange(longest)[None, :] < length[:, None], padded[start[:, None] + np.arange(longest)[None, :]], np.uint64(0))
            new = [np.column_stack([prefix.astype(np.uint64), window, np.ones(len(start), np.uint64)])]
            for size in range(2, longest):  # the shorter prefixes of pointers that go to a longer one
                if len(more := np.flatnonzero(prefix > size)):
                    cut = new[0][more]
                    cut[:, 0] = size
                    cut[:, 1 + size : -1] = 0
                    new.append(cut)
            some = held.setdefault(lang, [])
            some.append(summed(np.concatenate(new)))
            if sum(map(len, some)) > HELD // 4:
                one = summed(np.concatenate(some))
                held[lang] = [one]
                if len(one) > HELD // 8:
                    yield rows(lang, one)
                    held[lang] = []
        for lang, some in held.items():
            if some:
                yield rows(lang, summed(np.concatenate(some)))

    return run


def pack(m: np.ndarray, narrow: bool) -> bytes:
    """Rows of pointers column by column, in 32 bits where all but the counts fit."""
    return m[:, :-1].T.astype(np.uint32 if narrow else np.uint64).tobytes() + m[:, -1].tobytes()


def unpacked(data: bytes, narrow: bool, longest: int) -> np.ndarray:
    width = 4 if narrow else 8
    n = len(data) // ((longest + 1) * width + 8)
    left = np.frombuffer(data, np.uint32 if narrow else np.uint64, n * (longest + 1)).reshape(longest + 1, n)
    return np.vstack([left.astype(np.uint64), np.frombuffer(data, np.uint64, n, n * (longest + 1) * width)[None, :]]).T


def summed(m: np.ndarray) -> np.ndarray:
    """Rows that are equal but for their last column as one with its sum."""
    m = m[np.lexsort(m[:, -2::-1].T)]
    first = np.flatnonzero(np.concatenate([[True], (m[1:, :-1] != m[:-1, :-1]).any(axis=1)]))
    out = m[first]
    out[:, -1] = np.add.reduceat(m[:, -1], first)
    return out


def grow(narrow: bool, longest: int, least: int):
    """For mapInArrow over rows lang, bucket, pointers in the order of their buckets: the frequent phrases, as lang, phrase, size, a."""
    kind = ">u4" if narrow else ">u8"

    def run(batches):
        key, held = None, []
        for b in batches:
            for lang, bucket, data in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if held and key != (lang, bucket):
                    yield grown(key[0], summed(np.concatenate(held)))
                    held = []
                key = lang, bucket
                held.append(unpacked(data, narrow, longest))
        if held:
            yield grown(key[0], summed(np.concatenate(held)))

    def grown(lang, m):
        size, window, upto = m[:, 0].astype(np.int64), m[:, 1:-1], np.concatenate([[0], np.cumsum(m[:, -1].astype(np.int64))])
        found = []

        def extend(low, high, depth):
            """The pointers low..high share their first `depth` words."""
            count = int(upto[high] - upto[low])
            if count < least:
                return
            found.append((window[low, :depth].astype(kind).tobytes(), depth, count))
            if depth < longest:
                last = window[low:high, depth]
                begin = np.concatenate([[0], np.flatnonzero(last[1:] != last[:-1]) + 1, [high - low]]) + low
                for k in np.flatnonzero((upto[begin[1:]] - upto[begin[:-1]] >= least) & (window[begin[:-1], depth] > 0)):
                    extend(int(begin[k]), int(begin[k + 1]), depth + 1)

        same = (window[1:] == window[:-1]).cumprod(axis=1).sum(axis=1)
        first = np.flatnonzero(np.concatenate([[True], (size[1:] != size[:-1]) | (same < size[1:])]))
        for low, high in zip(first.tolist(), [*first[1:].tolist(), len(m)], strict=True):
            extend(low, high, int(size[low]))
        columns = list(zip(*found, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), *(pa.array(x, t) for x, t in zip(columns, (pa.binary(), pa.int32(), pa.int64()), strict=True))], names=["lang", "phrase", "size", "a"])

    return run


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, most: int = MOST, share: int = SHARE, group: int = GROUP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to `longest` words that occur at least `least` times, by the lowest-scoring of their cuts."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    counted = written(rows.mapInArrow(count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    sizes = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    seed = 11
    while True:
        every = counted.mapInArrow(hashed(seed), "lang string, word binary, n long, hash long")
        if every.groupBy("lang", "hash").count().where("count > 1").isEmpty():
            break
        seed += 1
    frequent = written(every.where(F.col("n") >= least), "frequent_words")
    words = Known(frequent, "hash", most)
    width = 4 if words.exact else 8

    pairs = rows.mapInArrow(count_pairs(words, seed), "lang string, pair long, n long").groupBy("lang", "pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    pairs = written(pairs, "frequent_pairs")
    every_pointer = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    from_n = max(min(max(every_pointer // share, FEW), group), every_pointer // most)
    hot, known = Known(pairs.where(F.col("n") > from_n), "pair", most), Known(pairs, "pair", most)

    buckets = max(1, -(-every_pointer // BUCKET))
    pointers = rows.mapInArrow(project(words, known, hot, seed, longest, buckets), "lang string, bucket long, pointers binary")
    by_bucket = pointers.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")
    phrases = written(by_bucket.mapInArrow(grow(words.exact, longest, least), "lang string, phrase binary, size int, a long"), "phrases")

    def numbered(batches):
        for b in batches:
            h = b.column(1).to_numpy().view(np.uint64)
            code = h.copy()
            langs = b.column(0).to_pylist()
            if words.exact:
                for lang in set(langs):
                    own = np.array([x == lang for x in langs])
                    code[own] = words.at(lang, h[own]) + 1
            raw = code.astype(">u4" if width == 4 else ">u8").tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([raw[k : k + width] for k in range(0, len(raw), width)], pa.binary()), b.column(2), b.column(3)], names=["lang", "part", "word", "f"])

    lexicon = written(frequent.select("lang", "hash", "word", F.col("n").alias("f")).mapInArrow(numbered, "lang string, part binary, word binary, f long"), "lexicon")
    counts = lexicon.select("lang", "part", "f").unionByName(phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")))
    cut = lambda k: F.array(F.struct(k.alias("k"), F.lit(0).alias("side"), F.substring("phrase", F.lit(1), k * width).alias("part")), F.struct(k.alias("k"), F.lit(1).alias("side"), F.substring("phrase", k * width + 1, F.lit(longest * width)).alias("part")))
    ends = phrases.select("lang", "phrase", "size", "a", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.col("size") - 1), cut))).alias("c")).select("lang", "phrase", "size", "a", "c.*")
    found = salted_join(written(ends, "cuts"), counts, ["lang", "part"])
    side = lambda k, s: F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f")))
    cuts = found.groupBy("lang", "phrase", "size", "a").agg(*[side(k, s).alias(f"{'lr'[s]}{k}") for k in range(1, longest) for s in (0, 1)])
    cuts = written(cuts, "scored")

    shorter = F.substring("phrase", F.lit(1), (F.col("size") - 1) * width), F.substring("phrase", F.lit(width + 1), F.col("size") * width)
    last_l = F.coalesce(*[F.when(F.col("size") == k + 1, F.col(f"l{k}")) for k in range(2, longest)]) if longest > 2 else F.lit(None)
    covered = cuts.where("size > 2").select("lang", F.explode(F.array_compact(F.array(F.when(last_l == F.col("a"), shorter[0]), F.when(F.col("r1") == F.col("a"), shorter[1])))).alias("phrase")).distinct()
    left = cuts.join(covered, ["lang", "phrase"], "left_anti").join(sizes, "lang")
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    best = F.array_min(F.array_compact(F.array(*[F.when(F.col("size") > k, F.struct(F.expr(f"cast(1000 as decimal(4, 0)) * {wide('a')} * {wide('n')} div ({wide(f'l{k}')} * {wide(f'r{k}')})").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)])))
    scored = left.select("lang", "phrase", "size", "a", "n", best.alias("b")).select("lang", "phrase", "size", "a", "n", "b.score", "b.l", "b.r")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = scored.withColumn("at", F.rank().over(order)).where(F.col("at") <= top).drop("at")  # with all of equal score and count at the end, which their words put in order

    each = first.select("*", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda k: F.substring("phrase", k * width + 1, F.lit(width)))).alias("pos", "part"))
    said = each.join(lexicon.select("lang", "part", "word"), ["lang", "part"]).groupBy("lang", "phrase", "a", "l", "r", "n", "score")
    said = said.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"].cast("string")), " ").alias("words"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "words")
    return said.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("lang", "rank", F.col("words").alias("phrase"), "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
every AS (SELECT lang, unnest(w) AS word FROM pieces),
sizes AS (SELECT lang, count(*) AS n FROM every GROUP BY lang),
g AS (SELECT lang, k, w[i:i + k - 1] AS p FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 6) r(k))),
f AS (SELECT lang, k::BIGINT AS size, p, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, size, p, f AS a FROM f WHERE size > 1),
cuts AS (SELECT c.lang, c.size, c.p, a, cut, x.f AS l, y.f AS r FROM (SELECT *, unnest(range(1, size)) AS cut FROM c) c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:cut] JOIN f y ON y.lang = c.lang AND y.p = c.p[cut + 1:]),
scored AS (SELECT *, (1000::HUGEINT * a * n) // (l::HUGEINT * r) AS score FROM cuts JOIN sizes USING (lang)),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
inner_parts AS (SELECT DISTINCT lang, p[i:i + k - 1] AS p, a FROM (SELECT lang, p, a, k, unnest(range(1, size - k + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS k FROM c))),
kept AS (SELECT b.* FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_parts i WHERE i.lang = b.lang AND i.p = b.p AND i.a >= b.a))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (SELECT *, array_to_string(p, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM kept) WHERE rank <= 2000
"""
