"""N-gram Jaccard join: exact, size-aware, heavy-light.

A text's set holds its distinct five-word shingles as 64-bit hashes (lower-cased A-Z, words between ASCII white space; the whole sequence where it has fewer words). Equal
sets are one node, however many documents share them. Two nodes link when their Jaccard similarity is at least PERCENT / 100.

Candidates. Shingles have one global order: those that a count sketch of the whole corpus shows as frequent come last, the rest by hash. Sets that link share at least one shingle in
their prefixes of size - need + 1, and at least two in those of size - need + 2 (need: the least overlap that a link takes). Small sets enumerate the two-element subsets of the
longer prefix; large sets are found through inverted lists of the shorter one, which small sets enter for their large partners. The boundary is the size for which the estimated
cost of both is least. Keys in fewer than two sets are left out by two Bloom filters before their rows are shuffled. Of keys with the same sets, SHORT at most, one is kept.

The place of a key in a set's order bounds the overlap of pairs that have their first common shingles there, and so the sizes of the partners that the set may meet by this key. A list
holds the sets of a key; one of more than SHORT sets is cut into lists for each pair of size classes, of which those without sets on both sides are dropped. Texts that share most of their words but too few
to link thus meet in no long list.

Verification. In rounds (at most STARS), every node of a list whose nodes aren't in one component yet meets the one of the lists' pivots that it shares most lists with; components grow. A list's first pivot is the
node that meets most others in all its lists, which is the text that a group of copies was made from or one close to it; so a group is one component after a round or two, and few of its pairs are left. Rounds end with one that
linked fewer than WORTH of the nodes. In lists that would still make many pairs, the nodes outside the commonest component then meet every EARLY-th node first, and most of those that have a link join a component by it. What is left is exact: in each list, every node outside its commonest component meets every node of another component that it may link with. Lists with more than SHORT
nodes outside are split first, by the next shingle that two of their nodes have in common (at most DESCENTS times), where that leaves fewer pairs
or more than LONG are outside. Of lists with many pairs, two nodes meet in the first that they share only. Parity bitmaps, which never reject a link, and then the whole sets decide. Every link
between different components is thus found; links inside one change nothing.

Defined results: a text without words (or null) has an empty set and links with nothing. A null doc_id has a set but takes no part, and its component_id is null. Rows that repeat a doc_id
link by their own texts. An empty table gives no rows. Texts of any length are taken whole; batches are cut by bytes, so that memory follows the longest text. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import bits_for, built, built_from_hashes, has_all, near_places, opened, places
from .common import SHARE, discard, pow2_at_least, salted_join, slices, table, total, written
from .components import components
from .tokens import BASE, Words, mix

K, PERCENT, STARS, PIVOTS, WORTH = 5, 75, 8, 3, 0.15
BUCKETS, MOST_SMALL = 1 << 20, 64
LEAST_BITS, MOST_BITS = 1 << 10, 1 << 16
SHORT, LONG, DESCENTS, EARLY = 64, 1024, 3, 6
FEW_PAIRS = 100_000
EXACT_CLASSES, PER_DOUBLING = 16, 8


def shingle_sets(texts) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = Words(texts)
    h, at = w.hashes, w.at
    n = np.diff(at)
    out = []
    rolled = h[: max(len(h) - K + 1, 0)].copy()
    for k in range(1, K):
        rolled = rolled * BASE + h[k : len(h) - K + 1 + k]
    rolled = mix(rolled)
    for i in range(len(texts)):
        if n[i] >= K:
            out.append(np.unique(rolled[at[i] : at[i + 1] - K + 1]))
        elif n[i]:
            x = np.uint64(0)
            with np.errstate(over="ignore"):
                for v in h[at[i] : at[i + 1]]:
                    x = x * BASE + v
                out.append(mix(np.array([x + np.uint64(n[i])])))
        else:
            out.append(h[:0])
    return out


def need(n):
    """The least number of shingles that a set of n shares with any set it links with."""
    return -(-PERCENT * n // 100)


def parity(s: np.ndarray) -> bytes:
    """A bitmap of a set, as wide as the set is large: bit i tells whether an odd number of shingles fall on it."""
    bits = min(max(pow2_at_least(len(s)), LEAST_BITS), MOST_BITS)
    return np.packbits((np.bincount(((s >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """In how many bits two bitmaps differ, the wider one folded to the narrower one's width, which keeps parities."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def sketch(batches):
    out = np.zeros(BUCKETS, np.uint32)
    for b in batches:
        for part in slices(b, 0):
            flat = np.concatenate([np.zeros(0, np.uint64), *shingle_sets(part.column(0).to_pylist())])
            out += np.bincount((flat & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS).astype(np.uint32)
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two numbers."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist())


def features(heavy):
    """(doc_id, n, d1, d2, prefix, bitmap) of each row; d1, d2: the set's digest; prefix: the longest that is needed, in the global order. heavy: the sketch where it stands out, else 0."""

    def run(batches):
        counts = heavy.value
        for b in batches:
            for part in slices(b, 1):
                out = {k: [] for k in ("n", "d1", "d2", "prefix", "bitmap")}
                for s in shingle_sets(part.column(1).to_pylist()):
                    n, row = len(s), (0, None, None, None, None)
                    if n:
                        c = counts[(s & np.uint64(BUCKETS - 1)).astype(np.int64)]
                        p = min(n - need(n) + 2 + DESCENTS, n)
                        light = s[c == 0]
                        if len(light) < p:
                            more = s[c > 0]
                            light = np.concatenate([light, more[np.lexsort((more, c[c > 0]))]])
                        row = (n, *digest(s), light[:p].view(np.int64), parity(s))
                    for k, v in zip(out, row, strict=True):
                        out[k].append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], names=["doc_id", *out])

    return run


def boundary(sizes: list[tuple[int, int]], length: float) -> int:
    """The size up to which sets enumerate subsets: the least estimated cost of emitting keys and walking lists of the mean length given."""
    n, c = (np.array([x[k] for x in sizes], np.float64) for k in (0, 1))
    p = n - need(n) + 1
    subsets, single = (p + 1) * p / 2, p * (1 + length)
    costs = [(c[n <= b] * subsets[n <= b]).sum() + (c[100 * n > PERCENT * b] * single[100 * n > PERCENT * b]).sum() for b in range(2, MOST_SMALL + 1)]
    return 2 + int(np.argmin(costs)) if len(n) else 2


def reach(overlap, n):
    """The size of the largest set that links with one of n if they share at most `overlap` shingles."""
    return np.minimum(overlap * (100 + PERCENT) // PERCENT - n, 100 * n // PERCENT)


def keys_of(flat: np.ndarray, sizes: np.ndarray, n: np.ndarray, small: int) -> dict[str, np.ndarray]:
    """The keys of sets, of which two that link always share one. flat: their prefixes one after another, `sizes` elements of each; n: their sizes.

    key, row (which set), level (how many shingles make it), pos (the place of the last of them), lo and hi (the sizes of partners that it may find). Sets of fewer than three shingles link with equal ones only."""
    at = np.concatenate([[0], np.cumsum(sizes)])
    row = np.repeat(np.arange(len(n)), sizes)
    pos, m = np.arange(len(flat)) - at[row], n[row]
    lo, hi = np.where(m > small, need(m), np.maximum(need(m), small + 1)), reach(m - pos, m)
    keep = (m > 2) & (pos <= m - need(m)) & (lo <= hi)
    parts = [(mix(flat[keep]), row[keep], np.ones(int(keep.sum()), np.int64), pos[keep], lo[keep], hi[keep])]
    for i in np.flatnonzero((n > 2) & (n <= small)):
        k = int(n[i])
        first = flat[at[i] : at[i + 1]][: k - need(k) + 2]
        x, y = np.triu_indices(len(first), 1)
        far = np.minimum(reach(k - y + 1, k), small)
        x, y, far = (v[far >= need(k)] for v in (x, y, far))
        parts.append((mix(mix(first[x]) * BASE + first[y]), np.full(len(x), i), np.full(len(x), 2), y, np.full(len(x), need(k)), far))
    return dict(zip(("key", "row", "level", "pos", "lo", "hi"), (np.concatenate([p[k] for p in parts]) for k in range(6)), strict=True))


def batch_keys(b, small: int) -> dict[str, np.ndarray]:
    """The keys of a batch of (prefix, n)."""
    return keys_of(b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64), b.column(0).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), b.column(1).to_numpy(zero_copy_only=False), small)


FEW_ROWS = 1000


def postings(filter_of, bits: int, small: int):
    """(key, node, n, level, pos, lo, hi) of each set's keys that the filter knows."""

    def run(batches):
        twice = opened(filter_of)
        for b in batches:
            for at in range(0, len(b), FEW_ROWS):
                part = b.slice(at, FEW_ROWS)
                got = batch_keys(part, small)
                key = got["key"]
                k = np.concatenate([np.zeros(0, np.int64), *(np.flatnonzero(has_all(twice, near_places(key[i : i + (1 << 18)], bits))) + i for i in range(0, len(key), 1 << 18))])
                rows = pa.array(got["row"][k])
                yield pa.RecordBatch.from_arrays([pa.array(key[k].view(np.int64)), part.column(2).take(rows), part.column(1).take(rows), *(pa.array(got[c][k].astype(np.int32)) for c in ("level", "pos", "lo", "hi"))], names=["key", "node", "n", "level", "pos", "lo", "hi"])

    return run


def sets_of(filter_of, bits: int):
    """(doc_id, d1, d2, members) of the rows whose doc_id is in the filter."""

    def run(batches):
        known = opened(filter_of)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            at = np.flatnonzero(has_all(known, places(mix(ids), bits))) if len(ids) else []
            for part in slices(b.take(pa.array(at, pa.int64())), 1):
                got = shingle_sets(part.column(1).to_pylist())
                ds = [digest(s) for s in got]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([d[k] for d in ds], pa.int64()) for k in (0, 1)), pa.array([s.view(np.int64) for s in got], pa.list_(pa.int64()))], names=["doc_id", "d1", "d2", "members"])

    return run


def near_enough(batches):
    """(a, b) of pairs(a, b, n, x, y) that the bitmaps don't rule out: sets that link differ in at most n (100 - PERCENT) / (100 + PERCENT) shingles (n: both sizes together), and bitmaps in no more bits."""
    for b in batches:
        far = np.array([apart(x.as_py(), y.as_py()) for x, y in zip(b.column(3), b.column(4), strict=True)], np.int64)
        keep = far * (100 + PERCENT) <= b.column(2).to_numpy(zero_copy_only=False) * (100 - PERCENT)
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def size_class(n):
    """Sizes that one list takes together: exact up to EXACT_CLASSES, then PER_DOUBLING to each doubling."""
    return F.when(n <= EXACT_CLASSES, n).otherwise(EXACT_CLASSES + F.floor(F.log2(n / EXACT_CLASSES) * PER_DOUBLING + 1e-9)).cast("int")


def tagged(keys: DataFrame) -> DataFrame:
    """keys by lists, one for each pair of size classes: list, node, n, g (the node's class), h (its partners'), level, pos, lo, hi, w (how many sets have the key)."""
    x = keys.withColumn("g", size_class(F.col("n"))).withColumn("h", F.explode(F.sequence(size_class(F.col("lo")), size_class(F.col("hi")))))
    return x.select(F.xxhash64("key", F.least("g", "h"), F.greatest("g", "h")).alias("list"), "node", "n", "g", "h", "level", "pos", "lo", "hi", F.col("c").alias("w"), F.lit(1).cast("long").alias("times"))


def merged(keys: DataFrame) -> DataFrame:
    """The keys of postings that two sets have at least: key, c (how many), x and y (their least and largest size). Of keys with the same sets, SHORT at most, only one, with their number as `times`: two near copies share dozens of keys that nobody else has.

    The same sets: as many, with the same sizes at both ends and the same sum of hashes."""
    each = keys.groupBy("key").agg(F.count("*").alias("c"), F.min("n").alias("x"), F.max("n").alias("y"), F.bit_xor(F.xxhash64("node")).alias("who")).where("c > 1")
    return each.groupBy("c", "x", "y", "who", F.when(F.col("c") > SHORT, F.col("key")).alias("own")).agg(F.min("key").alias("key"), F.count("*").alias("times")).select("key", "c", "x", "y", "times")


def widened(met: DataFrame) -> DataFrame:
    """Rows of keys, with all sizes that a set may link with as lo and hi where the key stands for several."""
    for c, v in (("lo", F.ceil(F.col("n") * PERCENT / 100)), ("hi", F.floor(F.col("n") * 100 / PERCENT))):
        met = met.withColumn(c, F.when(F.col("times") > 1, v.cast("int")).otherwise(F.col(c)))
    return met


def two_sided(rows: DataFrame) -> DataFrame:
    """Of rows of lists (a table), those of lists that have nodes on both sides."""
    n = rows.count()
    sides = rows.groupBy("list").agg(F.count("*").alias("c"), F.min("g").alias("x"), F.max("g").alias("y"), F.min("h").alias("z")).where("c > 1 and (x < y or x = z)")
    both = sides.select("list", (F.col("c") * SHARE >= n).alias("heavy"))
    return salted_join(rows, both, ["list"]).select(*rows.columns, "heavy")


class Join:
    """The state of one join: what is known of rows, lists, sets and components, each a table in the shared folder."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
        counts = total(self.docs.select("text"), sketch, np.uint32)
        counts = np.zeros(BUCKETS, np.uint32) if counts is None else counts
        mean = counts.mean()
        heavy = np.where(counts > mean + 8 * np.sqrt(mean + 1) + 16, counts, 0).astype(np.uint32)
        self.own = []
        every = written(self.docs.mapInArrow(features(self.spark.sparkContext.broadcast(heavy)), "doc_id long, n long, d1 long, d2 long, prefix array<long>, bitmap binary"), "features")
        self.rows = written(every.select("doc_id", "n", "d1", "d2"), "rows")
        whole = every.where("n > 0 and doc_id is not null")
        self.classes = self.kept(whole.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")).withColumn("node", F.monotonically_increasing_id()), "classes")
        of = self.classes.where("n > 2").drop("n")
        self.nodes = self.kept(whole.where("n > 2").join(of, ["doc_id", "d1", "d2"]).dropDuplicates(["doc_id", "d1", "d2"]).select("node", "doc_id", "n", "prefix", "bitmap"), "nodes")
        discard(every)
        sizes = [(r["n"], r["c"]) for r in self.nodes.groupBy(F.least("n", F.lit(2 * MOST_SMALL)).alias("n")).agg(F.count("*").alias("c")).collect()]  # at most 2 x MOST_SMALL rows
        total_count = float(counts.sum(dtype=np.float64))
        length = max(0.0, float((counts.astype(np.float64) ** 2).sum()) / max(total_count, 1) - total_count / BUCKETS - 1)
        self.small = boundary(sizes, length)
        self.sets = None

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        """df written, until the join ends."""
        self.own.append(written(df, name))
        return self.own[-1]

    def lists(self) -> None:
        """The lists with nodes on both sides, and each of their nodes as its own component."""
        expected = int(self.nodes.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).collect()[0][0])
        bits = bits_for(expected, 8)
        small = self.small

        def hashes(b):
            return np.concatenate([np.zeros(0, np.uint64), *(batch_keys(b.slice(at, FEW_ROWS), small)["key"] for at in range(0, len(b), FEW_ROWS))])

        twice = built_from_hashes(self.nodes.select("prefix", "n"), hashes, bits)
        keys = written(self.nodes.select("prefix", "n", "node").mapInArrow(postings(twice, bits, small), "key long, node long, n long, level int, pos int, lo int, hi int"), "postings")
        sizes = written(merged(keys), "keys")
        met = written(widened(salted_join(keys, sizes, ["key"], counts=sizes.select("key", F.col("c").alias("count")))).where("hi >= x and lo <= y").drop("x", "y"), "met")
        discard(keys, sizes)
        short = met.where(F.col("c") <= SHORT).select(F.col("key").alias("list"), "node", "n", "lo", "hi", (F.col("c") * F.col("times")).alias("w"), "times", F.lit(False).alias("heavy"))
        cut = written(tagged(met.where(F.col("c") > SHORT)), "tagged")
        self.short, self.long = self.kept(short, "short"), self.kept(two_sided(cut), "long")
        discard(met, cut)
        self.heavy = not self.long.where("heavy").isEmpty()
        found = self.short.select("node", "n", "w").unionByName(self.long.select("node", "n", "w"))
        self.parts = self.kept(found.groupBy("node").agg(F.max("n").alias("n"), F.sum("w").alias("w")).select("node", F.col("node").alias("part"), "n", F.floor(F.log2(F.col("w") + 1) * (1 << 13)).alias("w")), "parts")

    @staticmethod
    def some(rows: DataFrame, pairs: DataFrame) -> DataFrame:
        """rows by node, of few pairs (a table) those of their nodes only."""
        if pairs.count() > FEW_PAIRS:
            return rows
        return rows.join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "node", "left_semi")

    def near(self, pairs: DataFrame) -> DataFrame:
        """pairs(a, b, n), n being the sizes of both, without those that the bitmaps rule out."""
        nodes = self.some(self.nodes, pairs)
        of = lambda a, x: nodes.select(F.col("node").alias(a), F.col("bitmap").alias(x))
        return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "n", "x", "y").mapInArrow(near_enough, "a long, b long")

    def have_sets(self, pairs: DataFrame) -> None:
        """Reads the sets of the pairs' nodes that aren't at hand: of one document each, found in a scan by a Bloom filter of their ids."""
        ids = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        if self.sets is not None:
            ids = ids.join(self.sets.select("node"), "node", "left_anti")
        wanted = self.kept(self.classes.join(ids, "node", "left_semi").select("node", "doc_id", "d1", "d2"), "wanted")
        n = wanted.count()
        if not n:
            return
        bits = bits_for(n, 16)
        once = built(wanted.select("doc_id"), lambda b: mix(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)), bits, "once")
        sets = self.docs.where("doc_id is not null").mapInArrow(sets_of(once, bits), "doc_id long, d1 long, d2 long, members array<long>")
        sets = self.kept(sets.join(wanted, ["doc_id", "d1", "d2"]).dropDuplicates(["doc_id", "d1", "d2"]).select("node", "members"), "sets")
        self.sets = sets if self.sets is None else self.sets.unionByName(sets)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose whole sets link."""
        sets = self.some(self.sets, pairs)
        of = lambda a, x: sets.select(F.col("node").alias(a), F.col("members").alias(x))
        both = F.size(F.array_intersect("x", "y")).cast("long")
        x = pairs.join(of("b", "y"), "b").join(of("a", "x"), "a").select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("n"))
        return x.where(F.col("both") * 100 >= (F.col("n") - F.col("both")) * PERCENT).select("a", "b")

    def merge(self, links: DataFrame) -> int:
        """Joins the components that links(a, b) connect; how many such links there are."""
        of = lambda s: self.parts.select(F.col("node").alias(s), F.col("part").alias(f"p{s}"))
        edges = self.kept(links.join(of("a"), "a").join(of("b"), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a <> b").distinct(), "links")
        n = edges.count()
        if not n:
            return 0
        roots = components(edges).withColumnRenamed("node", "part")
        self.parts = self.kept(salted_join(self.parts, roots, ["part"], "left").select("node", F.coalesce("root", "part").alias("part"), "n", "w"), "parts")
        return n

    def linked(self, pairs: DataFrame) -> int:
        """Joins the components of the nodes of pairs(a, b, n) that link; how many pairs of components do."""
        pairs = written(pairs, "pairs")
        near = written(self.near(pairs), "near")
        discard(pairs)
        n = 0
        if not near.isEmpty():
            self.have_sets(near)
            n = self.merge(self.verified(near))
        discard(near)
        return n

    @staticmethod
    def around(lists: DataFrame, info: DataFrame, heavy: bool) -> DataFrame:
        """Rows of lists with what is known of each list; those with at least 1 / SHARE of all rows, fewer than SHARE, by broadcast. heavy: whether there are any."""
        on = ["list", "heavy"]
        if not heavy:
            return lists.join(info, on)
        return lists.where("not heavy").join(info.where("not heavy"), on).unionByName(lists.where("heavy").join(F.broadcast(info.where("heavy")), on))

    fits = staticmethod(lambda n, m: (F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT))

    def star(self, k: int) -> int:
        short, long = (x.select("list", "heavy", "node", "lo", "hi", "times") for x in (self.short, self.long))
        lists = short.unionByName(long).join(self.parts, "node")
        # the node that meets most others in its lists, in later rounds that of a quarter, so that no pair comes twice for sure; then any nodes
        tried = F.lit(True) if not k else F.pmod(F.xxhash64("node", F.lit(-k)), F.lit(4)) == 0
        firsts = [F.max_by("node", F.when(tried, F.col("w"))).alias("p0")]
        firsts += [F.min_by("node", F.xxhash64("node", F.lit(PIVOTS * k + i))).alias(f"p{i}") for i in range(1, PIVOTS)]
        open_ = lists.groupBy("list", "heavy").agg(F.min("part").alias("x"), F.max("part").alias("y"), *firsts).where("x <> y")
        pivots = open_.select("list", "heavy", F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(PIVOTS)]))).alias("a")).where("a is not null")
        of = self.parts.select(F.col("node").alias("a"), F.col("part").alias("pa"), F.col("n").alias("m"), F.col("w").alias("wa"))
        met = self.around(lists, pivots.join(of, "a"), self.heavy).where((F.col("part") != F.col("pa")) & F.col("m").between(F.col("lo"), F.col("hi")) & self.fits(F.col("n"), F.col("m")))
        pairs = met.groupBy("a", F.col("node").alias("b")).agg(F.sum("times").alias("c"), F.max(F.col("n") + F.col("m")).alias("n"), F.max("wa").alias("wa"))
        # the pivot with most lists in common; of equal ones, the one that meets most others
        rank = F.col("c") * F.lit(1 << 20) + F.col("wa")
        best = pairs.groupBy("b").agg(F.max_by("a", rank).alias("a"), F.max_by("n", rank).alias("n"))
        return self.linked(best.select("a", "b", "n"))

    def split(self, long: DataFrame) -> DataFrame:
        """Rows of lists, split by the next shingle that two nodes of a list have in common."""
        x = long.join(self.nodes.select("node", "prefix"), "node")
        upto = F.least(F.size("prefix"), F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + F.col("level") + 1)
        rest = F.transform(F.slice("prefix", F.col("pos") + 2, F.greatest(F.lit(0), upto - F.col("pos") - 1).cast("int")), lambda s, i: F.struct(s.alias("s"), (F.col("pos") + 1 + i).alias("pos")))
        x = x.withColumn("e", F.explode(rest))
        overlap = F.col("n") - F.col("e.pos") + F.col("level")
        hi = F.least(F.col("hi"), F.floor(overlap * (100 + PERCENT) / PERCENT + 1e-9) - F.col("n")).cast("int")
        x = x.withColumn("hi", hi).where((F.col("hi") >= F.col("lo")) & (size_class(F.col("hi")) >= F.col("h")))
        return x.select(F.col("list").alias("up"), F.xxhash64("list", "e.s").alias("list"), "node", "n", "g", "h", (F.col("level") + 1).alias("level"), F.col("e.pos").alias("pos"), "lo", "hi")

    def measured(self, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of lists with each node's component, and what is known of the lists of more than one component: the commonest, the nodes outside it, and the cost, at most so many pairs."""
        rows = written(lists.drop("n").join(self.parts.drop("w"), "node"), "rows")
        each = rows.groupBy("list", "heavy", "up", "part").agg(F.count("*").alias("c"), F.min("n").alias("n"))
        info = each.groupBy("list", "heavy", "up").agg(F.max_by("part", "c").alias("common"), (F.sum("c") - F.max("c")).alias("outside"), F.sum("c").alias("c"), F.min("n").alias("least"))
        return rows, self.kept(info.where("outside > 0").select("list", "heavy", "up", "common", "outside", "least", (F.col("outside") * F.col("c")).alias("cost")), "info")

    @staticmethod
    def dealt_once(marked: DataFrame) -> DataFrame:
        """Rows of whole lists with `before`: of lists with more than SHORT x SHORT pairs, those that the node is in by an earlier shingle. A pair that shares one of these meets there, or can't link: its first common shingle bounds its overlap."""
        many = F.col("cost") > SHORT * SHORT
        own = marked.where(many).groupBy("node", "h").agg(F.collect_list(F.struct("pos", "list")).alias("own"))
        before = F.transform(F.filter("own", lambda x: x["pos"] < F.col("pos")), lambda x: x["list"])
        rest = marked.where(~many).withColumn("before", F.lit(None).cast("array<long>"))
        return marked.where(many).join(own, ["node", "h"]).withColumn("before", before).select(*rest.columns).unionByName(rest)

    def meeting(self, marked: DataFrame, share: int = 1) -> DataFrame:
        """(a, b, n) of nodes of different components that meet in a list, one at least outside the commonest, as far as sizes allow; share: with every so-manieth node b only."""
        a = marked.where("part <> common").select("list", "heavy", F.col("node").alias("a"), F.col("n").alias("n"), F.col("part").alias("pa"), F.col("lo").alias("x"), F.col("hi").alias("y"), F.col("before").alias("z"))
        b = marked.where(F.pmod(F.xxhash64("node"), F.lit(share)) == 0).select("list", "heavy", F.col("node").alias("b"), F.col("n").alias("m"), F.col("part").alias("pb"), "lo", "hi", (F.col("part") == F.col("common")).alias("in_common"), "before")
        twice = F.coalesce(F.arrays_overlap("z", "before"), F.lit(False))
        one = F.col("in_common") | (F.col("a") < F.col("b")) if share == 1 else F.col("a") != F.col("b")
        return a.join(b, ["list", "heavy"]).where((F.col("pa") != F.col("pb")) & one & F.col("m").between(F.col("x"), F.col("y")) & F.col("n").between(F.col("lo"), F.col("hi")) & self.fits(F.col("n"), F.col("m")) & ~twice).select("a", "b", (F.col("n") + F.col("m")).alias("n"))

    def compared(self, marked: DataFrame, whole: bool) -> DataFrame:
        """The pairs of nodes of marked that are to be compared. whole: long lists that aren't split."""
        marked = self.dealt_once(marked) if whole else marked.withColumn("before", F.lit(None).cast("array<long>"))
        return written(self.meeting(marked).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n").distinct(), "meeting")

    def marked(self, rows: DataFrame, info: DataFrame) -> DataFrame:
        return written(self.around(rows, info.drop("up"), not info.where("heavy").isEmpty()), "marked")

    def early(self, rows: DataFrame, info: DataFrame) -> int:
        """Links in lists of more than SHORT x SHORT pairs that are found with every EARLY-th node already: who joins a component by one of these need not meet the others. It leaves out nothing: all nodes still outside meet all nodes in rest()."""
        many = info.where(F.col("cost") > SHORT * SHORT)
        if many.isEmpty():
            return 0
        marked = self.marked(rows, many)
        pairs = self.meeting(self.dealt_once(marked), EARLY)
        n = self.linked(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n").distinct())
        discard(marked)
        return n

    def rest(self) -> None:
        whole = lambda lists: lists.drop("times", "w").withColumn("up", F.lit(None).cast("long"))
        many = (F.col("outside") > SHORT) & (F.ceil(F.col("least") * PERCENT / 100) > F.col("level"))
        pairs = []
        if not self.long.isEmpty():
            rows, info = self.measured(whole(self.long))
            if self.early(rows, info):
                discard(rows, info)
                rows, info = self.measured(whole(self.long))
            for step in range(DESCENTS + 1):
                marked = self.marked(rows, info)
                if step == DESCENTS or info.where(F.col("outside") > SHORT).isEmpty():
                    pairs.append(self.compared(marked, not step))
                    discard(marked, rows)
                    break
                parts = written(self.split(marked.where(many)), "split")
                below, under = self.measured(two_sided(parts))
                # a list is split where that leaves fewer pairs, or where its own are too many not to try further; one none of whose parts has two components leaves none
                cost = under.groupBy(F.col("up").alias("list")).agg(F.sum("cost").alias("below"))
                info = self.kept(info.join(cost, "list", "left").withColumn("pays", (F.coalesce("below", F.lit(0)) < F.col("cost")) | (F.col("outside") > LONG)), "chosen")
                pays = info.where("pays").select("list", "heavy")
                pairs.append(self.compared(marked.where(~many).unionByName(marked.where(many).join(pays, ["list", "heavy"], "left_anti").select(*marked.columns)), not step))
                discard(marked, rows, parts)
                rows, info = below, salted_join(under, info.where("pays").select(F.col("list").alias("up")), ["up"])
        # the short lists, which have at most SHORT x SHORT pairs each
        rows, info = self.measured(whole(self.short))
        pairs.append(self.compared(self.around(rows, info.drop("up"), False), False))
        discard(rows, info)
        both = pairs[0]
        for p in pairs[1:]:
            both = both.unionByName(p)
        self.linked(both.distinct())
        discard(*pairs)

    def result(self) -> DataFrame:
        self.lists()
        nodes = self.parts.count()
        for k in range(STARS):
            if self.star(k) <= WORTH * nodes:
                break
        self.rest()
        found = written(self.classes.select("node", "d1", "d2", "doc_id").join(self.parts, "node", "left").select("d1", "d2", "doc_id", F.coalesce("part", "node").alias("part")), "found")
        discard(*self.own)
        least = found.groupBy("part").agg(F.min("doc_id").alias("component"))
        classes = salted_join(found, least, ["part"]).select("d1", "d2", "component")
        out = salted_join(self.rows, classes, ["d1", "d2"], "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def join(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    return Join(docs).result()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
