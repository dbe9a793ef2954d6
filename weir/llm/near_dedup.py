"""Near-duplicates by MinHash, banding and sequential Bayesian verification.

1. Each text becomes the set of its distinct word shingles (64-bit hashes), a fingerprint of that set and a signature of
   ``BANDS * ROWS`` minimum hashes. Texts of equal sets form a class; its smallest id stands for it from there on.
2. Signatures are cut into bands. Two classes with a band in common are candidates. Not all pairs of such a bucket are made:
   each member is paired with the smallest and the greatest of the bucket first, then with hubs among what these links leave
   unconnected, and only what is still unconnected around a hub is compared member by member, in blocks. Pairs whose sizes, or shingles
   that no other candidate has, rule out the similarity are left out. So are those that differ from a hub in too much of their own: for
   sets x, y and any hub h, the symmetric difference of x and y has |x^h| + |y^h| - 2 |x^h & y^h| elements, and what x alone has
   outside h is not in y^h.
3. A pair's signatures are compared a batch of hashes at a time. After n hashes with m equal ones the posterior probability
   (uniform prior) that the similarity reaches the threshold is P(Binomial(n + 1, threshold) <= m); where it falls below
   ``MISS``, the pair is dropped. The rest is verified exactly on the words of the whole texts.
4. Components of the verified links give each text the smallest id reachable.

The chance that a pair right at the threshold 0.8 shares no band is (1 - 0.8^5)^40, about 1e-7.

Texts with fewer words than a shingle are one shingle; null texts and texts without words have an empty set and are linked
with nothing. Rows of one id are one document for linking. Rows with a null id are linked with nothing unless their set equals another's; without one, their component is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import slices, texts_of, with_columns, written
from .components import components

BANDS, ROWS = 40, 5
#: Hashes compared at a time, and the probability with which a true pair may be dropped at each step.
BATCH, MISS = 25, 1e-6
#: Members of a block.
BLOCK = 128


class WordHashes(dict):
    """Hash of each word met, kept for at most ``keep`` words of at most ``LONGEST`` bytes: about 12 MB."""

    LONGEST = 48

    def __init__(self, keep: int = 80_000) -> None:
        super().__init__()
        self.keep = keep

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.keep:
                self.clear()
            self[word] = h
        return h


def words_of(text: str) -> list[bytes]:
    # bytes.lower() and bytes.split() know ASCII only: A-Z, and blank, tab, line feed, vertical tab, form feed, carriage return
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], k: int, known: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of the shingles of ``k`` words."""
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    if not len(h):
        return h
    k = min(k, len(h))
    mixed = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    size = BANDS * ROWS
    return rng.integers(0, 1 << 32, size, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, size, dtype=np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    a, b = _permutations()
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 2048):
        block = x[at : at + 2048][None, :] * a[:, None]
        block += b[:, None]
        block ^= block >> np.uint32(15)
        block *= np.uint32(0x2C1B3C6D)
        np.minimum(out, block.min(axis=1), out=out)
    return out


def sketches(df: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """doc_id, n (shingles), set (fingerprint) and sig (binary), the last two null for an empty set."""
    schema = T.StructType([T.StructField("doc_id", df.schema[doc_id].dataType), T.StructField("n", T.LongType()), T.StructField("set", T.BinaryType()), T.StructField("sig", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in slices(batches):
            sets = [shingle_hashes(words_of(t), k, known) for t in texts_of(b.column(1))]
            new = {
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "set": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                "sig": pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            }
            yield with_columns(b, arrow, new)

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def least_matches(threshold: float, miss: float = MISS) -> list[tuple[int, int]]:
    """(n, m): after n hashes, a pair with fewer than m equal ones is dropped."""
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def _plausible(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures leave a similarity of ``threshold`` possible."""
    bounds = least_matches(threshold)
    left, right = (reps.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}")) for x in "ab")
    sizes = F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-6
    joined = pairs.join(left, "a").join(right, "b").where(sizes).select("a", "b", "sa", "sb")
    schema = T.StructType([joined.schema["a"], joined.schema["b"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = ([np.frombuffer(x, np.uint32) for x in b.column(k).to_pylist()] for k in (2, 3))
            alive = np.arange(b.num_rows)
            matches = np.zeros(b.num_rows, dtype=np.int64)
            done = 0
            for n, m in bounds:
                if not len(alive):
                    break
                matches[alive] += (np.stack([left[i][done:n] for i in alive]) == np.stack([right[i][done:n] for i in alive])).sum(axis=1)
                alive, done = alive[matches[alive] >= m], n
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], schema=to_arrow_schema(schema)).take(pa.array(alive, pa.int64()))

    return joined.mapInArrow(run, schema).distinct()


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b and common (size of the intersection) for the pairs whose sets, from the whole texts, have 100 * intersection >= percent * union."""
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
    texts = written(docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text"), "texts")
    joined = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    schema = T.StructType([joined.schema["a"], joined.schema["b"], T.StructField("common", T.LongType())])

    def shingles(text: str) -> set[tuple[bytes, ...]]:
        w = words_of(text)
        return set(zip(*(w[j:] for j in range(k)))) if len(w) >= k else {tuple(w)} if w else set()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, right = None, set()
        for b in slices(batches):
            keep, common = [], []
            for i, (y, ta, tb) in enumerate(zip(b.column(1).to_pylist(), texts_of(b.column(2)), texts_of(b.column(3)))):
                if (y, tb) != at:  # a bucket's leader often comes many times in a row
                    at, right = (y, tb), shingles(tb)
                left = shingles(ta)
                both = len(left & right)
                if both and 100 * both >= percent * (len(left) + len(right) - both):
                    keep.append(i)
                    common.append(both)
            at_rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at_rows), b.column(1).take(at_rows), pa.array(common, pa.int64())], schema=to_arrow_schema(schema))

    return joined.mapInArrow(run, schema).distinct()


def _unconnected(members: DataFrame, reps: DataFrame, links: DataFrame, docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """bucket, rep, n, c (component so far) and u, for the buckets of three or more members that hold more than one component; the sets of all these.

    u counts the shingles of ``rep`` that none of these members outside its component has. They are in no intersection that
    could still connect it, so a pair has at most the smaller n - u in common, and members with too many are left out.
    """
    labels = components(links)
    labelled = members.select("bucket", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("c"))
    labelled = written(labelled, "labelled")
    mixed = written(labelled.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("size")).where("c0 <> c1 and size > 2").select("bucket"), "mixed")
    rest = written(labelled.join(mixed, "bucket"), "rest")
    nodes = written(rest.select("rep", "c").distinct().join(reps.select("rep", "n"), "rep"), "nodes")
    texts = docs.join(nodes, F.col("doc_id") == F.col("rep")).select("rep", "c", "text")
    schema = T.StructType([texts.schema["rep"], texts.schema["c"], T.StructField("h", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in slices(batches):
            sets = [shingle_hashes(words_of(t), k, known).view(np.int64) for t in texts_of(b.column(2))]
            yield with_columns(b, arrow, {"h": pa.array(sets, pa.list_(pa.int64())).cast(arrow.field("h").type)})

    sets = written(texts.mapInArrow(run, schema), "sets")
    shingles = sets.select("rep", "c", F.explode("h").alias("h"))
    alone = shingles.groupBy("h").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 = c1").select("h")
    own = shingles.join(alone, "h", "left_semi").groupBy("rep").agg(F.count("*").alias("u"))
    open_nodes = nodes.join(own, "rep", "left").select("rep", F.coalesce("u", F.lit(0)).alias("u"), "n").where(100 * (F.col("n") - F.col("u")) >= percent * F.col("n")).select("rep", "n", "u")
    return written(rest.join(written(open_nodes, "open"), "rep"), "left"), sets.select("rep", "h")


def _in_blocks(left: DataFrame, sets: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the components around each hub, found in blocks of at most about ``2 * BLOCK`` members.

    Of the members around a hub, those outside its most frequent component are dealt to blocks, and so are all; each block of
    the former meets each block of all. No pair is made outside a block, and a block returns no more links than it has members.
    """
    counts = left.groupBy("hub", "c").agg(F.count("*").alias("m")).groupBy("hub").agg(F.max(F.struct("m", "c"))["c"].alias("main"), F.max("m").alias("most"), F.sum("m").alias("size"))
    counts = written(counts.where("most < size").select("hub", "main", F.ceil((F.col("size") - F.col("most")) / BLOCK).cast("int").alias("few"), F.ceil(F.col("size") / BLOCK).cast("int").alias("all")), "blocks")
    rows = left.join(counts, "hub")

    def deal(side: int, mine: str, others: str) -> DataFrame:
        own = F.pmod(F.xxhash64("rep"), F.col(mine)).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col(others) - 1))
        out = rows.where(F.col("c") != F.col("main")) if side == 0 else rows
        return out.select("hub", (own if side == 0 else other).alias("i"), (other if side == 0 else own).alias("j"), F.lit(side).alias("side"), "rep", "n", "u", "delta", "beyond", "c")

    dealt = deal(0, "few", "all").union(deal(1, "all", "few"))
    full = dealt.join(sets, "rep").join(reps.select("rep", "n", "sig"), ["rep", "n"])
    bounds = least_matches(percent / 100)
    schema = T.StructType([T.StructField("a", left.schema["rep"].dataType), T.StructField("b", left.schema["rep"].dataType)])
    arrow = to_arrow_schema(schema)

    def run(t: pa.Table) -> pa.Table:
        rep, n, u, delta, beyond, side = (t.column(x).to_numpy() for x in ("rep", "n", "u", "delta", "beyond", "side"))
        sig = np.stack([np.frombuffer(x, np.uint32) for x in t.column("sig").to_pylist()])
        h = t.column("h").combine_chunks()
        flat, ends = h.flatten().to_numpy(), np.cumsum(np.append(0, h.value_lengths().to_numpy()))
        root = {c: c for c in t.column("c").to_pylist()}
        comp = t.column("c").to_pylist()

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        made: dict[int, set[int]] = {}

        def shingles(i: int) -> set[int]:
            if i not in made:
                made[i] = set(flat[ends[i] : ends[i + 1]].tolist())
            return made[i]

        right = np.flatnonzero(side == 1)
        links = []
        for i in np.flatnonzero(side == 0):
            both, shared = n[i] + n[right], np.minimum(n[i] - u[i], n[right] - u[right])
            differ = delta[i] + delta[right] - 2 * np.minimum(delta[i] - beyond[i], delta[right] - beyond[right])
            alive = right[(100 * shared >= percent * (both - shared)) & ((100 + percent) * differ <= (100 - percent) * both)]
            matches, done = np.zeros(len(alive), dtype=np.int64), 0
            for size, least in bounds:
                matches += (sig[alive, done:size] == sig[i, done:size]).sum(axis=1)
                keep = matches >= least
                alive, matches, done = alive[keep], matches[keep], size
            for j in alive.tolist():
                x, y = find(comp[i]), find(comp[j])
                if x != y:
                    common = len(shingles(i) & shingles(j))
                    if 100 * common >= percent * (n[i] + n[j] - common):
                        root[x] = y
                        links.append((max(rep[i], rep[j]), min(rep[i], rep[j])))
        return pa.Table.from_arrays([pa.array([p[k] for p in links], arrow.field(k).type) for k in (0, 1)], schema=arrow)

    return full.groupBy("hub", "i", "j").applyInArrow(run, schema).distinct()


def group(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles (long), component_id (the smallest id reachable) and kept (doc_id = component_id), a row for each row of ``df``."""
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    all_rows = written(sketches(docs, "doc_id", "text", k), "sketches")
    classes = written(all_rows.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("rep")), "classes")
    reps = all_rows.join(classes.where("rep is not null"), "set").where("doc_id = rep").select("rep", "set", "n", "sig").dropDuplicates(["rep", "set"])
    reps = written(reps.select("rep", "n", "sig"), "reps")

    bands = reps.select("rep", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.substring("sig", j * (4 * ROWS) + 1, F.lit(4 * ROWS)))).alias("band", "part")).select("rep", F.xxhash64("band", "part").alias("bucket"))
    # written first, so that both sides of the join are dealt anew and Spark can split a large bucket
    ends = written(bands.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high"), "ends")
    members = written(bands.join(ends, "bucket"), "members")
    led = members.select("rep", F.explode(F.array("low", "high")).alias("lead")).where("rep <> lead")
    tried = written(led.select(F.greatest("rep", "lead").alias("a"), F.least("rep", "lead").alias("b")).distinct(), "tried")
    links = written(_verified(written(_plausible(tried, reps, percent / 100), "plausible"), docs, k, percent), "links")

    # what the leaders leave unconnected: first each member with the hub of its bucket, then the rest member by member
    left, sets = _unconnected(members, reps, links, docs, k, percent)
    hub = left.groupBy("bucket").agg(F.min(F.struct((F.col("u") / F.col("n")).alias("share"), "rep", "n", "c")).alias("hub"))
    # written first, so that both sides of the join are dealt anew and Spark can split a large bucket
    left = written(left.join(written(hub, "hub"), "bucket").select("bucket", "rep", "n", "u", (F.col("c") == F.col("hub.c")).alias("kin"), F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n")), "left")
    spokes = left.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    spokes = written(_verified(spokes, docs, k, 0), "spokes")
    sizes = left.select("rep", "n").distinct()
    near = spokes.join(sizes.select(F.col("rep").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("rep").alias("b"), F.col("n").alias("nb")), "b")
    links = links.select("a", "b").union(written(near.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b"), "links"))
    labels = components(links)
    delta = F.when(F.col("rep") == F.col("hub"), 0).otherwise(F.col("n") + F.col("hub_n") - 2 * F.coalesce("common", F.lit(0)))
    # at least so many of the u shingles are outside the hub, which has none of them unless it is in rep's first component
    beyond = F.when(F.col("rep") == F.col("hub"), 0).when(F.col("kin"), F.greatest(F.col("u") - F.coalesce("common", F.lit(0)), F.lit(0))).otherwise(F.col("u"))
    left = left.join(spokes.select(F.col("a").alias("rep"), F.col("b").alias("hub"), "common"), ["rep", "hub"], "left").withColumn("delta", delta).withColumn("beyond", beyond)
    left = left.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("hub", "rep", "n", "u", "delta", "beyond", F.coalesce("component", "rep").alias("c")).distinct()
    left = written(left, "left")
    found = written(_in_blocks(left, sets, reps, percent), "found")
    links = links.union(written(_verified(found, docs, k, percent).select("a", "b"), "links"))
    final = components(links)

    named = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("set", F.coalesce("component", "rep").alias("component_id"))
    named = written(named, "named")
    out = all_rows.join(named, "set", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
