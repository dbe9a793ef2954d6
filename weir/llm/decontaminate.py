"""Benchmark decontamination by a prefix-filtered join.

A window is ``WINDOW`` consecutive words of a benchmark item, or the whole item if it has fewer. The tokens of a window are
ordered by rarity in the whole corpus; its rarest one is a necessary prefix: a text that holds the window holds that token,
so only texts' words equal to such keys are joined. Length and position then bound what can match (the window must lie within
the text), and the words of the window are compared with those of the text. All of it is DataFrame operations.

The keys and items are broadcast if the benchmark has at most ``MAX_BROADCAST_WORDS`` words, else the join is shuffled with the words around each key.
Words are runs of characters of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` of the text with A-Z lower-cased. Null and empty texts have no words and are clean. Repeated
rows get the same result each; rows with one id and unlike texts are judged apart. Other columns pass through,
but for those named as the new ones, in any case, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, written

WINDOW = 13
#: About 3 MB of words; a larger benchmark is joined by shuffling.
MAX_BROADCAST_WORDS = 100_000
#: Fixed values.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS, -1), "")


def _keys(docs_words: DataFrame, items: DataFrame, small: bool) -> DataFrame:
    """Rows of key, item_id, at (the key's position in the item), words (of the item), size (of its windows), starts (of the windows whose key this is)."""
    hint = F.broadcast if small else lambda x: x
    vocabulary = items.select(F.explode("words").alias("word")).distinct()
    counts = docs_words.select(F.explode(F.array_distinct("words")).alias("word")).join(hint(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
    counts = written(counts, "rarity")
    # each word of an item with its rarity, in order; then the rarest of each window, the first of equal ones
    placed = items.select("item_id", "item", "words", "size", F.posexplode("words").alias("at", "word")).join(hint(counts), "word", "left")
    ranked = placed.groupBy("item", "item_id", "words", "size").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n")))).alias("n"))
    rarest = F.transform(F.sequence(F.lit(0), F.size("words") - F.col("size")), lambda s: F.struct(s.alias("start"), F.array_min(F.transform(F.slice("n", s + 1, F.col("size")), lambda x: F.struct(x["n"].alias("n"), x["at"].alias("at"))))["at"].alias("at")))
    windows = ranked.select("item", "item_id", "words", "size", F.explode(rarest).alias("w"))
    keys = windows.groupBy("item", "item_id", "words", "size", F.col("w.at").alias("at")).agg(F.collect_list("w.start").alias("starts"))
    return written(keys.select(F.get("words", F.col("at")).alias("key"), "item_id", "at", "words", "size", "starts"), "keys")


def find(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``df`` with n_words, n_hit, n_items (long), items (sorted ids, joined by commas) and contaminated (boolean)."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), words_of(item_text).alias("words"))
    items = written(items.where(F.size("words") > 0).distinct().select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words", F.least(F.size("words"), F.lit(WINDOW)).alias("size")), "items")
    small = (items.agg(F.sum(F.size("words"))).first()[0] or 0) <= MAX_BROADCAST_WORDS
    own = df.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_th"), words_of(text).alias("words"))
    keys = _keys(own.select("words"), items, small)
    if small:
        # a key's place with the words that a window over it can reach; never a row for each word, nor a text in more than one row
        known = [r[0] for r in keys.select("key").distinct().collect()]
        reach = WINDOW - 1
        places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda k: F.get("words", k).isin(known))
        around = F.transform(places, lambda k: F.struct(k.alias("pos"), F.least(k, F.lit(reach)).alias("lead"), F.get("words", k).alias("word"), F.slice("words", F.greatest(k - reach, F.lit(0)) + 1, F.lit(2 * reach + 1)).alias("have")))
        near = own.where(F.size("words") > 0).select("_id", "_th", F.explode(around).alias("d")).select("_id", "_th", "d.*")
        near = near.join(F.broadcast(keys), F.col("word") == F.col("key")).drop("word", "key")
    else:
        # the words are joined alone, and the texts with what that leaves
        placed = own.select(F.col("_id"), F.col("_th"), F.posexplode("words").alias("pos", "word")).join(keys, F.col("word") == F.col("key"))
        placed = placed.groupBy("_id", "_th").agg(F.collect_set(F.struct("pos", F.col("pos").alias("lead"), "item_id", "at", F.col("words").alias("item_words"), "size", "starts")).alias("d")).alias("p")
        near = own.alias("o").join(placed, F.col("o._id").eqNullSafe(F.col("p._id")) & (F.col("o._th") == F.col("p._th"))).select("o._id", "o._th", F.col("o.words").alias("have"), F.explode("p.d").alias("d")).select("_id", "_th", "have", "d.*").withColumnRenamed("item_words", "words")

    def matches(s: Column) -> Column:
        first = F.col("lead") - F.col("at") + s
        within = (first >= 0) & (first + F.col("size") <= F.size("have"))
        return F.when(within, F.slice("have", F.greatest(first, F.lit(0)) + 1, F.col("size")) == F.slice("words", s + 1, F.col("size"))).otherwise(False)

    found = near.select("_id", "_th", "item_id", "size", F.transform(F.filter("starts", matches), lambda s: s + F.col("pos") - F.col("at")).alias("starts")).where(F.size("starts") > 0)
    hits = found.groupBy("_id", "_th").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.col("size") - 1))))))).alias("n_hit"),
        F.array_sort(F.collect_set("item_id")).alias("items"),
    )
    base, name = apart(df, doc_id, text)
    base = base.withColumns({"_th": F.xxhash64(name[text]), "_n": F.size(words_of(name[text])).cast("long")}).alias("d")
    out = base.join(hits.alias("h"), F.col(f"d.{name[doc_id]}").eqNullSafe(F.col("h._id")) & (F.col("d._th") == F.col("h._th")), "left")
    new = ("n_words", "n_hit", "n_items", "items", "contaminated")
    n_hit = F.coalesce(F.col("h.n_hit"), F.lit(0)).cast("long")
    return out.select(
        *(F.col(f"d.c{k}").alias(c) for k, c in enumerate(df.columns) if c.lower() not in new),
        F.col("d._n").alias("n_words"),
        n_hit.alias("n_hit"),
        F.when(F.col("h.items").isNull(), 0).otherwise(F.size("h.items")).cast("long").alias("n_items"),
        F.coalesce(F.array_join("h.items", ","), F.lit("")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("d._n"))).alias("contaminated"),
    )
