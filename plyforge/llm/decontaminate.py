"""Benchmark contamination by a prefix-filtered join of shingles, in DataFrame operations only.

Every benchmark window (13 consecutive item words; a shorter item is one window)
is a set of shingles with places. All of them must occur for the window to
occur, so a prefix of one token suffices. A first pass over the documents counts
how often each of the benchmark's shingles occurs, and nothing else: counts are
summed before they are shuffled. Shingles are ordered by these numbers and each
window joins by its rarest one alone; a window with a shingle that no document
has is gone before the join. In a second pass only these prefix shingles meet
the documents. A match fixes where the window would lie; one that would leave
the document falls to the positional and length bounds, and for the rest the
document's words there must be the window's words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize

UPPER, LOWER = (bytes(range(a, a + 26)).decode() for a in (65, 97))
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; a null text has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lowered = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(lowered, GAPS), "")


def shingle_at(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(words, at + i) for i in range(size)])


def shingles(words: str, size: int, last: Column) -> Column:
    """The shingles that begin at 0 ... last."""
    return F.transform(F.sequence(F.lit(0), last), lambda i: shingle_at(F.col(words), i, size))


def row_keys(key: str, text: str) -> list[Column]:
    """Two hashes of key and text, together 96 bits: equal rows share them and their result."""
    return [F.xxhash64(F.col(key), F.col(text)).alias("k1"), F.hash(F.col(key), F.col(text), F.lit(1)).alias("k2")]


def windows_of(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """(item, window): each item's distinct windows; items without words have none."""
    words = benchmark.select(F.col(item).alias("item"), words_of(F.col(text)).alias("words")).withColumn("n", F.size("words")).filter("n > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - window, F.lit(0)))
    return words.select("item", F.explode(F.transform(starts, lambda s: F.slice(F.col("words"), s + 1, window))).alias("window")).distinct()


def blocks(df: DataFrame, hash_column: str, most: int) -> list[DataFrame]:
    """df for broadcast joins: whole if it has at most `most` rows, else in that many blocks by hash."""
    parts = -(-df.count() // most)
    return [F.broadcast(df if parts < 2 else df.filter(F.pmod(F.col(hash_column), F.lit(parts)) == i)) for i in range(parts)]


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def places_of(texts: DataFrame, size: int) -> DataFrame:
    """(k1, k2, words, pos, token) of each place of a text's shingles."""
    # The outer form: for the inner one Spark infers a filter on the array and computes the words anew for each of its places.
    each = texts.filter(F.size("words") >= size).select("k1", "k2", "words", F.posexplode_outer("words").alias("pos", "word"))
    return each.filter(F.col("pos") + size <= F.size("words")).select("k1", "k2", "words", "pos", shingle_at(F.col("words"), F.col("pos"), size).alias("token"))


def counts_of(texts: DataFrame, tokens: DataFrame, sizes: list[int], most_broadcast: int) -> DataFrame:
    """(token, n): how often each of the benchmark's tokens occurs in all documents."""
    found = union([places_of(texts, s).select("token").join(b, "token") for b in blocks(tokens.select("token").distinct(), "token", most_broadcast) for s in sizes])
    return found.groupBy("token").agg(F.count("*").alias("n"))


def occurrences(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str, window: int, shingle: int, most_broadcast: int) -> tuple[DataFrame, DataFrame]:
    """(k1, k2, start, length, wid) of each window occurrence, and (wid, item)."""
    windows = windows_of(benchmark, item, item_text, window)
    named = windows.select("window").distinct().withColumn("wid", F.monotonically_increasing_id())
    named = materialize(named, "windows")
    items = materialize(windows.join(named, "window").select("wid", "item"), "items")
    length = F.size("window")
    # The sizes of shingles: the usual one, and those of windows that are shorter.
    sizes = sorted({r[0] for r in named.select(F.least(length, F.lit(shingle))).distinct().collect()})
    nothing = docs.limit(0).select(*row_keys(key, text), F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit(0).cast("long").alias("wid"))
    if not sizes:
        return nothing, items
    each = [
        named.filter((length >= shingle) if s == shingle else (length == s)).select("wid", F.posexplode(shingles("window", s, length - s)).alias("off", "token"))
        for s in sizes
    ]
    tokens = materialize(union(each), "tokens")
    texts = docs.select(*row_keys(key, text), words_of(F.col(text)).alias("words"))
    rarity = materialize(counts_of(texts, tokens, sizes, most_broadcast), "rarity")
    # The prefix: the rarest shingle of each window, unless one does not occur at all.
    ranked = tokens.join(rarity, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    prefix = ranked.groupBy("wid").agg(F.min_by(F.struct("token", "off"), F.struct("n", "token", "off")).alias("p"), F.min("n").alias("n")).filter("n > 0")
    prefix = materialize(prefix.join(named, "wid").select("wid", "window", length.alias("length"), "p.token", "p.off"), "prefix")
    begin = F.col("pos") - F.col("off")
    fits = (begin >= 0) & (begin + F.col("length") <= F.size("words"))
    same = F.slice("words", F.greatest(begin, F.lit(0)) + 1, F.col("length")) == F.col("window")
    met = [places_of(texts, s).join(b, "token").filter(fits & same).select("k1", "k2", begin.alias("start"), "length", "wid") for b in blocks(prefix, "token", max(1, most_broadcast // 5)) for s in sizes]
    return union(met) if met else nothing, items


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, shingle: int = 3, share: int = 20, most_broadcast: int = 1_000_000) -> DataFrame:
    """One row a document: (key, n_words, n_hit, n_items, items_sha256, contaminated).

    n_hit counts the document's words inside any occurrence of any window,
    n_items the items with an occurring window; contaminated where n_hit > 0
    and share * n_hit >= n_words. Null and empty texts, and those without
    words, have zeros and the digest of the empty string. Rows of equal key
    are judged by their own texts. Items without words match nothing, items
    of equal id count once, and a null id not at all. An empty benchmark hits
    nothing. The benchmark is broadcast in blocks: of most_broadcast shingles
    to count, of a fifth as many windows to match. Each block past the first
    costs another pass over the documents.
    """
    return judged(docs, benchmark, key, text, item, item_text, window, shingle, share, most_broadcast).drop("k1", "k2").withColumnRenamed("key", key)


def judged(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str = "item_id", item_text: str = "text", window: int = 13, shingle: int = 3, share: int = 20, most_broadcast: int = 1_000_000) -> DataFrame:
    """contamination()'s columns, the key's as `key`, with the row's two hashes as k1 and k2."""
    found, windows = occurrences(docs, benchmark, key, text, item, item_text, window, shingle, most_broadcast)
    hits = materialize(found.distinct(), "hits")
    spans = hits.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"))
    end = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("end")),
        lambda acc, x: F.struct(
            (acc["hit"] + F.greatest(F.lit(0), x["start"] + x["length"] - F.greatest(acc["end"], x["start"]))).alias("hit"),
            F.greatest(acc["end"], x["start"] + x["length"]).alias("end"),
        ),
    )
    items = hits.select("k1", "k2", "wid").distinct().join(windows.select("wid", "item"), "wid").groupBy("k1", "k2")
    items = items.agg(F.array_sort(F.transform(F.collect_set("item"), lambda x: x.cast("string"))).alias("items"))
    about = spans.select("k1", "k2", end["hit"].alias("n_hit")).join(items, ["k1", "k2"])
    rows = docs.select(F.col(key).alias("key"), *row_keys(key, text), F.size(words_of(F.col(text))).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.join(about, ["k1", "k2"], "left").select(
        "key", "n_words", n_hit.alias("n_hit"),
        F.coalesce(F.when(F.col("items").isNotNull(), F.size("items").cast("long")), F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), "k1", "k2",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns, whatever they are called.

    Nulls, repeats and empty tables as in contamination().
    """
    bad = judged(docs, benchmark, key, text, **more).filter("contaminated").select("k1", "k2").distinct()
    marked = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *row_keys(key, text))
    return marked.join(bad, ["k1", "k2"], "left_anti").select("row.*")
