"""How far the sources of a language differ in their words: exact sums of |p - q| over all kept terms, split into heavy and light.

A group is a language and a source, and p its smoothed share of a term, a whole
number. A group that lacks a term has its floor f there. Over all V kept terms,

    sum |p - q|  =  V |f_g - f_h|  +  sum over terms that g or h has of (|p - q| - |f_g - f_h|).

Heavy terms, which many groups have, are dense numpy tiles: rows are groups,
columns terms, and a tile's sums are taken row by row. Light terms have short
posting lists. A light term that g alone has adds |p_g - f_h| - |f_g - f_h|,
which depends on p_g and h only, so each group's light terms are a histogram of
their values that meets the floors; what that says twice or wrongly for terms
that both have is corrected for each pair of a posting list. All parts are whole
numbers, and are added up as such.

Groups of a language are dealt into tiles of TILE, terms into blocks of BLOCK,
so a task holds two tiles' groups and one block's terms whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import batches_of, materialize, runs, text_column

GAPS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UNIT = 1_000_000_000  # p's whole
TILE, BLOCK = 128, 512
MOST_LIGHT = 32  # no posting list of a light term is longer


def terms_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All terms of texts without nulls, A-Z lower-cased, and the text of each."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), GAPS)
    terms = lists.flatten()
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.not_equal(terms, "")
    return terms.filter(full).dictionary_encode(), text[full.to_numpy(zero_copy_only=False)]


def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of a batch of (lang, source, text): occurrences and texts with the term; a null term's docs count all texts."""
    lang, source = (batch.column(i).dictionary_encode() for i in (0, 1))
    sources = len(source.dictionary)
    group = lang.indices.to_numpy().astype(np.int64) * sources + source.indices.to_numpy()
    terms, text = terms_of(text_column(batch))
    width, code = max(len(terms.dictionary), 1), terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key, n = np.unique(text * width + code, return_counts=True)  # a text's distinct terms
    key = group[key // width] * width + key % width
    key, place, docs = np.unique(key, return_inverse=True, return_counts=True)
    total = np.bincount(place, n, len(key)).astype(np.int64)
    each, rows = np.unique(group, return_counts=True)
    at = np.concatenate([key // width, each])
    names = pa.concat_arrays([terms.dictionary.take(pa.array(key % width)), pa.nulls(len(each), terms.dictionary.type)])
    own = [lang.dictionary.take(pa.array(at // sources)), source.dictionary.take(pa.array(at % sources))]
    return pa.RecordBatch.from_arrays([*own, names, pa.array(np.concatenate([total, np.zeros(len(each), np.int64)])), pa.array(np.concatenate([docs, rows]))], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, docs), each once, nulls read as ''; a group's row of a null term counts its documents."""
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in runs(batch.column(2)):
                yield counted(batch.slice(a, b - a))

    with batches_of(docs.sparkSession):
        parts = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
        return materialize(parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")


def share(n: str, total: str) -> str:
    """1 + floor(UNIT (n + 5) / (total + 5 V)) in SQL, exact whatever the counts."""
    return f"1 + cast(cast({UNIT} as decimal(20, 0)) * cast({n} + 5 as decimal(18, 0)) div cast({total} + 5 * v as decimal(20, 0)) as long)"


def kept_terms(counts: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, source, v, total, floor) of every group, (lang, term, q, n_groups) of kept terms and (lang, source, term, n, p) where a group has one."""
    whole = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs"), F.count("*").alias("n_groups"))
    whole = materialize(whole.filter(F.col("docs") >= least_docs).drop("docs"), "kept")
    # a row a language: written, so that Spark knows its size and broadcasts it if it is small
    langs = materialize(whole.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("all_total")), "langs")
    found = materialize(counts.filter("term is not null").select("lang", "source", "term", "n").join(whole.select("lang", "term"), ["lang", "term"]), "found")
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "v", "all_total"])
    groups = materialize(groups.withColumn("floor", F.when(F.col("v") > 0, F.expr(share("0", "total")))), "groups")
    terms = whole.join(langs, "lang").select("lang", "term", "n_groups", F.expr(share("all_n", "all_total")).alias("q"))
    return groups, terms, found


def tile_sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums over one block of terms for the groups of two tiles (a, b): rows (lang, a, b, g, h, value), once a pair.

    Rows are groups (kind 0: floor p; n is V in block 0, else 0), heavy terms
    (kind 1: share p of a term) and light values (kind 2: share p of n terms).
    Terms that no group of both tiles has count by their floors, as light ones do.
    """
    lang, a, b, _ = key
    is_group = pdf["kind"].to_numpy() == 0
    names, tile = pdf["source"].to_numpy()[is_group], pdf["tile"].to_numpy()[is_group]
    order = np.argsort(names, kind="stable")
    names, tile = names[order], tile[order]
    floor, v = pdf["p"].to_numpy()[is_group][order], int(pdf["n"].to_numpy()[is_group].max())
    place = {s: i for i, s in enumerate(names)}
    heavy = pdf[pdf["kind"] == 1]
    column, terms = pd.factorize(heavy["term"])
    dense = np.repeat(floor[:, None], len(terms), axis=1)
    dense[[place[s] for s in heavy["source"]], column] = heavy["p"].to_numpy()
    hist = {s: (x["p"].to_numpy(), x["n"].to_numpy()) for s, x in pdf[pdf["kind"] == 2].groupby("source")}
    out = []
    for i in np.flatnonzero(tile == a):
        to = np.flatnonzero((tile == b) & ((a != b) | (np.arange(len(names)) > i)))
        if not len(to):
            continue
        base = np.abs(floor[i] - floor[to])
        value = np.abs(dense[i] - dense[to]).sum(axis=1) + (v - len(terms)) * base
        for g, others in ((i, to), *((j, None) for j in to)):
            p, n = hist.get(names[g], (np.zeros(0, np.int64),) * 2)
            if others is not None:
                value += (n[:, None] * (np.abs(p[:, None] - floor[others]) - np.abs(floor[g] - floor[others]))).sum(axis=0)
            else:
                value[np.searchsorted(to, g)] += int((n * (np.abs(p - floor[i]) - abs(floor[g] - floor[i]))).sum())
        out.append((np.full(len(to), names[i], object), names[to], value))
    if not out:
        return frame(lang, *(np.zeros(0, k) for k in (object, object, np.int64)))
    return frame(lang, *(np.concatenate(c) for c in zip(*out, strict=True)))


def frame(lang, g: np.ndarray, h: np.ndarray, value: np.ndarray) -> pd.DataFrame:
    lang = lang if isinstance(lang, np.ndarray) else np.full(len(g), lang, object)
    return pd.DataFrame({"lang": pd.Series(lang, dtype=object), "g": pd.Series(g, dtype=object), "h": pd.Series(h, dtype=object), "value": value})


def posting_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Corrections (lang, g, h, value), summed within a batch, for the pairs of each light term's posting list (sources, p, floor)."""
    for batch in batches:
        lang, g, h, value = [], [], [], []
        for row in batch.itertuples(index=False):
            order = np.argsort(np.asarray(row.sources, object), kind="stable")
            p, f, s = np.asarray(row.p)[order], np.asarray(row.floors)[order], np.asarray(row.sources, object)[order]
            i, j = np.triu_indices(len(s), 1)
            # both have it: one term's true difference, less what the histograms of both have added and one floor's
            right, base = np.abs(p[i] - p[j]), np.abs(f[i] - f[j])
            value.append(right - base - (np.abs(p[i] - f[j]) - base) - (np.abs(p[j] - f[i]) - base))
            lang.append(np.full(len(i), row.lang, object))
            g.append(s[i])
            h.append(s[j])
        if lang:
            yield frame(*(np.concatenate(c) for c in (lang, g, h, value))).groupby(["lang", "g", "h"], as_index=False)["value"].sum()


def pair_values(groups: DataFrame, terms: DataFrame, shares: DataFrame, heavy_share: float) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of a language's groups. shares: (lang, source, term, p, floor)."""
    sizes = materialize(groups.groupBy("lang").agg(F.count("*").alias("n")), "sizes")
    tiles = F.ceil(F.col("n") / TILE).cast("int").alias("tiles")
    # a light term's list is short, and short next to the number of groups
    heavy = F.col("n_groups") > F.greatest(F.lit(1), F.least(F.lit(MOST_LIGHT), F.floor(F.col("n") * heavy_share)))
    told = terms.join(sizes, "lang").select("lang", "term", heavy.alias("heavy"), "n")
    dense = F.sum(F.col("heavy").cast("long"))
    blocks = materialize(told.groupBy("lang").agg(F.greatest(F.ceil(dense / BLOCK), F.lit(1)).cast("int").alias("blocks")), "blocks")
    told = told.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    tile = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("tile")
    about = groups.filter("v > 0").join(sizes.select("lang", tiles), "lang").join(blocks, "lang").select("lang", "source", "floor", "tiles", tile, "v", "blocks")
    own = shares.join(told, ["lang", "term"]).join(sizes.select("lang", tiles), "lang").select("lang", "source", "term", "p", "floor", "heavy", "block", "tiles", tile)
    own = materialize(own, "shares")
    none, no_term = F.lit(0).cast("long"), F.lit(None).cast("string").alias("term")
    rows = about.select("lang", "source", "tiles", "tile", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "v", F.col("floor").alias("p"))
    rows = rows.select("lang", "source", "tiles", "tile", "block", F.lit(0).alias("kind"), no_term, "p", F.when(F.col("block") == 0, F.col("v")).otherwise(none).alias("n"))
    dense = own.filter("heavy").select("lang", "source", "tiles", "tile", "block", F.lit(1).alias("kind"), "term", "p", none.alias("n"))
    light = own.filter("not heavy").groupBy("lang", "source", "tiles", "tile", "p").agg(F.count("*").alias("n")).select("lang", "source", "tiles", "tile", F.lit(0).alias("block"), F.lit(2).alias("kind"), no_term, "p", "n")
    # each tile meets itself and every other once: as (a, b), a <= b
    every = rows.unionByName(dense).unionByName(light).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    every = every.select("lang", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "block", "source", "tile", "kind", "term", "p", "n")
    schema = "lang string, g string, h string, value long"
    parts = every.groupBy("lang", "a", "b", "block").applyInPandas(tile_sums, schema)
    lists = own.filter("not heavy").groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "floor")).alias("l")).filter(F.size("l") > 1)  # MOST_LIGHT at most
    lists = lists.select("lang", F.col("l.source").alias("sources"), F.col("l.p").alias("p"), F.col("l.floor").alias("floors"))
    each = parts.unionByName(lists.mapInPandas(posting_pairs, schema))
    each = each.select("lang", F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h"), "value").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    bare = groups.filter("v = 0").select("lang", F.col("source").alias("g"))
    bare = bare.join(bare.withColumnRenamed("g", "h"), "lang").filter("g < h").select("lang", "g", "h", none.alias("value"))
    both = materialize(each.unionByName(bare), "pairs")
    return both.select("lang", F.col("g").alias("source"), F.col("h").alias("item"), "value").unionByName(both.select("lang", F.col("h").alias("source"), F.col("g").alias("item"), "value"))


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 30, most_terms: int = 50, heavy_share: float = 0.25) -> DataFrame:
    """(lang, source, part, item, value, rank): how far every group of `docs` is from each other of its language, and its most telling terms.

    A language keeps the terms that least_docs of its rows have, V in number.
    Part `pair`: each other source and the sum of |p - q| over the kept terms,
    all ranks. Part `term`: the group's kept terms with p over the language's q,
    and p - q, the most_terms first. Ranks count from 1, larger values first,
    ties by the item's bytes. A term is heavy if more than heavy_share of the
    language's groups have it, or more than MOST_LIGHT of them; the result does
    not depend on it. Null texts, languages and sources count as ''; repeated
    rows count each; a group without terms has the floor everywhere, and in a
    language without kept terms all pairs are at 0. A language of one source has
    no pairs, an empty table no rows; other columns take no part.
    """
    groups, terms, found = kept_terms(term_counts(docs, text, lang, source), least_docs)
    shares = found.join(groups.select("lang", "source", "v", "total", "floor"), ["lang", "source"]).select("lang", "source", "term", F.expr(share("n", "total")).alias("p"), "floor")
    terms, shares = materialize(terms, "q"), materialize(shares, "p")
    order = lambda first: Window.partitionBy("lang", "source").orderBy(F.desc("value"), first)
    pairs = pair_values(groups, terms, shares, heavy_share).withColumn("rank", F.row_number().over(order("item")))
    told = shares.join(terms.select("lang", "term", "q"), ["lang", "term"]).filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    told = told.withColumn("rank", F.row_number().over(order("item"))).filter(F.col("rank") <= most_terms)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(told, "term"))
