"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Pairs are proposed by prefixes: in one order of all shingles (common ones last),
two sets of a and b shingles with similarity s share one at least among the
first n - ceil(s n) + 1 of each, so no pair is lost there. Each set has a SimHash
fingerprint with a row of the pivot table, its distances to fixed references;
proposals whose largest coordinate difference is over `radius` are discarded
unseen, then those over `radius` bits: at similarity 0.8 two fingerprints differ
by 9.7 bits on average with a deviation of 2.9. Of 100,000 random pairs of sets
of nine and more shingles none was over 24 bits, but 10 of sets of four and five:
sets under SMALL shingles are never discarded by bits. What survives is verified
on the sets, which tasks read from flat files in the shared folder. A group
gives links that span it, not all its pairs. Groups over max_group are dealt by
pairs of blocks, which loses none: their rows grow with the square of the group.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import batches_of, frugal, gather, join_by_key, map_file, materialize, runs, scratch, small, split_words, text_column, write_file
from .components import components
from .simhash import BIT, pivot_table
from .token_store import mix

SMALL = 16  # sets of fewer shingles are compared whatever their fingerprints
HOT = 20_000  # rows of a shingle from which on its group is dealt by a count from a sample


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes in order, and n + 1 offsets; a text of fewer words is one shingle."""
    words, ends = split_words(pc.ascii_lower(texts))
    coded, digest = words.dictionary_encode(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w, 0) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    each = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.uint64)
    n_words = np.diff(ends)
    n = np.where(n_words > 0, np.maximum(n_words - width + 1, 1), 0)
    doc = np.repeat(np.arange(len(n)), n)
    first = gather(ends[:-1], n)
    last, h = ends[doc + 1], np.zeros(len(doc), np.uint64)
    for k in range(width):
        inside = first + k < last
        h[inside] = mix(h[inside] ^ each[first[inside] + k], k + 1)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
        h, doc = h[new], doc[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(n)))]).astype(np.int64)


def file_sets(texts: pa.Array, width: int, most_bytes: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """shingle_sets of a file's texts, made from a megabyte of text at a time: sorting takes many times a text's size."""
    each = [shingle_sets(texts[x:y], width) for x, y in runs(texts, most_bytes)]
    n = np.concatenate([np.diff(ends) for _, ends in each])
    return np.concatenate([grams for grams, _ in each]), np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def set_fingerprints(grams: np.ndarray, ends: np.ndarray, step: int = 50_000) -> np.ndarray:
    """64-bit SimHash of each set; 0 for an empty one."""
    n = np.diff(ends)
    doc, votes = np.repeat(np.arange(len(n)), n), np.zeros((len(n), 64), np.int64)
    for k in range(0, len(grams), step):
        bits = np.unpackbits(grams[k : k + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        d = doc[k : k + step]
        starts = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        votes[d[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return ((2 * votes > n[:, None]) * BIT).sum(axis=1, dtype=np.uint64)


@lru_cache(maxsize=8)
def _file(name: str) -> np.ndarray:
    return map_file(name, "<u8")


def grams_at(path: str, file: int, start: int, n: int) -> np.ndarray:
    return np.array(_file(f"{path}/{file:016x}.grams")[start : start + n]) if n else np.empty(0, np.uint64)


def with_set(docs: DataFrame, path: str, key: str, text: str, width: int) -> DataFrame:
    """(key, set, file, start, n, fp) of each row; equal sets have equal `set`. The shingles go to files below path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch, "text")
            for a, b in runs(texts):
                grams, ends = file_sets(texts[a:b], width)
                raw, file = grams.astype("<u8").tobytes(), uuid.uuid4().int >> 65
                write_file(f"{path}/{file:016x}.grams", [raw])
                cut = (8 * ends).tolist()
                sets = np.fromiter((xxhash.xxh64_intdigest(raw[x:y], 7) for x, y in zip(cut, cut[1:], strict=False)), np.uint64, b - a)
                cols = [sets.view(np.int64), np.full(b - a, file), ends[:-1], np.diff(ends), set_fingerprints(grams, ends).view(np.int64)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *map(pa.array, cols)], ["key", "set", "file", "start", "n", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(frugal(run), f"key {kind}, set long, file long, start long, n long, fp long")


def shingles(items: DataFrame, path: str, similarity: float | None = None, common: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(h, set): all shingles of the sets, or those of the prefixes in which a pair of the similarity must meet.

    common: sorted shingles that are last in the order, and how common each is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for row, (s, file, start, n) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                h = grams_at(path, file, start, n)
                if similarity is not None:
                    h = h[: prefix(n, similarity)] if not len(common[0]) else in_order(h, *common)[: prefix(n, similarity)]
                out.append((h, s))
                size += len(h)
                if size > 500_000 or row == batch.num_rows - 1:
                    flat = np.concatenate([x for x, _ in out]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(np.array([x for _, x in out]), [len(x) for x, _ in out]))], ["h", "set"])
                    out, size = [], 0

    return items.select("set", "file", "start", "n").orderBy("file").mapInArrow(frugal(run), "h long, set long")


def prefix(n: int, similarity: float) -> int:
    return n - int(np.ceil(similarity * n - 1e-9)) + 1


def in_order(h: np.ndarray, known: np.ndarray, share: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return h[np.lexsort((h, np.where(known[at] == h, share[at], 0)))]


def coords_of(t: pa.Table) -> np.ndarray:
    return np.frombuffer(t["coords"].combine_chunks().flatten().to_numpy(zero_copy_only=False).tobytes(), np.int8).reshape(t.num_rows, -1)


def group_links(grams: list[np.ndarray], fp: np.ndarray, coords: np.ndarray, side: np.ndarray | None, similarity: float, radius: int) -> tuple[list[int], list[int]]:
    """Pairs of places that connect all of a group within similarity; where `side` is given, only pairs over two sides."""
    n = np.array([len(g) for g in grams])
    by_n = np.argsort(n, kind="stable")
    n, fp, coords = n[by_n], fp[by_n], coords[by_n]
    side = None if side is None else side[by_n]
    _, codes = np.unique(np.concatenate([grams[k] for k in by_n]), return_inverse=True)
    ends, label = np.concatenate([[0], np.cumsum(n)]), np.arange(len(n))
    flag, a, b = np.zeros(codes.max(initial=0) + 1, bool), [], []
    stop = np.searchsorted(n, n / similarity + 1e-9, side="right")
    for i in range(len(n) - 1):
        span = slice(i + 1, int(stop[i]))
        near = label[span] != label[i]
        if side is not None:
            near &= side[span] != side[i]
        j = np.flatnonzero(near) + i + 1
        if n[i] >= SMALL:  # the smaller of both
            j = j[np.abs(coords[j] - coords[i]).max(axis=1) <= radius] if len(j) else j
            j = j[np.bitwise_count(fp[j] ^ fp[i]) <= radius]
        if not len(j):
            continue
        mine = codes[ends[i] : ends[i + 1]]
        flag[mine] = True
        both = np.add.reduceat(flag[codes[gather(ends[j], n[j])]], np.cumsum(n[j]) - n[j], dtype=np.int64)
        flag[mine] = False
        for k in j[both >= similarity * (n[i] + n[j] - both) - 1e-9].tolist():
            if label[k] != label[i]:
                label[label == label[k]] = label[i]
                a.append(int(by_n[i]))
                b.append(int(by_n[k]))
    return a, b


def sorted_links(batches: Iterator[pa.RecordBatch], path: str, similarity: float, radius: int, wide: int = 24) -> Iterator[pa.RecordBatch]:
    """Links (a, b) in the groups of rows (h, low, high, side, set, file, start, n, fp, coords) that come sorted by h, low and high."""
    parent, failed = {}, set()

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def solve(t: pa.Table) -> pa.RecordBatch:
        h, low, high, side, name, file, start, n, fp = (t[c].to_numpy() for c in ("h", "low", "high", "side", "set", "file", "start", "n", "fp"))
        fp, coords, out = fp.view(np.uint64), coords_of(t), []
        if max(len(parent), len(failed)) > 1_000_000:
            parent.clear()
            failed.clear()

        def join(i: int, j: int) -> None:
            x, y = root(int(name[i])), root(int(name[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((max(int(name[i]), int(name[j])), min(int(name[i]), int(name[j]))))

        begin = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
        sizes = np.diff(np.concatenate([begin, [len(h)]]))
        size, ends = np.repeat(sizes, sizes), np.repeat(begin + sizes, sizes)
        pairs = []
        for k in range(1, wide):
            i = np.flatnonzero((size <= wide) & (np.arange(len(h)) + k < ends))
            if not len(i):
                break
            i = i[(np.minimum(n[i], n[i + k]) >= similarity * np.maximum(n[i], n[i + k]) - 1e-9) & ((low[i] == high[i]) | (side[i] != side[i + k]))]
            few = np.minimum(n[i], n[i + k]) < SMALL
            i, few = (x[few | (np.abs(coords[i] - coords[i + k]).max(axis=1) <= radius)] for x in (i, few)) if len(i) else (i, few)
            i = i[few | (np.bitwise_count(fp[i] ^ fp[i + k]) <= radius)]
            pairs.append(np.stack([i, i + k], axis=1))
        for i, j in np.concatenate(pairs).tolist() if pairs else []:
            pair = (min(name[i], name[j]), max(name[i], name[j]))
            if pair in failed or root(int(name[i])) == root(int(name[j])):
                continue
            both = len(np.intersect1d(grams_at(path, int(file[i]), start[i], n[i]), grams_at(path, int(file[j]), start[j], n[j]), assume_unique=True))
            if both >= similarity * (n[i] + n[j] - both) - 1e-9:
                join(i, j)
            else:
                failed.add(pair)
        for s, m in zip(begin[sizes > wide].tolist(), sizes[sizes > wide].tolist(), strict=True):
            grams = [grams_at(path, int(file[k]), start[k], n[k]) for k in range(s, s + m)]
            for i, j in zip(*group_links(grams, fp[s : s + m], coords[s : s + m], None if low[s] == high[s] else side[s : s + m], similarity, radius), strict=True):
                join(s + i, s + j)
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        keys = [t[c].to_numpy() for c in ("h", "low", "high")]
        last = np.ones(t.num_rows, bool)
        for c in keys:
            last &= c == c[-1]
        cut = t.num_rows - int(last.sum())
        if cut:
            yield solve(t.slice(0, cut))
        held = t.slice(cut)
    if held is not None:
        yield solve(held)


def links(items: DataFrame, path: str, similarity: float = 0.8, radius: int = 24, max_group: int = 1000, sampled: int = 5_000, pivots: int = 16) -> DataFrame:
    """Links (a, b), a > b, between sets, with the components of all pairs of the similarity.

    items: distinct set with file, start, n and fp. Which shingles are common is
    learned from about `sampled` sets; the driver gets at most 50,000 of them.
    """
    share = max(1, items.count() // sampled)
    some = shingles(items.filter(F.pmod(F.xxhash64("set"), F.lit(share)) == 0), path)
    counted = some.repartition("h").groupBy("h").agg(F.count("*").alias("c")).filter("c > 2").orderBy(F.desc("c"), "h").limit(50_000).collect()
    known, c = np.array([r.h for r in counted], np.int64).view(np.uint64), np.array([r.c for r in counted], np.int64)
    order = np.argsort(known)
    rows = shingles(items.filter("n > 0"), path, similarity, (known[order], c[order]))
    # Nearly all shingles are alone, so nothing is gained by counting before the shuffle. One of very many rows is known from
    # the sample: its rows are spread over tasks and dealt by the sample's count.
    hot = [(r.h, r.c * share) for r in counted if r.c * share >= HOT]
    rows = rows.join(F.broadcast(small(items.sparkSession, hot, "h long, told long")), "h", "left")
    spread = F.when(F.col("told").isNotNull(), F.xxhash64("set")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("spread", spread).withColumn("c", F.coalesce("told", F.count("*").over(Window.partitionBy("h", "spread")))).filter("c > 1")
    blocks = F.ceil(F.col("c") / max_group).cast("int")
    keyed = rows.withColumn("side", F.pmod(F.xxhash64("set", F.lit(1)), blocks).cast("int"))
    keyed = keyed.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    keyed = keyed.select("h", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "set").join(pivot_table(items, pivots).select("set", "file", "start", "n", "fp", "coords"), "set")
    keyed = keyed.select("h", "low", "high", "side", "set", "file", "start", "n", "fp", "coords").repartition("h", "low", "high").sortWithinPartitions("h", "low", "high", "file")
    return keyed.mapInArrow(frugal(lambda x: sorted_links(x, path, similarity, radius)), "a long, b long").distinct()


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, radius: int = 24) -> DataFrame:
    """(key, component_id): the smallest key of each row's component of linked texts.

    Texts are lower-cased (A-Z); null texts and those without words are linked
    with each other. Keys, which may be structs, as in simhash.near_duplicates.
    """
    path = scratch(docs.sparkSession, "shingles")
    with batches_of(docs.sparkSession):
        rows = materialize(with_set(docs, path, key, text, width), "sets")
    each = materialize(rows.groupBy("set").agg(F.min("key").alias("least"), F.min(F.struct("file", "start", "n", "fp")).alias("at"), F.count("*").alias("rows")).select("set", "least", "rows", "at.*"), "items")
    roots = materialize(components(materialize(links(each, path, similarity, radius), "links")), "roots")
    linked = each.join(roots, each.set == roots.node).select("set", "root", "least")
    by_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_set = each.join(linked.select("set", "root").join(by_root, "root"), "set", "left").select("set", "rows", F.coalesce("component_id", "least").alias("component_id"))
    return join_by_key(rows, of_set, "set", "rows", rows.count()).select(F.col("key").alias(key), "component_id")
