"""SimHash fingerprints linked within a few bits, by pivot distance tables.

Each distinct fingerprint gets a row of a pivot table: its Hamming distances to
fixed reference fingerprints. Two fingerprints within r bits differ by r at
most in every coordinate, so a pair whose largest coordinate difference is over
r is discarded unseen; survivors are verified on the fingerprints. Pairs are
sought only inside key groups that lose none: of 64 bits in r + 2 blocks, two
fingerprints within r bits agree on two blocks at least. A group over a bound is
dealt again by finer blocks of its free bits, so groups of copies of any size
stay bounded, and a group gives links that span it rather than all its pairs.
What is still large after that is dealt once more, down to 256 fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import batches_of, frugal, join_by_key, materialize, runs, small, split_words, text_column, utf8
from .components import components

BIT = (np.uint64(1) << np.arange(64, dtype=np.uint64))[None, :]


def references(count: int) -> list[int]:
    """Reference fingerprints: XXH64 of the numbers from 0 on, as signed longs."""
    return [int(np.uint64(xxhash.xxh64_intdigest(str(i).encode(), 42)).astype(np.int64)) for i in range(count)]


def fingerprints(texts: pa.Array, width: int = 3, step: int = 200_000) -> np.ndarray:
    """64-bit SimHash of each text over its shingles of `width` words, repeats included."""
    words, ends = split_words(pc.ascii_lower(texts))
    joined, _ = utf8(pc.binary_join_element_wise(words, " ", ""))  # every word and one space
    begin = np.concatenate([[0], np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False) + 1)]).astype(np.int64)
    n_words = np.diff(ends)
    n_shingles = np.where(n_words > 0, np.maximum(n_words - width + 1, 1), 0)
    shingle_ends = np.concatenate([[0], np.cumsum(n_shingles)])
    doc = np.repeat(np.arange(len(n_words)), n_shingles)
    first = ends[doc] + np.arange(len(doc)) - shingle_ends[doc]
    last = np.minimum(first + width, ends[doc + 1])
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    out = np.zeros(len(n_words), np.uint64)
    votes = np.zeros((len(n_words), 64), np.int64)
    for k in range(0, len(doc), step):
        f, e = begin[first[k : k + step]].tolist(), (begin[last[k : k + step]] - 1).tolist()
        h = np.fromiter([digest(raw[a:b], 42) for a, b in zip(f, e, strict=True)], np.uint64, len(f))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        d = doc[k : k + step]
        starts = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        votes[d[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    over = 2 * votes > n_shingles[:, None]
    out = (over * BIT).sum(axis=1, dtype=np.uint64)
    return out


def with_fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fp): the fingerprint of each row as a signed long; a text without words has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch, "text")
            fp = np.concatenate([fingerprints(texts[a:b], width) for a, b in runs(texts)] or [np.empty(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(frugal(run), f"key {kind}, fp long")


def pivot_table(fps: DataFrame, pivots: int) -> DataFrame:
    """Add `coords`, the Hamming distances to the reference fingerprints."""
    return fps.withColumn("coords", F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("byte") for p in references(pivots)]))


def group_links(fp: np.ndarray, coords: np.ndarray, radius: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (index, smaller index) that connect whatever lies within the radius in one group.

    Sorted by the first coordinate, a row's partners lie in a short run; the
    other coordinates discard most of it. A row already joined to another
    through earlier links is still compared, but gives at most one link a block
    of partners and component.
    """
    order = np.argsort(coords[:, 0], kind="stable")
    fp, coords = fp[order], coords[order]
    parent = np.arange(len(fp))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    a, b = [], []
    stop = np.searchsorted(coords[:, 0], coords[:, 0].astype(int) + radius, side="right")
    for i in range(len(fp)):
        for k in range(i + 1, int(stop[i]), block):
            span = slice(k, min(k + block, int(stop[i])))
            near = np.abs(coords[span].astype(np.int8) - coords[i].astype(np.int8)).max(axis=1) <= radius
            for j in (np.flatnonzero(near) + k).tolist():
                if int(fp[i] ^ fp[j]).bit_count() <= radius and (x := root(i)) != (y := root(j)):
                    parent[max(x, y)] = min(x, y)
                    a.append(order[i])
                    b.append(order[j])
    return np.array(a, np.int64), np.array(b, np.int64)


def block_masks(bits: list[int], blocks: int) -> list[int]:
    """Cut the bits into blocks of near-equal size; a mask of each choice of two blocks."""
    edges = [round(i * len(bits) / blocks) for i in range(blocks + 1)]
    parts = [sum(1 << x for x in bits[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    return [x | y for x, y in combinations(parts, 2)]


def signed(mask: int) -> int:
    return mask - ((mask >> 63) << 64)


def sorted_links(batches: Iterator[pa.RecordBatch], radius: int, wide: int = 48) -> Iterator[pa.RecordBatch]:
    """Links within the groups of rows (mask, bits, fp, coords) that come sorted by group.

    Groups of up to `wide` rows are compared together, all rows with the row
    k places below for each k; larger ones by group_links. Rows of a group that
    a batch cuts are carried to the next.
    """

    def solve(t: pa.Table) -> pa.RecordBatch:
        mask, bits, fp = (t[c].to_numpy() for c in ("mask", "bits", "fp"))
        coords = np.frombuffer(t["coords"].combine_chunks().flatten().to_numpy(zero_copy_only=False).tobytes(), np.int8).reshape(len(fp), -1)
        starts = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])]))
        sizes = np.diff(np.concatenate([starts, [len(fp)]]))
        size, a, b = np.repeat(sizes, sizes), [], []
        ends = np.repeat(starts + sizes, sizes)
        for k in range(1, wide):
            i = np.flatnonzero((size <= wide) & (np.arange(len(fp)) + k < ends))
            if not len(i):
                break
            i = i[np.abs(coords[i] - coords[i + k]).max(axis=1) <= radius]
            i = i[np.bitwise_count(fp[i].view(np.uint64) ^ fp[i + k].view(np.uint64)) <= radius]
            a.append(i)
            b.append(i + k)
        for s in np.flatnonzero(sizes > wide).tolist():
            span = slice(starts[s], starts[s] + sizes[s])
            x, y = group_links(fp[span].view(np.uint64), coords[span], radius)
            a.append(x + starts[s])
            b.append(y + starts[s])
        a, b = (np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(fp[a], fp[b])), pa.array(np.minimum(fp[a], fp[b]))], ["a", "b"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        mask, bits = t["mask"].to_numpy(), t["bits"].to_numpy()
        cut = int(np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])]))[-1])
        if cut:
            yield solve(t.slice(0, cut))
        held = t.slice(cut)
    if held is not None:
        yield solve(held)


def links(fps: DataFrame, radius: int = 2, pivots: int = 16, max_group: int = 1000, parts: int | None = None) -> DataFrame:
    """Links (a, b), a > b, between distinct fingerprints that connect all within the radius.

    fps: distinct fp. The links' graph has the components of the graph of all
    pairs within the radius. Groups over max_group are dealt by two blocks of
    their free bits as well, as often as bits are left to deal by: at a radius
    of two, 32, 16 and at last 8 bits are free, which is 256 fingerprints.
    """
    spark, blocks = fps.sparkSession, radius + 2
    masks, done = block_masks(list(range(64)), blocks), []
    keyed = fps.withColumn("mask", F.explode(F.array(*[F.lit(signed(m)) for m in masks])))
    while True:
        keyed = keyed.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = keyed.groupBy("mask", "bits").agg(F.count("*").alias("n")).filter("n > 1")
        finer = [(signed(m), signed(m | x)) for m in masks if 64 - m.bit_count() > blocks for x in block_masks([i for i in range(64) if not m >> i & 1], blocks) if 64 - (m | x).bit_count() >= 8]
        keyed = materialize(keyed.join(sizes, ["mask", "bits"]), "keyed")
        large = keyed.filter(F.col("n") > max_group)
        if not finer or large.isEmpty():
            done.append(keyed)
            break
        done.append(keyed.filter(F.col("n") <= max_group))
        keyed = large.join(F.broadcast(small(spark, finer, "mask long, finer long")), "mask").select("fp", F.col("finer").alias("mask")).distinct()
        masks = sorted({f & (1 << 64) - 1 for _, f in finer})
    groups = pivot_table(reduce(DataFrame.unionByName, done).select("fp", "mask", "bits"), pivots)
    groups = groups.repartition("mask", "bits") if parts is None else groups.repartition(parts, "mask", "bits")
    return groups.sortWithinPartitions("mask", "bits", "fp").mapInArrow(frugal(lambda x: sorted_links(x, radius)), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2, pivots: int = 16) -> DataFrame:
    """(key, fingerprint, component_id): the smallest key of each row's component of linked fingerprints.

    Texts are lower-cased (A-Z). Null and empty texts and texts without words
    have fingerprint zero, linked like any other; texts of fewer words than a
    shingle are one shingle. Rows of equal or null key each give a row; null
    keys are never a component's id unless it has no other. An empty table
    gives no rows; other columns are not carried. Rows of a fingerprint that
    very many share are not gathered in one task.
    """
    with batches_of(docs.sparkSession):
        rows = materialize(with_fingerprint(docs, key, text, width), "fingerprints")
    each = materialize(rows.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("n")), "distinct")
    roots = materialize(components(links(each.select("fp"), radius, pivots)), "roots")
    linked = each.join(roots, each.fp == roots.node).select("fp", "root", "least")
    by_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = each.join(linked.select("fp", "root").join(by_root, "root"), "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return join_by_key(rows, of_fp, "fp", "n", rows.count()).select(F.col("key").alias(key), shown.alias("fingerprint"), "component_id")
