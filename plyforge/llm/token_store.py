"""Raw token ids in shard files, with a minimal perfect hash index for keyed access.

Layout of a run's folder:

shard-PPPPP-NNNN.ids   nothing but little-endian ids, uint16 or uint32 as the
                       vocabulary needs, of documents in ascending key order.
shard-PPPPP-NNNN.keys  its table: magic, type size, documents, ids, documents
                       of null key (five unsigned 64-bit numbers); the keys
                       (int64) and their n + 1 offsets (int64, in ids).
index-PPPPP.mph        one partition of the index, dealt by the keys' hash:
                       levels of a bit array (each key takes the first level
                       where its slot is its own), the number of set bits before
                       each 64-bit word, and in slot order a 32-bit fingerprint,
                       shard, place and row count.

PPPPP is a key range, NNNN counts the files that its task filled, so a range of
many or long documents costs more files and no more memory. A key's slot is the
rank of its bit, so a lookup costs a few hashes and one range read of each shard
that has rows of the key. A stranger is told by its fingerprint.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import FileStream, batches_of, map_file, runs, write_file
from .tokens import encoder, with_end

MAGIC = 0x5349474D41544B31
HEAD = 5


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (murmur3's constants) of x and a seed."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ (x >> np.uint64(33))) * np.uint64(c)
        return x ^ (x >> np.uint64(33))


class PerfectHash:
    """Levels of a bit array in which each key has a bit of its own."""

    def __init__(self, words: np.ndarray, sizes: list[int]):
        self.words, self.sizes = words, sizes
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.5, most_levels: int = 200) -> PerfectHash:
        """keys: distinct 64-bit integers."""
        levels, sizes, rest = [], [], keys.astype(np.int64).view(np.uint64)
        while len(rest):
            if len(sizes) == most_levels:
                raise ValueError("keys are not distinct")
            size = max(64, int(-(-len(rest) * gamma // 64)) * 64)
            slot = (mix(rest, len(sizes)) % np.uint64(size)).astype(np.int64)
            own = np.bincount(slot, minlength=size) == 1
            levels.append(np.packbits(own, bitorder="little").view("<u8"))
            sizes.append(size)
            rest = rest[~own[slot]]
        return cls(np.concatenate(levels) if levels else np.empty(0, np.uint64), sizes)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """0 to n - 1 for the keys of the build; for others any slot, or -1."""
        keys = keys.astype(np.int64).view(np.uint64)
        out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            bit = base + (mix(keys[open_], level) % np.uint64(size)).astype(np.int64)
            word, shift = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            hit = (word >> shift) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << shift) - np.uint64(1)))
            out[open_[hit]] = (self.before[bit >> 6] + below)[hit]
            open_, base = open_[~hit], base + size
        return out


class ShardWriter:
    """Fills shard files one after another as documents arrive; about part_bytes of ids or part_docs documents each."""

    def __init__(self, path: str, partition: int, unit: int, part_bytes: int, part_docs: int):
        self.path, self.partition, self.unit, self.part_bytes, self.part_docs = path, partition, unit, part_bytes, part_docs
        self.part, self.made, self.out = 0, [], None

    def name(self) -> str:
        return f"shard-{self.partition:05d}-{self.part:04d}"

    def add(self, keys: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents' keys, all ids in a row, and each document's number of ids."""
        done = 0
        while done < len(counts):
            if self.out is None:
                self.out = FileStream(f"{self.path}/{self.name()}.ids")
                self.keys, self.counts, self.n_docs, self.n_null, self.n_ids = [], [], 0, 0, 0
            room = max(1, self.part_bytes // self.unit - self.n_ids)
            ends = np.cumsum(counts[done:])
            n = min(max(1, int(np.searchsorted(ends, room, side="right"))), self.part_docs - self.n_docs)
            size = int(ends[n - 1])
            self.out.write(ids[:size].astype(f"<u{self.unit}").tobytes())
            part = keys[done : done + n]
            self.keys.append(pc.fill_null(part, 0).to_numpy(zero_copy_only=False))
            self.counts.append(counts[done : done + n])
            self.n_null += part.null_count
            self.n_docs, self.n_ids, ids, done = self.n_docs + n, self.n_ids + size, ids[size:], done + n
            if self.n_docs >= self.part_docs or self.n_ids * self.unit >= self.part_bytes:
                self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        ends = np.concatenate([[0], np.cumsum(np.concatenate(self.counts))]).astype("<i8")
        head = np.array([MAGIC, self.unit, self.n_docs, self.n_ids, self.n_null], "<u8")
        write_file(f"{self.path}/{self.name()}.keys", [head, np.concatenate(self.keys).astype("<i8"), ends])
        self.made.append((self.partition, self.part, self.n_docs, self.n_null, self.n_ids))
        self.part, self.out = self.part + 1, None


def read_table(path: str) -> tuple[int, np.ndarray, np.ndarray, int]:
    """A shard's unit, keys, offsets and number of null keys, which are the last ones."""
    raw = map_file(path, "<u8")
    if len(raw) < HEAD or raw[0] != MAGIC:
        raise ValueError(f"{path} is no table of token ids")
    unit, n, _, n_null = raw[1:HEAD].tolist()
    table = raw[HEAD:].view("<i8")
    return unit, table[:n], table[n : 2 * n + 1], n_null


def write_index(path: str, keys: np.ndarray, shard: np.ndarray, place: np.ndarray, count: np.ndarray) -> None:
    mph = PerfectHash.build(keys)
    slot = np.argsort(mph.slots(keys))
    head = np.array([MAGIC, len(keys), len(mph.words), len(mph.sizes), 0, *mph.sizes], "<u8")
    columns = [(mix(keys, 977) >> np.uint64(32)).astype("<u4"), shard.astype("<u4"), place.astype("<u4"), count.astype("<u4")]
    write_file(path, [head, mph.words.astype("<u8"), *[c[slot] for c in columns]])


class Index:
    """One partition of the index, memory-mapped."""

    def __init__(self, path: str):
        raw = map_file(path, "<u8")
        n, words, levels = raw[1:4].astype(int).tolist()
        at = HEAD + levels
        self.n, self.mph = n, PerfectHash(raw[at : at + words], raw[HEAD:at].astype(int).tolist())
        half = raw.view("<u4") if raw.size * 8 == raw.nbytes else raw
        self.columns = half[2 * (at + words) :].reshape(4, -1)[:, :n]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Known or not, shard, place within the shard and row count of each key."""
        slot = self.mph.slots(keys)
        known = slot >= 0
        slot = np.where(known, slot, 0)
        if not self.n:
            return known & False, slot, slot, slot
        mark, shard, place, count = (c[slot] for c in self.columns)
        return known & (mark == (mix(keys, 977) >> np.uint64(32))), shard.astype(np.int64), place.astype(np.int64), count.astype(np.int64)


def runs_of(sizes: np.ndarray, most: int = 8 << 20) -> list[int]:
    """Cuts between rows so that each run has about `most` bytes, or one row."""
    ends, cuts = np.cumsum(sizes), [0]
    while cuts[-1] < len(sizes):
        k = cuts[-1]
        cuts.append(max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + most, side="right"))))
    return cuts


def key_part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mix(keys, 31) % np.uint64(parts)).astype(np.int32)


def type_size(tokenizer: str, end_id: int) -> int:
    """Bytes that the vocabulary's largest id, or the end's, takes: 2 or 4."""
    from tokenizers import Tokenizer

    largest = max(end_id, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values())
    return 2 if largest < 1 << 16 else 4


class TokenStore:
    """The files of one run: write(), then rows() or get()."""

    def __init__(self, spark: SparkSession, path: str, made: list[tuple[int, int, int, int, int]], parts: int):
        """made: (partition, part, documents, documents of null key, ids) of the shards, in order."""
        self.spark, self.path, self.parts = spark, path, parts
        self.names = [f"{path}/shard-{p:05d}-{k:04d}" for p, k, *_ in made]
        self.n_docs, self.n_null = (np.array([m[i] for m in made], np.int64) for i in (2, 3))
        self.starts = np.concatenate([[0], np.cumsum([m[4] for m in made])]).astype(np.int64)

    @classmethod
    def write(
        cls, docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 1, ranges: int | None = None,
        part_bytes: int = 128 << 20, part_docs: int = 200_000, keys_a_part: int = 500_000, spaced: bool = True,
    ) -> TokenStore:
        """Encode all texts, append the end id and write shards in ascending key order.

        Rows are dealt into ranges of (key, hash of the text, place in the
        input), so a key of very many rows spans several ranges; each range is
        sorted by Spark and encoded as a stream, which holds one batch at a
        time. Only the numbers of each file reach the driver. Null texts are
        empty. Rows of null key lie behind all others and outside the index;
        rows() has them, get() can't name them. Rows of one key lie side by
        side in the order of their texts' hashes. An empty table gives a store
        of no files. Other columns are not read.
        """
        spark, unit = docs.sparkSession, type_size(tokenizer, end_id)
        rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
        n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        # 16 MB of text a range, more where there would be over 2000 ranges, 256 MB at most
        ranges = ranges or max(1, -(-size // min(max(16 << 20, size // 2000), 256 << 20)), -(-n // 1_000_000))

        def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            enc, out = encoder(tokenizer, spaced), ShardWriter(path, TaskContext.get().partitionId(), unit, part_bytes, part_docs)
            for batch in batches:
                texts = batch.column(1)
                for a, b in runs(texts, 6 << 20):
                    flat, ends = with_end(*enc.encode(texts[a:b]), end_id)
                    out.add(batch.column(0)[a:b], flat, np.diff(ends))
            out.close()
            names = ["range", "part", "n_docs", "n_null", "n_ids"]
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in out.made], pa.int64()) for i in range(5)], names)

        order = [F.col("key").asc_nulls_last(), F.xxhash64("text"), F.col("place")]
        dealt = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("key", "text")
        with batches_of(spark, 1000):
            made = dealt.mapInArrow(store, "range long, part long, n_docs long, n_null long, n_ids long").collect()
        made = sorted({(r.range, r.part): tuple(r) for r in made}.values())
        out = cls(spark, path, made, max(1, -(-n // keys_a_part)))
        out._write_index()
        return out

    def _shards(self, chosen: np.ndarray) -> DataFrame:
        """(shard, name) of the chosen shards, a task each up to 10,000."""
        rows = [(int(s), self.names[s]) for s in chosen]
        return self.spark.createDataFrame(rows, "shard long, name string").repartition(max(1, min(len(rows), 10_000)))

    def _keys(self) -> DataFrame:
        """(shard, place, key, n_docs, part) of the first row of each key in each shard, from the shards' tables."""
        parts = self.parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    _, keys, _, n_null = read_table(f"{name}.keys")
                    distinct, first, count = np.unique(keys[: len(keys) - n_null], return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(distinct), shard)), pa.array(first), pa.array(distinct), pa.array(count), pa.array(key_part(distinct, parts))], ["shard", "place", "key", "n_docs", "part"])

        return self._shards(np.arange(len(self.names))).mapInArrow(run, "shard long, place long, key long, n_docs long, part int")

    def _write_index(self) -> None:
        """Each partition's keys by their first shard and place there, and the rows that they have in all."""
        path = self.path

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = [b for b in batches if b.num_rows]
            shard, place, keys, count = (np.concatenate([b.column(i).to_numpy() for b in t]) if t else np.empty(0, np.int64) for i in range(4))
            order = np.lexsort((shard, keys))
            keys, shard, place, count = keys[order], shard[order], place[order], count[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
            part = TaskContext.get().partitionId()
            write_index(f"{path}/index-{part:05d}.mph", keys[first], shard[first], place[first], np.add.reduceat(count, first) if len(keys) else count)
            yield pa.RecordBatch.from_arrays([pa.array([part])], ["part"])

        made = {r[0] for r in self._keys().repartitionById(self.parts, "part").mapInArrow(run, "part long").collect()}
        for p in set(range(self.parts)) - made:
            write_index(f"{path}/index-{p:05d}.mph", *[np.empty(0, np.int64)] * 4)

    def get(self, keys: DataFrame, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
        """(key, row, start, n_tokens, ids_crc32, ids) of the given keys' rows; keys that the store lacks, and null ones, give none.

        The keys go to their index partition, which names shard and place, and
        then to the shards, where one range read of each key's ids follows.
        """
        parts = self.parts

        def place_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key_part(batch.column(0).to_numpy(), parts))], ["key", "part"])

        wanted = keys.select(F.col(key).cast("long").alias("key")).filter("key is not null")
        return self._fetch(self._look_up(wanted.mapInArrow(place_keys, "key long, part int")), key, with_ids)

    def _look_up(self, wanted: DataFrame) -> DataFrame:
        """(key, shard, place, row, n_docs) for the keys in wanted (key, part): a row for each shard that has rows of the key."""
        path, here = self.path, self.n_docs - self.n_null

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = None
            for batch in batches:
                index = index or Index(f"{path}/index-{TaskContext.get().partitionId():05d}.mph")
                keys = batch.column(0).to_numpy()
                known, shard, place, left = index.find(keys)
                keys, shard, place, left = keys[known], shard[known], place[known], left[known]
                row = np.zeros(len(keys), np.int64)
                while len(keys):
                    n = np.minimum(left, here[shard] - place)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, shard, place, row, n)], ["key", "shard", "place", "row", "n_docs"])
                    more = left > n
                    keys, shard, left, row = keys[more], shard[more] + 1, (left - n)[more], (row + n)[more]
                    place = np.zeros(len(keys), np.int64)

        return wanted.repartitionById(self.parts, "part").mapInArrow(run, "key long, shard long, place long, row long, n_docs long")

    def _fetch(self, found: DataFrame, key: str, with_ids: bool) -> DataFrame:
        """The rows that found (key, shard, place, row, n_docs) names."""
        names, starts = self.names, self.starts

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                order = np.argsort(batch.column(1).to_numpy(), kind="stable")
                keys, (shards, place, row, count) = batch.column(0).take(pa.array(order)), (batch.column(i).to_numpy()[order] for i in (1, 2, 3, 4))
                edges = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1], [True]])) if len(shards) else []
                for x, y in zip(edges, edges[1:], strict=False):
                    yield from of_shard(int(shards[x]), keys[x:y], place[x:y], row[x:y], count[x:y])

        def of_shard(shard: int, keys: pa.Array, place: np.ndarray, row: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
            unit, held, ends, _ = read_table(f"{names[shard]}.keys")
            data = map_file(f"{names[shard]}.ids", f"<u{unit}")
            for p in range(0, len(keys), 4096):  # requests in bounded numbers; each may stand for many rows
                for which, at, nth in expand(place[p : p + 4096], count[p : p + 4096], row[p : p + 4096]):
                    which = which + p
                    want = keys.take(pa.array(which))
                    same = held[at] == pc.fill_null(want, 0).to_numpy(zero_copy_only=False)  # else a stranger with a known fingerprint
                    which, at, nth, want = which[same], at[same], nth[same], want.filter(pa.array(same))
                    a, b = ends[at], ends[at + 1]
                    cuts = runs_of((b - a) * 4)
                    for x, y in zip(cuts, cuts[1:], strict=False):
                        wide = [data[m:n].astype("<u4").tobytes() for m, n in zip(a[x:y].tolist(), b[x:y].tolist(), strict=True)]
                        sums = pa.array([zlib.crc32(w) for w in wide], pa.int64())
                        ids = pa.array(wide if with_ids else [None] * len(wide), pa.binary())
                        yield pa.RecordBatch.from_arrays([want[x:y], pa.array(nth[x:y]), pa.array(a[x:y] + starts[shard]), pa.array(b[x:y] - a[x:y]), sums, ids], ["key", "row", "start", "n_tokens", "ids_crc32", "ids"])

        dealt = found.repartitionById(max(1, len(names)), F.col("shard").cast("int"))
        return dealt.mapInArrow(fetch, "key long, row long, start long, n_tokens long, ids_crc32 long, ids binary").withColumnRenamed("key", key)

    def rows(self, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
        """Every row of the store: by keyed access to every key of its tables, and those of null key by their shards' ends."""
        out = self._look_up(self._keys().select("key", "part").distinct())
        with_null = np.flatnonzero(self.n_null)
        if len(with_null):
            before = np.cumsum(self.n_null) - self.n_null
            rows = [(None, int(s), int(self.n_docs[s] - self.n_null[s]), int(before[s]), int(self.n_null[s])) for s in with_null]
            out = out.unionByName(self.spark.createDataFrame(rows, "key long, shard long, place long, row long, n_docs long"))
        out = self._fetch(out, key, with_ids)
        return out if with_ids else out.drop("ids")


def expand(place: np.ndarray, count: np.ndarray, row: np.ndarray, most: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(request, place, row number) of each row that requests of `count` rows stand for, at most `most` rows at a time."""
    ends = np.cumsum(count)
    for a in range(0, int(ends[-1]) if len(ends) else 0, most):
        k = np.arange(a, min(a + most, int(ends[-1])))
        which = np.searchsorted(ends, k, side="right")
        nth = k - (ends - count)[which]
        yield which, place[which] + nth, row[which] + nth
