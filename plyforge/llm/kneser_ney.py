"""An n-gram language model with interpolated modified Kneser-Ney smoothing; the order is a parameter, three unless said.

Counting is one shuffle of pre-aggregated word counts by hash, one of n-grams of
word ranks, and one for each lower order, whose counts are the numbers of
distinct words that an n-gram follows. A word's rank is its place in the sorted
hash array. What a bucket merges, it writes as one file of flat arrays:

words-N    sorted 64-bit word hashes; counts
grams-K-N  order K: sorted 64-bit hashes of contexts, where each context's run
           begins, and of long runs the total and how many words follow once
           and twice; then the runs: sorted ranks of the words that follow,
           and their counts
after-N    for each word, how many words it follows

Numbers are stored by the byte, those of 255 and more apart. Workers map these
files into memory and look hashes and ranks up by binary search, so a model
larger than a worker's memory works and is shared by all workers of a machine.

An n-gram's bucket is that of its second word (of a pair its first), so a
context's run and most of an n-gram's predecessors lie together. Words that
alone would fill a bucket have several of their own, dealt by the rest of the
context, and by the last word too where the context itself may be as frequent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import batches_of, gather, map_file, runs, scratch, text_column, utf8, write_file
from .token_store import mix

#: The hash of the end of a text, an empty word.
END = int(mix(np.zeros(1, np.uint64), 5)[0])
STEP = 1 << 20  # bytes hashed at a time
LONG_WORD = 256


def combine(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts[order], starts)


def shrink(x: np.ndarray) -> bytes:
    """Numbers in the smallest unsigned type that holds them, byte plane by byte plane."""
    most = int(x.max()) if len(x) else 0
    size = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return x.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T.tobytes()


def grow(raw: bytes, n: int) -> np.ndarray:
    size = len(raw) // n if n else 1
    return np.frombuffer(raw, np.uint8).reshape(size, n).T.copy().view(f"<u{size}").reshape(-1).astype(np.int64)


@lru_cache(1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    odd = 0x9E3779B97F4A7C15
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(STEP - 1, x, np.uint64)])) for x in (odd, pow(odd, -1, 1 << 64)))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words data[start:end]: a polynomial of the bytes, from running sums, and a finaliser.

    Words of LONG_WORD bytes and more have the library's digest instead: modulo
    a power of two, long words exist that any polynomial confuses (a Thue-Morse
    word of 1024 letters and its complement, say).
    """
    out, k = np.empty(len(starts), np.uint64), 0
    up, down = powers()
    while k < len(starts):
        a = int(starts[k])
        stop = int(np.searchsorted(ends, a + STEP, side="right"))
        if stop == k:  # a word longer than a step, see below
            k += 1
            continue
        z = int(ends[stop - 1])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data[a:z].astype(np.uint64) + np.uint64(1)) * up[: z - a])])
        out[k:stop] = (sums[ends[k:stop] - a] - sums[starts[k:stop] - a]) * down[starts[k:stop] - a]
        k = stop
    for i in np.flatnonzero(ends - starts >= LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), 0)
    return mix(out ^ (ends - starts).astype(np.uint64), 5)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word hashes (sorted), each word's place among them, and n + 1 offsets of the texts' words.

    Words are runs of bytes outside 0x20 and 0x09-0x0D, A-Z lower-cased.
    """
    data, cuts = utf8(texts)
    data = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    edges = cuts[(cuts > 0) & (cuts < len(data))]
    begin[edges] = inside[edges]
    stop[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    distinct, place = np.unique(word_hashes(data, starts, ends), return_inverse=True)
    return distinct, place, np.searchsorted(starts, cuts).astype(np.int64)


class Sum:
    """Counts by key, combined whenever enough have gathered."""

    def __init__(self, most: int = 3_000_000):
        self.keys, self.counts, self.size, self.most = [], [], 0, most

    def add(self, keys: np.ndarray, counts: np.ndarray) -> bool:
        """Whether what has been combined is still large."""
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size < self.most:
            return False
        keys, counts = self.take()
        self.keys, self.counts, self.size = [keys], [counts], len(keys)
        return self.size > self.most // 2

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = combine(np.concatenate(self.keys), np.concatenate(self.counts)) if self.keys else (np.empty(0, np.uint64), np.empty(0, np.int64))
        self.keys, self.counts, self.size = [], [], 0
        return out


def hash_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the hashes' upper halves; ascending with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def cut(sorted_buckets: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(sorted_buckets, np.arange(buckets + 1))


def batch_of(names: list[str], *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names)


def combine_rows(keys: list[np.ndarray], cols: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows of distinct keys, ordered by the first key, then the second and so on, and the sums of their counts."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        keys = [k[order] for k in keys]
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    starts = np.flatnonzero(new)
    return [c[order[starts]] for c in cols], np.add.reduceat(counts[order], starts) if len(starts) else counts


def pack(cols: list[np.ndarray]) -> bytes:
    """Rows of numbers, ordered by the columns, in few bytes: a column holds differences while those before it stay the same."""
    same, parts = np.zeros(len(cols[0]), bool), []
    same[1:] = True
    for c in cols[:-1]:
        c = c.astype(np.int64)
        step = np.diff(c, prepend=0)
        parts.append(shrink(np.where(same, step, c)))
        same &= step == 0
    parts.append(shrink(cols[-1]))
    raw = np.array([len(cols[0]), *map(len, parts)], "<u4").tobytes() + b"".join(parts)
    return zstandard.compress(raw, 1)


def unpack(raw: bytes, columns: int) -> list[np.ndarray]:
    raw = zstandard.decompress(raw)
    n, *sizes = np.frombuffer(raw, "<u4", columns + 1).tolist()
    at, out = 4 * (columns + 1), []
    fresh = np.zeros(n, bool)  # where a column starts anew
    fresh[:1] = True
    for j, size in enumerate(sizes):
        x = grow(raw[at : at + size], n)
        at += size
        if j < columns - 1:
            sums = np.cumsum(x)
            begin = np.flatnonzero(fresh)
            x = sums - np.repeat(sums[begin] - x[begin], np.diff(np.append(begin, n)))
            fresh[1:] |= x[1:] != x[:-1]
        out.append(x)
    return out


def small_numbers(x: np.ndarray, kind: str = "<u1") -> list[np.ndarray]:
    """By the byte (or two); the places and values of those that don't fit follow."""
    most = np.iinfo(kind).max
    large = np.flatnonzero(x >= most)
    return [np.minimum(x, most).astype(kind), np.concatenate([large, x[large]]).astype("<u8")]


def numbers_at(low: np.ndarray, large: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = low[at].astype(np.int64)
    if len(large):
        big = np.flatnonzero(out == np.iinfo(low.dtype).max)
        half = len(large) // 2
        out[big] = large[half + np.searchsorted(large[:half], at[big])]
    return out


def run_starts(start: np.ndarray) -> list[np.ndarray]:
    """Ascending numbers: every 64th in full, and the others by what they exceed it."""
    base = start[::64]
    return [base.astype("<u8"), *small_numbers(start - np.repeat(base, 64)[: len(start)], "<u2")]


def starts_at(base: np.ndarray, low: np.ndarray, large: np.ndarray, at: np.ndarray) -> np.ndarray:
    return base[at >> 6].astype(np.int64) + numbers_at(low, large, at)


LONG = 16  # runs beyond it have their sums stored


def by_bucket(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order by bucket, and where each bucket begins in it."""
    order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")  # short numbers sort much faster
    return order, cut(bucket[order], buckets)


def write_arrays(path: str, arrays: list[np.ndarray]) -> None:
    """One file: the number of arrays, their sizes in bytes, and each array from a multiple of eight on."""
    parts = [np.array([len(arrays), *(x.nbytes for x in arrays)], "<u8").tobytes()]
    for x in arrays:
        parts += [x.tobytes(), bytes(-x.nbytes % 8)]
    write_file(path, parts)


_maps: dict[str, list[np.ndarray]] = {}


def arrays_of(path: str, *kinds: str) -> list[np.ndarray]:
    """This worker's maps of a file's arrays; maps of other files are dropped when there are many."""
    if path not in _maps:
        if len(_maps) > 50_000:
            _maps.clear()
        raw = np.asarray(map_file(path, np.uint8))
        n = int(raw[:8].view("<u8")[0])
        at, out = 8 * (n + 1), []
        for size, kind in zip(raw[8:at].view("<u8").tolist(), kinds, strict=True):
            out.append(raw[at : at + size].view(kind))
            at += size + -size % 8
        _maps[path] = out
    return _maps[path]


def context_hash(cols: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(cols[0]), np.uint64)
    for j, c in enumerate(cols):
        h = mix(h ^ c.astype(np.uint64), j + 1)
    return h


@dataclass
class Model:
    """Where the files are, and the numbers that scoring needs."""

    path: str
    order: int
    buckets: int
    bases: list[int]  # rank of each word bucket's first word; the last is the number of distinct words
    n_tokens: int = 0
    n_docs: int = 0
    hot: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # sorted ranks of words with buckets of their own
    first: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # of these buckets
    parts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    seen: np.ndarray = field(default_factory=lambda: np.zeros((1, 6)))  # by order, from one: how many n-grams have 0, 1, ... 4, more counts
    discounts: np.ndarray = field(default_factory=lambda: np.zeros((1, 4)))

    @property
    def n_words(self) -> int:
        return self.bases[-1]

    @property
    def gram_buckets(self) -> int:
        return self.buckets + int(self.parts.sum())

    def words_file(self, b: int) -> list[np.ndarray]:
        return arrays_of(f"{self.path}/words-{b:05d}", "<u8", "u1", "<u8")

    def kinds_file(self, b: int) -> list[np.ndarray]:
        return arrays_of(f"{self.path}/after-{b:05d}", "u1", "<u8")

    def grams_file(self, k: int, b: int) -> list[np.ndarray]:
        """Contexts; their runs' starts (three arrays); contexts of long runs and (3 each) their sums; words; counts (two arrays)."""
        return arrays_of(f"{self.path}/grams-{k}-{b:05d}", "<u8", "<u8", "<u2", "<u8", "<u4", "<u8", "<u4", "u1", "<u8")

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """Ranks of sorted hashes, -1 of unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        edges = cut(hash_bucket(hashes, self.buckets), self.buckets)
        for b in np.flatnonzero(np.diff(edges)).tolist():
            have, want = self.words_file(b)[0], hashes[edges[b] : edges[b + 1]]
            if len(have):
                at = np.minimum(np.searchsorted(have, want), len(have) - 1)
                out[edges[b] : edges[b + 1]] = np.where(have[at] == want, at + self.bases[b], -1)
        return out

    def by_word(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of words and numbers of words that they follow, at sorted ranks."""
        count, kinds = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        edges = np.searchsorted(ranks, self.bases)
        for b in np.flatnonzero(np.diff(edges)).tolist():
            span = slice(edges[b], edges[b + 1])
            at = ranks[span] - self.bases[b]
            count[span], kinds[span] = numbers_at(*self.words_file(b)[1:], at), numbers_at(*self.kinds_file(b), at)
        return count, kinds

    def hot_place(self, ranks: np.ndarray) -> np.ndarray:
        """Places among the hot words, -1 of others."""
        if not len(self.hot):
            return np.full(len(ranks), -1)
        at = np.minimum(np.searchsorted(self.hot, ranks), len(self.hot) - 1)
        return np.where(self.hot[at] == ranks, at, -1)

    def split(self, context: list[np.ndarray]) -> np.ndarray:
        """Which contexts' runs are dealt over all buckets of their hot word."""
        own = self.hot_place(context[-1] if len(context) == 1 else context[1]) >= 0
        return own if len(context) == 1 else own & (self.hot_place(context[0]) >= 0)

    def bucket(self, context: list[np.ndarray], last: np.ndarray) -> np.ndarray:
        owner = context[0] if len(context) == 1 else context[1]
        out = owner * self.buckets // (self.n_words + 1)
        at = self.hot_place(owner)
        hot = np.flatnonzero(at >= 0)
        if len(hot):
            context, at = [c[hot] for c in context], at[hot]
            rest = context_hash([context[0], *context[2:]]) if len(context) > 1 else np.zeros(len(hot), np.uint64)
            rest = np.where(self.split(context), mix(rest ^ last[hot].astype(np.uint64), 11), mix(rest, 12))
            out[hot] = self.first[at] + (rest % self.parts[at].astype(np.uint64)).astype(np.int64)
        return out

    def runs_of(self, bucket: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each context's run begins and ends in its bucket's file, and (contexts, 3): its total, and how many follow it once and twice."""
        low, high, numbers = np.zeros(len(bucket), np.int64), np.zeros(len(bucket), np.int64), np.zeros((len(bucket), 3), np.int64)
        order, edges = by_bucket(bucket, self.gram_buckets)
        for b in np.flatnonzero(np.diff(edges)).tolist():
            at = order[edges[b] : edges[b + 1]]
            have, base, small, large, long, sums, _, one, more = self.grams_file(k, b)
            if not len(have):
                continue
            want = hashes[at]
            place = np.minimum(np.searchsorted(have, want), len(have) - 1)
            hit = np.flatnonzero(have[place] == want)
            if not len(hit):
                continue
            at, place = at[hit], place[hit]
            a, z = starts_at(base, small, large, place), starts_at(base, small, large, place + 1)
            low[at], high[at] = a, z
            n = z - a
            short = np.flatnonzero(n <= LONG)
            if len(short):
                counts = numbers_at(one, more, gather(a[short], n[short]))
                first = np.cumsum(n[short]) - n[short]
                for j, x in enumerate((counts, counts == 1, counts == 2)):
                    numbers[at[short], j] = np.add.reduceat(x, first, dtype=np.int64)
            rest = np.flatnonzero(n > LONG)
            if len(rest):
                numbers[at[rest]] = sums.reshape(-1, 3)[np.searchsorted(long, place[rest])]
        return low, high, numbers

    def counts_in(self, bucket: np.ndarray, low: np.ndarray, high: np.ndarray, words: np.ndarray, k: int) -> np.ndarray:
        """Counts of words in runs, 0 of those that are not there: a binary search in each run."""
        out = np.zeros(len(words), np.int64)
        order, edges = by_bucket(bucket, self.gram_buckets)
        for b in np.flatnonzero(np.diff(edges)).tolist():
            at = order[edges[b] : edges[b + 1]]
            *_, after, small, large = self.grams_file(k, b)
            if not len(after):
                continue
            at = at[low[at] < high[at]]
            want, a, z, end = words[at], low[at], high[at], high[at]
            alone = z - a == 1
            open_ = np.flatnonzero(~alone)
            a[alone & (after[np.minimum(a, len(after) - 1)] < want)] += 1
            while len(open_):
                mid = (a[open_] + z[open_]) >> 1
                less = after[mid] < want[open_]
                a[open_[less]] = mid[less] + 1
                z[open_[~less]] = mid[~less]
                open_ = open_[a[open_] < z[open_]]
            safe = np.minimum(a, len(after) - 1)
            hit = (a < end) & (after[safe] == want)
            out[at[hit]] = numbers_at(small, large, safe[hit])
        return out

    def raise_order(self, p: np.ndarray, cols: list[np.ndarray], which: np.ndarray | None = None, contexts: np.ndarray | None = None) -> np.ndarray:
        """Probabilities of the order of len(cols) words from those of the order below. For pairs, which of the contexts each has."""
        k, d = len(cols), self.discounts[len(cols)]
        at = np.flatnonzero(np.all([c >= 0 for c in cols[:-1]], axis=0))
        cols = [c[at] for c in cols]
        if contexts is not None:
            context, back = [np.maximum(contexts, 0)], which[at]
        else:  # longer contexts hardly repeat
            context, back = cols[:-1], np.arange(len(at))
        hashes = context_hash(context)
        bucket, split = self.bucket(context, np.zeros(len(hashes), np.int64)), self.split(context)
        bucket[split] = -1
        low, high, numbers = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64), np.zeros((len(hashes), 4), np.int64)
        one = np.flatnonzero(~split)
        low[one], high[one], numbers[one, :3] = self.runs_of(bucket[one], hashes[one], k)
        numbers[:, 3] = high - low
        many = np.flatnonzero(split)
        if len(many):  # the sums over all buckets of the hot word
            _, first, again = np.unique(hashes[many], return_index=True, return_inverse=True)
            some = many[first]
            own = self.hot_place((context[0] if k == 2 else context[1])[some])
            n = self.parts[own]
            owner = np.repeat(np.arange(len(some)), n)
            part = self.first[own][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            a, z, found = self.runs_of(part, hashes[some][owner], k)
            for j, x in enumerate((*found.T, z - a)):
                numbers[many, j] = np.bincount(owner, x, len(some)).astype(np.int64)[again]
        total = numbers[:, 0][back]
        seen = np.flatnonzero(total > 0)
        at, back, total = at[seen], back[seen], total[seen]
        cols = [c[seen] for c in cols]
        known = np.flatnonzero(cols[-1] >= 0)
        owner, word = back[known], cols[-1][known]
        b, a, z = bucket[owner], low[owner], high[owner]
        apart = np.flatnonzero(b < 0)
        if len(apart):
            b[apart] = self.bucket([c[known[apart]] for c in cols[:-1]], word[apart])
            a[apart], z[apart], _ = self.runs_of(b[apart], hashes[owner[apart]], k)
        count = np.zeros(len(seen), np.int64)
        count[known] = self.counts_in(b, a, z, word, k)
        ones, twos, all_ = numbers[:, 1], numbers[:, 2], numbers[:, 3]
        free = (d[1] * ones + d[2] * twos + d[3] * (all_ - ones - twos))[back] / total
        out = p.copy()
        out[at] = np.maximum(count - d[np.minimum(count, 3)], 0) / total + free * p[at]
        return out

    def word_probability(self, kinds: np.ndarray) -> np.ndarray:
        """The lowest order: by the number of words that a word follows; 0 stands for unknown words too."""
        rest, p = 1.0, np.zeros(len(kinds))
        n_pairs = float(self.seen[2][1:].sum()) if len(self.seen) > 2 else 0.0
        if n_pairs:
            d, n = self.discounts[1], self.seen[1]
            rest = float(d[1] * n[1] + d[2] * n[2] + d[3] * n[3:].sum()) / n_pairs
            p = np.maximum(kinds - d[np.minimum(kinds, 3)], 0) / n_pairs
        return p + rest / (self.n_words + 1)

    def sequence(self, rank: np.ndarray, ends: np.ndarray, end_rank: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of all texts in a row, order - 1 begins before each and an end after it; and the places of words and ends."""
        n, pad = np.diff(ends), self.order - 1
        where = np.arange(len(rank)) + np.repeat(np.arange(len(n)) * (pad + 1) + pad, n)
        out = np.full(len(rank) + len(n) * (pad + 1), self.n_words, np.int64)
        out[where] = rank
        last = np.cumsum(n + pad + 1) - 1
        out[last] = end_rank
        is_token = np.zeros(len(out), bool)
        is_token[where] = is_token[last] = True
        return out, np.flatnonzero(is_token)

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Numbers of words, known words, and both log10 probabilities of each text."""
        distinct, place, ends = tokens(texts)
        n = np.diff(ends)
        known = self.ranks(distinct)  # ascending with the hash, but for the -1
        safe = np.flatnonzero(known >= 0)
        count, kinds = np.zeros(len(distinct) + 1, np.int64), np.zeros(len(distinct) + 1, np.int64)
        count[safe], kinds[safe] = self.by_word(known[safe])
        end = self.ranks(np.array([END], np.uint64))
        if end[0] >= 0:
            count[-1:], kinds[-1:] = self.by_word(end)
        sequence, at = self.sequence(known[place], ends, int(end[0]))
        # What each token is among the distinct words; the end is the last of them.
        which = np.full(len(at), len(distinct))
        is_word = np.ones(len(at), bool)
        is_word[np.cumsum(n + 1) - 1] = False
        which[is_word] = place
        begin = np.cumsum(n + 1) - (n + 1)
        p = self.word_probability(kinds)[which]
        # A token's context of one word is the token before it, or the begin of the text.
        before = np.concatenate([[0], which[:-1]])
        before[begin] = len(distinct) + 1
        contexts = np.concatenate([known, end, [self.n_words]])
        for k in range(2, self.order + 1):
            pair = (before, contexts) if k == 2 else ()
            p = self.raise_order(p, [sequence[at - (k - 1) + j] for j in range(k)], *pair)
        base = np.log10((count[which] + 1) / (self.n_tokens + self.n_words + 1))
        add = lambda x: np.add.reduceat(x, begin) if len(begin) else np.empty(0)
        return {"n_tokens": n + 1, "n_known": add((count[which] > 0).astype(np.int64)), "base_score": add(base), "score": add(np.log10(p))}


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more from n[k], the number of events seen k times (k = 1 ... 4).

    Chen and Goodman's estimates, kept within 0 and k; where an estimate lacks
    its numbers, half a count.
    """
    out = np.zeros(4)
    y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
    for k in (1, 2, 3):
        out[k] = min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.0), float(k)) if n[k] and n[1] else 0.5
        out[k] = out[k] or 0.5
    return out


def train(docs: DataFrame, text: str = "text", order: int = 3, bucket_bytes: int = 16 << 20, path: str | None = None) -> Model:
    """Count all texts (nulls are empty ones, and count as texts) and write the model below path.

    There is a bucket for each bucket_bytes of text, and more for hot words: a
    bucket holds about as many distinct n-grams as so much text has tokens. The
    driver gets a few numbers for each bucket and the hot words, of which there
    are four a bucket at most.
    """
    if order < 2:
        raise ValueError("the order is two at least")
    spark = docs.sparkSession
    path = path or scratch(spark, "ngrams")
    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    n_docs, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = max(2, -(-size // bucket_bytes))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Sum()

        def parts() -> Iterator[pa.RecordBatch]:
            keys, counts = total.take()
            edges = cut(hash_bucket(keys, buckets), buckets)
            for b in np.flatnonzero(np.diff(edges)).tolist():
                span = slice(edges[b], edges[b + 1])
                yield batch_of(["bucket", "keys", "counts"], np.array([b], np.int32), [keys[span].tobytes()], [zstandard.compress(shrink(counts[span]), 1)])

        for batch in batches:
            texts = batch.column(0)
            for a, z in runs(texts):
                distinct, place, ends = tokens(texts[a:z])
                hashes = np.concatenate([distinct, np.array([END], np.uint64)])
                if total.add(hashes, np.concatenate([np.bincount(place, minlength=len(distinct)), [len(ends) - 1]]).astype(np.int64)):
                    yield from parts()
        yield from parts()

    def merge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Sum()
        for batch in batches:
            for keys, counts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if keys:
                    total.add(np.frombuffer(keys, np.uint64), grow(zstandard.decompress(counts), len(keys) // 8))
        b = TaskContext.get().partitionId()
        keys, counts = total.take()
        write_arrays(f"{path}/words-{b:05d}", [keys.astype("<u8"), *small_numbers(counts)])
        yield batch_of(["bucket", "n", "total"], [b], [len(keys)], [int(counts.sum())])

    nothing = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.unhex(F.lit("")).alias("keys"), F.unhex(F.lit("")).alias("counts"))
    shuffled = rows.mapInArrow(words, "bucket int, keys binary, counts binary").unionByName(nothing).repartitionById(buckets, "bucket")
    with batches_of(spark):
        made = {r.bucket: r for r in shuffled.mapInArrow(merge_words, "bucket long, n long, total long").collect()}
    bases = np.concatenate([[0], np.cumsum([made[b].n for b in range(buckets)])]).tolist()
    if bases[-1] >= 1 << 32:
        raise ValueError("2 ** 32 distinct words or more: ranks no longer fit four bytes")
    model = Model(path, order, buckets, bases, sum(r.total for r in made.values()), n_docs)
    _find_hot(spark, model)
    _count_grams(rows, model)
    return model


def _find_hot(spark: SparkSession, model: Model) -> None:
    """Words, and the begin of a text, with over a quarter of a bucket's share of the tokens."""
    share = max(1, model.n_tokens // model.buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                low, large = model.words_file(b)[1:]
                at = np.flatnonzero(low >= min(255, share // 4))
                count = numbers_at(low, large, at)
                at, count = at[4 * count > share], count[4 * count > share]
                yield batch_of(["rank", "n"], at + model.bases[b], count)

    found = [(r.rank, r.n) for r in spark.range(model.buckets).mapInArrow(run, "rank long, n long").collect()]
    found += [(model.n_words, model.n_docs)] * (4 * model.n_docs > share)
    found.sort()
    model.hot = np.array([r for r, _ in found], np.int64)
    model.parts = np.array([-(-2 * n // share) for _, n in found], np.int64)
    model.first = model.buckets + np.cumsum(model.parts) - model.parts


class Rows:
    """Rows of ranks and their counts, combined whenever enough have gathered."""

    def __init__(self, combine, most: int = 2_000_000):
        self.combine, self.most, self.held, self.size = combine, most, [], 0

    def add(self, cols: list[np.ndarray], counts: np.ndarray) -> bool:
        """Whether what has been combined is still large."""
        self.held.append((cols, counts))
        self.size += len(counts)
        if self.size < self.most:
            return False
        cols, counts = self.take()
        self.held, self.size = [(cols, counts)], len(counts)
        return self.size > self.most // 2

    def take(self) -> tuple[list[np.ndarray], np.ndarray]:
        held, self.held, self.size = self.held, [], 0
        if not held:
            return [], np.empty(0, np.int64)
        return self.combine([np.concatenate(c) for c in zip(*(c for c, _ in held), strict=True)], np.concatenate([n for _, n in held]))


def by_context(cols: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams ordered by their context's hash and the last word."""
    return combine_rows([context_hash(cols[:-1]), cols[-1]], cols, counts)


def by_owner(cols: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams ordered by the second word, the first and the others; two words to a sort key."""
    keys = [cols[1], cols[0], *cols[2:]] if len(cols) > 2 else cols
    pairs = [keys[i].astype(np.uint64) << np.uint64(32) | keys[i + 1].astype(np.uint64) if i + 1 < len(keys) else keys[i] for i in range(0, len(keys), 2)]
    return combine_rows(pairs, cols, counts)


def _count_grams(rows: DataFrame, model: Model) -> None:
    path, buckets, order, spark = model.path, model.buckets, model.order, rows.sparkSession

    def parts_of(cols: list[np.ndarray], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """One row of packed columns for each bucket; of single words, the words' own buckets."""
        if len(cols) == 1:
            bucket = np.searchsorted(np.array(model.bases), cols[0], side="right") - 1
        else:
            bucket = model.bucket([c.astype(np.int64) for c in cols[:-1]], cols[-1])
        at, edges = by_bucket(bucket, model.gram_buckets)
        lead = [1, 0, *range(2, len(cols))] if len(cols) > 2 else list(range(len(cols)))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            some = at[edges[b] : edges[b + 1]]
            yield batch_of(["bucket", "data"], np.array([b], np.int32), [pack([*(cols[j][some] for j in lead), counts[some]])])

    def read_rows(data: bytes, k: int) -> tuple[list[np.ndarray], np.ndarray]:
        *cols, counts = unpack(data, k + 1)
        cols = [c.astype(np.uint32) for c in cols]
        return ([cols[1], cols[0], *cols[2:]] if k > 2 else cols), counts

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Rows(by_owner)
        end = int(model.ranks(np.array([END], np.uint64))[0])
        for batch in batches:
            texts = batch.column(0)
            for a, z in runs(texts):
                distinct, place, ends = tokens(texts[a:z])
                sequence, at = model.sequence(model.ranks(distinct)[place], ends, end)
                sequence = sequence.astype(np.uint32)
                if total.add([sequence[at - (order - 1) + j] for j in range(order)], np.ones(len(at), np.int64)):
                    yield from parts_of(*total.take())
        cols, counts = total.take()
        if cols:
            yield from parts_of(cols, counts)

    def merge(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, b = Rows(by_context, 3_000_000), TaskContext.get().partitionId()
            for batch in batches:
                for data in batch.column(1).to_pylist():
                    if data:
                        total.add(*read_rows(data, k))
            cols, counts = total.take()
            cols = cols or [np.empty(0, np.uint32)] * k
            hashes = context_hash(cols[:-1])
            start = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.empty(0, np.int64)
            sums = [np.add.reduceat(x, start) if len(start) else np.empty(0, np.int64) for x in (counts, (counts == 1).astype(np.int64), (counts == 2).astype(np.int64))]
            long = np.flatnonzero(np.diff(np.append(start, len(hashes))) > LONG)
            sums = np.stack(sums, axis=1)[long]
            write_arrays(f"{path}/grams-{k}-{b:05d}", [hashes[start].astype("<u8"), *run_starts(np.append(start, len(hashes))), long.astype("<u4"), sums.astype("<u8"), cols[-1].astype("<u4"), *small_numbers(counts)])
            if len(counts):
                yield from parts_of(*by_owner(cols[1:], np.ones(len(counts), np.int64)))

        return run

    def merge_kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        kinds = np.zeros(model.bases[p + 1] - model.bases[p], np.int64)
        for batch in batches:
            for data in batch.column(1).to_pylist():
                if data:
                    words, counts = unpack(data, 2)
                    kinds[words - model.bases[p]] += counts  # distinct words within one row
        write_arrays(f"{path}/after-{p:05d}", small_numbers(kinds))
        yield batch_of(["bucket"], [p])

    def dealt(df: DataFrame, n: int) -> DataFrame:
        """By bucket, with a row for each bucket, so that every task runs and writes its file."""
        nothing = spark.range(n).select(F.col("id").cast("int").alias("bucket"), F.unhex(F.lit("")).alias("data"))
        return df.unionByName(nothing).repartitionById(n, "bucket")

    shape = "bucket int, data binary"
    df = rows.mapInArrow(grams, shape)
    for k in range(order, 1, -1):
        df = dealt(df, model.gram_buckets).mapInArrow(merge(k), shape)
    with batches_of(spark):
        dealt(df, buckets).mapInArrow(merge_kinds, "bucket long").collect()

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                found = [(k, model.grams_file(k, b)[-2]) for k in range(2, order + 1)] + ([(1, model.kinds_file(b)[0])] if b < buckets else [])
                for k, low in found:
                    yield batch_of(["k", *"abcdef"], [k], *[[int(n)] for n in np.bincount(np.minimum(low, 5), minlength=6)])

    each = spark.range(model.gram_buckets).mapInArrow(numbers, "k long, a long, b long, c long, d long, e long, f long")
    model.seen, model.discounts = np.zeros((order + 1, 6)), np.zeros((order + 1, 4))
    for r in each.groupBy("k").agg(*[F.sum(c).alias(c) for c in "abcdef"]).collect():
        model.seen[r.k] = r[1:]
        model.discounts[r.k] = discounts(model.seen[r.k])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with n_tokens, n_known, base_score and score, replacing columns of these names.

    Whole texts are scored; a null text is an empty one, whose only token is
    the end. perplexity is 10 ** (-score / n_tokens). Equal texts have equal
    scores, whatever their keys; an empty table stays empty.
    """
    added = ["n_tokens", "n_known", "base_score", "score"]
    docs = docs.drop(*added)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch, text)
            for a, z in runs(texts):
                got = model.score(texts[a:z])
                yield pa.RecordBatch.from_arrays([*(c[a:z] for c in batch.columns), *(pa.array(got[k]) for k in added)], [*names, *added])

    schema = type(docs.schema)(list(docs.schema.fields))
    for name in added:
        schema = schema.add(name, "long" if name[0] == "n" else "double")
    return docs.mapInArrow(run, schema)


def train_and_score(docs: DataFrame, known: Column, key: str = "doc_id", text: str = "text", order: int = 3) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of all rows, learning from those where known holds."""
    model = train(docs.filter(known), text, order)
    kept = docs.select(F.col(key).alias("key"), (~known).alias("held_out"), F.col(text).cast("string").alias("text"))
    scored = score(kept, model).drop("text").withColumn("train_tokens", F.lit(model.n_tokens).cast("long"))
    return scored.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
