import random

import numpy as np
import xxhash

from plyforge.llm import simhash
from plyforge.llm.components import components


def brute_fingerprint(text):
    words = [w for w in (text or "").translate(str.maketrans("".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123))))).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(root(i), []).append(ids[i])
    return [min(groups[root(i)]) for i in range(len(fps))]


def test_query_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(50)] + ["É", "ÀB", "Zz"]
    texts = [None, "", "  \n", "one", "one two", "ONE Two", "one two three", "a b c d", " ".join(["same"] * 3000)]
    for _ in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 200))]
        texts.append(" ".join(words))
        for _ in range(3):
            words = list(words)
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append("\n ".join(words))
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(3, "one", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id string")
    got = sorted(tuple(r) for r in simhash.near_duplicates(docs).collect())
    fps = [brute_fingerprint(r[1]) for r in rows]
    want = sorted((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, brute_components(fps, [r[0] for r in rows])))
    assert got == want
    assert len({w[2] for w in want}) < len(want) - 20  # some are linked


def test_links_of_dense_groups(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 6, dtype=np.int64)
    fps = sorted({int(b) ^ sum(1 << int(x) for x in rng.integers(0, 63, rng.integers(0, 4))) for b in base for _ in range(60)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = brute_components([f & (2**64 - 1) for f in fps], fps)
    for most in (1000, 5):  # the second deals every group anew
        roots = {r.node: r.root for r in components(simhash.links(df, max_group=most)).collect()}
        assert [roots.get(f, f) for f in fps] == want


def test_large_group_agrees_with_small_path():
    rng = np.random.default_rng(2)
    fp = np.unique(np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 20, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 20, 300, dtype=np.uint64)))
    refs = np.array(simhash.references(8), np.int64).view(np.uint64)
    coords = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)
    a, b = simhash.group_links(fp, coords, 2)
    want = brute_components([int(f) for f in fp], list(range(len(fp))))
    assert len(a) == len(fp) - len(set(want))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []


def test_a_fingerprint_that_half_the_rows_share(spark):
    texts = ["hot words that very many rows share"] * 1300 + [f"own words {i} of row {i * 7}" for i in range(1200)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = simhash.near_duplicates(docs)
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == len(texts) and {rows[i].component_id for i in range(1300)} == {0} and rows[2501].component_id == 2500
    fps = [brute_fingerprint(t) for t in [texts[0], *texts[1300:]]]
    ids = [0, *range(1300, len(texts))]
    assert [rows[i].component_id for i in ids] == brute_components(fps, ids)


def test_join_by_key_splits_hot_keys(spark):
    from pyspark.sql import functions as F

    from plyforge.llm.common import join_by_key

    rows = spark.range(3000).select("id", F.when(F.col("id") < 2000, 1).otherwise(F.col("id")).alias("k"))
    about = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    got = {r.id: r.m for r in join_by_key(rows, about, "k", "n", 3000).collect()}
    assert got == {i: 1999 if i < 2000 else i for i in range(3000)}


def test_a_large_group_is_dealt_down(spark):
    fps = [(i << 3) & 0xFFFF | 0x5A5A << 40 for i in range(8192)]  # all share 48 bits
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    pairs = simhash.links(df, max_group=200).collect()
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r in pairs:
        parent[root(r.a)] = root(r.b)
    assert len({root(f) for f in fps}) == 1 and all((r.a ^ r.b).bit_count() <= 2 for r in pairs)
