import random

import corpus_pipeline
from plyforge.llm import common, near_copies


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(texts, least=0.8):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(sets))]


def planted(seed=11):
    """Texts with copies of one to six changed words, long and short ones, and a line that many share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    line = " ".join(rng.choice(words) for _ in range(15))
    texts = ["", " \n", "one", "ONE", "one two three four five", "one two three four five six"]
    for k in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([12, 60, 150, 400]))]
        texts.append(" ".join(base) + (f" {line}" if k % 2 else ""))
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randint(1, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy) + (f" {line}" if k % 2 else ""))
    return texts


def test_stage_catches_planted_near_copies(spark):
    texts = planted()
    want = components(texts)
    assert len(set(want)) < len(texts) - 60
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], schema).repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == sorted(set(want))


def test_small_sets_are_compared_whatever_their_fingerprints(spark):
    """Pairs of four and five shingles at 0.8 exactly; about one in ten thousand is over 24 bits, so the radius is narrowed here."""
    rng = random.Random(5)
    texts = []
    for _ in range(200):
        words = [f"w{rng.randrange(10**6)}" for _ in range(9)]
        texts += [" ".join(words), " ".join(words[:-1])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs, radius=8).collect()}
    assert [got[i] for i in range(400)] == components(texts) == [i // 2 * 2 for i in range(400)]


def test_links_of_dense_groups(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(150):  # a family in which some pairs are far apart
        copy = list(base)
        for _ in range(rng.randint(1, 9)):
            copy[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    want = components(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    path = common.scratch(spark, "test")
    rows = common.materialize(near_copies.with_set(docs, path, "doc_id", "text", 5), "sets")
    key_of = {r.set: r.key for r in rows.collect()}
    for most, hot in ((1000, 20_000), (20, 20_000), (20, 30)):  # the second deals groups by pairs of blocks, the third by a sample's counts
        monkeypatch.setattr(near_copies, "HOT", hot)
        parent = {}

        def root(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for r in near_copies.links(rows.drop("key"), path, max_group=most).collect():
            x, y = root(key_of[r.a]), root(key_of[r.b])
            if x != y:
                parent[max(x, y)] = min(x, y)
        assert [root(i) for i in range(len(texts))] == want
