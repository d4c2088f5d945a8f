import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from plyforge.llm import kneser_ney

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def words(text):
    out, word = [], ""
    for c in text or "":
        if c in SPACE:
            out, word = out + [word] * bool(word), ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return out + [word] * bool(word)


def estimates(counts):
    """Chen and Goodman's three discounts, written out; half a count where their numbers are lacking."""
    n = [sum(1 for x in counts if x == k) for k in range(5)]
    out = [0.0, 0.5, 0.5, 0.5]
    for k in (1, 2, 3):
        if n[k] and n[1]:
            out[k] = min(max(k - (k + 1) * n[1] / (n[1] + 2 * n[2]) * n[k + 1] / n[k], 0.0), float(k)) or 0.5
    return out


def brute(train, texts, order):
    """Textbook formulas on dictionaries."""
    uni, top = Counter(), Counter()

    def grams(t, k):
        seq = [None] * (order - 1) + words(t) + ["</s>"]
        return [tuple(seq[i - k + 1 : i + 1]) for i in range(order - 1, len(seq))]

    for t in train:
        uni.update(words(t) + ["</s>"])
        top.update(grams(t, order))
    levels = {order: top}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    d = {k: estimates(levels[k].values()) for k in levels}
    after = {k: defaultdict(list) for k in levels}
    for k, have in levels.items():
        for g, c in have.items():
            after[k][g[:-1]].append(c)
    total, distinct = sum(uni.values()), len(uni)

    def probability(g):
        k = len(g)
        lower = probability(g[1:]) if k > 1 else 1 / (distinct + 1)
        seen = after[k].get(g[:-1], [])
        if not seen:
            return lower
        c = levels[k].get(g, 0)
        return (max(c - d[k][min(c, 3)], 0) + sum(d[k][min(x, 3)] for x in seen) * lower) / sum(seen)

    out = []
    for t in texts:
        seq = words(t) + ["</s>"]
        base = sum(math.log10((uni[w] + 1) / (total + distinct + 1)) for w in seq)
        out.append((len(seq), sum(uni[w] > 0 for w in seq), total, base, sum(math.log10(probability(g)) for g in grams(t, order))))
    return out, sum(probability((w,)) for w in [*uni, "no such word"])


@pytest.mark.parametrize(("order", "bucket_bytes"), [(3, 24 << 20), (3, 4000), (2, 4000), (4, 6000)])
def test_against_brute_force(spark, order, bucket_bytes):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "Zebra", "the"]
    weight = 1 / np.arange(1, len(vocabulary) + 1)
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 60), p=weight / weight.sum())) for _ in range(80)]
    texts += [None, "", " \t\r\n", "A a\x0bA a", "unknown Unknown", "the " * 3000]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (None, "the w1", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    known = docs.doc_id.isNull() | (docs.doc_id % 7 != 2)
    model = kneser_ney.train(docs.filter(known), order=order, bucket_bytes=bucket_bytes)
    assert (len(model.hot) > 1) == (bucket_bytes < 10_000)
    got = sorted(((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in kneser_ney.score(docs, model).collect()))
    want, total = brute([r[1] for r in rows if r[0] is None or r[0] % 7 != 2], [r[1] for r in rows], order)
    assert abs(total - 1) < 1e-9 and model.n_tokens == want[0][2]
    want = sorted((-1 if r[0] is None else r[0], n, k, b, s) for r, (n, k, _, b, s) in zip(rows, want))
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and np.allclose(g[3:], w[3:], rtol=1e-9), (g, w)


def test_numbers_of_255_and_more(spark):
    x = np.array([0, 254, 255, 256, 3, 1 << 40])
    low, large = kneser_ney.small_numbers(x)
    assert kneser_ney.numbers_at(low, large, np.array([5, 0, 2, 3, 1, 4])).tolist() == [1 << 40, 0, 255, 256, 254, 3]


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(2, "a b"), (9, None)], "doc_id long, text string")
    out = kneser_ney.train_and_score(docs, docs.doc_id < 0).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in sorted(out)] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert kneser_ney.train_and_score(docs.limit(0), docs.doc_id < 0).count() == 0


def test_better_than_the_base_on_held_out_text(spark):
    rng = np.random.default_rng(4)
    chain = {i: rng.permutation(30)[:3] for i in range(30)}
    texts = []
    for _ in range(140):
        w, out = 0, []
        for _ in range(50):
            w = int(rng.choice(chain[w]))
            out.append(f"v{w}")
        texts.append(" ".join(out))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = [r for r in kneser_ney.train_and_score(docs, docs.doc_id % 7 != 2).collect() if r.held_out]
    assert held and all(r.score > r.base_score + 10 for r in held)


def test_long_words_that_a_polynomial_confuses():
    for letters in (256, 512, 1024, 2048, 4096):
        one = "".join("ab"[i.bit_count() % 2] for i in range(letters))
        two = one.translate(str.maketrans("ab", "ba"))
        texts = pa.array([one, two, f"{one} {two} x", "y" * (1 << 21), one + "a"])
        distinct, place, ends = kneser_ney.tokens(texts)
        assert len(distinct) == 5 and ends.tolist() == [0, 1, 2, 5, 6, 7] and place[0] == place[2] != place[1] == place[3]
    short = pa.array([f"w{i:0{n}d}" for n in (3, 100, 253, 254, 255, 256) for i in range(200)])
    assert len(kneser_ney.tokens(short)[0]) == 1200
