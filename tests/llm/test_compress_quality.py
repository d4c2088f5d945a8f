import numpy as np
import zstandard

from plyforge.llm import compress_quality


def texts(rng, words, n):
    return [" ".join(rng.choice(words, rng.integers(20, 200))) for _ in range(n)]


def test_held_out_accuracy_and_edges(spark):
    rng = np.random.default_rng(3)
    good = texts(rng, [f"{a}{b}ing" for a in "abcdefgh" for b in "opqrst"], 150)
    bad = texts(rng, [f"{a}{b}%%$" for a in "abcdefgh" for b in "opqrst"], 90)
    rows = [(i, t, "x", 0.5) for i, t in enumerate(good + bad)] + [(900, None, "x", 0.1), (901, "", "x", 0.1), (902, "long " * 300_000, "x", 0.1), (None, "no key", "x", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    marks = [(i, int(i < 150), 0) for i in range(240)] + [(900, 1, 0), (901, 0, 0), (5, 1, 1), (None, 1, 0), (7, None, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = compress_quality.fit(docs, labels, known=labels.doc_id % 3 != 1)
    got = {r.doc_id: r for r in compress_quality.score(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert np.mean([got[i].predicted == int(i < 150) for i in range(240) if i % 3 == 1]) > 0.95
    assert got[900].score == got[901].score == model.share


def test_sizes_and_scores_against_the_library(spark):
    """Every text on its own, by the library's dictionaries and the curve written out."""
    rng = np.random.default_rng(5)
    good, bad = texts(rng, [f"{a}{b}ing" for a in "abcdefgh" for b in "opqrst"], 90), texts(rng, [f"{a}{b}%%$" for a in "abcdefgh" for b in "opqrst"], 60)
    model = compress_quality.fit_texts(good, bad)
    assert len(model.good) == len(model.bad) == 6
    tried = [*good[:5], *bad[:5], "x", "short", "É" * 2000, "neither one"]
    got = {r.text: r.score for r in compress_quality.score(spark.createDataFrame([(t,) for t in tried], "text string"), model).collect()}
    for t in tried:
        raw, sums = t.encode(), []
        for side in (model.good, model.bad):
            sums.append(0)
            for d in side:
                one = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
                sums[-1] += sum(len(one.compress(raw[k : k + 512])) for k in range(0, len(raw), 512))
        difference = (sums[1] - sums[0]) / (sums[1] + sums[0])
        at, value = model.curve.at, model.curve.value
        k = int(np.searchsorted(at, difference))
        want = value[0] if k == 0 else value[-1] if k == len(at) else value[k - 1] + (value[k] - value[k - 1]) * (difference - at[k - 1]) / (at[k] - at[k - 1])
        assert abs(got[t] - want) < 1e-9, t


def test_curve_against_the_definition():
    """Isotonic regression at i is the largest over a <= i of the smallest over b >= i of the mean of a ... b."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 40, 200) / 10
    y = (rng.random(200) < x / 5).astype(float)
    curve = compress_quality.Curve.fit(x, y, 0.5)
    values = np.unique(x)
    mean = lambda a, b: y[(x >= values[a]) & (x <= values[b])].mean()
    steps = {}
    for i, v in enumerate(values):
        steps.setdefault(round(max(min(mean(a, b) for b in range(i, len(values))) for a in range(i + 1)), 9), []).append(v)
    assert len(curve.at) == len(steps)
    for (level, members), at, value in zip(sorted(steps.items()), curve.at, curve.value):
        n = np.isin(x, members).sum()
        assert abs(at - x[np.isin(x, members)].mean()) < 1e-9 and abs(value - (level * n + 0.5) / (n + 1)) < 1e-6


def test_few_labels_still_give_a_curve():
    good, bad = [f"plain words of text {i} and more" for i in range(4)], [f"$$$ %% {i} $$$ %% ##" for i in range(4)]
    for n in (4, 1):
        model = compress_quality.fit_texts(good[:n], bad[:n])
        assert model.curve is not None and model.scores(["plain words of text"])[0] > 0.5 > model.scores(["$$$ %% $$$"])[0]


def test_bounds_and_labels_of_both_kinds(spark):
    rng = np.random.default_rng(6)
    rows = [(i, t, 7) for i, t in enumerate(texts(rng, ["aa", "bb", "cc"], 60) + texts(rng, ["x%", "y%", "z%"], 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted int")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(0, 0), (100, 1)], "doc_id long, quality int")
    for bounds in ({"most_texts": 40}, {"most_bytes": 20_000}, {}):
        model = compress_quality.fit(docs, labels, known=labels.doc_id >= 0, **bounds)
        got = compress_quality.score(docs, model)
        assert got.columns == ["doc_id", "text", "score", "predicted"]
        assert np.mean([r.predicted == int(r.doc_id < 60) for r in got.collect()]) > 0.9


def test_one_class_or_none(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    model = compress_quality.fit(docs, labels, known=labels.doc_id > 0)
    assert compress_quality.score(docs, model).collect()[0].score == 2 / 3
    assert compress_quality.score(docs.limit(0), compress_quality.fit(docs.limit(0), labels.limit(0), known=labels.doc_id > 0)).count() == 0
