import numpy as np
import pyarrow as pa

from plyforge.llm import langid

WORDS = {"en": "the and of with that this is was", "de": "und der die das nicht mit ein", "fr": "le la les des et que dans pour", "es": "el los las del que una por con"}


def sentences(rng, lang, n):
    return [" ".join(rng.choice(WORDS[lang].split(), rng.integers(5, 40))) for _ in range(n)]


def test_held_out_accuracy_and_edges(spark):
    rng = np.random.default_rng(3)
    rows = [(i, t, lang, "x") for i, (lang, t) in enumerate((lang, t) for lang in WORDS for t in sentences(rng, lang, 60))]
    rows += [(1000, None, "en", "x"), (1001, "", "de", "x"), (1002, "12 !? \U0001f600", None, "x"), (None, "the and of", None, "x"), (1003, "the and " * 200_000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.fit(docs, known=docs.doc_id % 5 != 0, dims=1024)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "lang", "lang_pred", "score"}
    held = [r for r in rows if r[0] is not None and r[0] < 1000 and r[0] % 5 == 0]
    assert np.mean([got[r[0]].lang_pred == r[2] for r in held]) >= 0.97
    assert [got[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred == "en" == got[None].lang_pred
    assert all(0 <= r.score <= 1 for r in got.values())


def test_batches_score_as_single_texts():
    rng = np.random.default_rng(4)
    texts = [t for lang in WORDS for t in sentences(rng, lang, 20)] + ["", "a", "ab", "abc", "é"]
    model = langid.LanguageModel.fit(texts[:80], [lang for lang in WORDS for _ in range(20)], 512)
    together = model.margins(pa.array(texts))
    plain = (langid.features(texts, 512) @ model.weights[:, :-1].T + model.weights[:, -1]) * model.scale
    assert np.allclose(together, plain, atol=1e-4)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert langid.identify(docs, langid.fit(docs, known=docs.doc_id >= 0)).collect()[0].lang_pred == "und"
    assert langid.identify(docs.limit(0), langid.fit(docs.limit(0), known=docs.doc_id >= 0)).count() == 0


def test_copies_leave_the_others_their_share(spark):
    rows = [(f"copied text number {i % 2}", "en") for i in range(400)] + [(f"own words {i} of a text", "en") for i in range(50)] + [(f"eigene wörter {i}", "de") for i in range(30)] + [("x", None), (None, "en")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    texts, langs = langid.sample_labelled(docs, "text", "lang", docs.lang.isNotNull(), 60, 10**9)
    assert len(set(texts)) == len(texts) == 82 and langs.count("de") == 30
    few, _ = langid.sample_labelled(docs, "text", "lang", docs.lang.isNotNull(), 60, 600)
    assert 0 < len(few) < 60


def plain_margin(text, weights, dims):
    """A machine's margin of one text from its n-grams, one by one."""
    data = bytes(c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in text.encode())
    total = 0.0
    for n in range(1, 5):
        for i in range(len(data)):
            gram = int.from_bytes(data[i : i + n], "little")
            total += float(weights[(((gram + n * 0x9E37) * 0x9E3779B1 & 0xFFFFFFFF) >> 16) % dims])
    return (total / (4 * len(data)) if data else 0.0) + float(weights[dims])


def test_predictions_by_brute_force():
    rng = np.random.default_rng(14)
    texts = [t for lang in WORDS for t in sentences(rng, lang, 25)]
    model = langid.LanguageModel.fit(texts, [lang for lang in WORDS for _ in range(25)], 256)
    tried = [*texts[::9], "A", "The 12 und", "été où", "", "...", "x" * 300, "Straße 7"]
    lang, score = model.predict(pa.array(tried))
    for text, got, sure in zip(tried, lang, score, strict=True):
        margin = {(a, b, w): plain_margin(text, model.weights[k], 256) * model.scale[k] for k, (a, b, w) in enumerate(model.machines)}

        def winner(names, within):
            votes, least = dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
            for (a, b, w), m in margin.items():
                if w == within and a in names and b in names:
                    p = 1 / (1 + np.exp(-np.clip(m, -30, 30)))
                    votes[a] += (m > 0) + 1e-3 * np.tanh(m / 8)
                    votes[b] += (m <= 0) - 1e-3 * np.tanh(m / 8)
                    least[a], least[b] = min(least[a], p), min(least[b], 1 - p)
            best = max(names, key=lambda s: (votes[s], -names.index(s)))
            return best, least[best]

        if not any(c.isalpha() for c in text):
            assert (got, sure) == ("und", 0.0)
            continue
        fam, p = winner(sorted({langid.family(s) for s in model.languages}), False)
        want, q = winner([s for s in model.languages if langid.family(s) == fam], True)
        assert got == want and abs(sure - p * q) < 1e-4
