"""Each stage of the pipeline against brute force on its own input."""

import numpy as np
import pytest

import corpus_pipeline
from plyforge.llm import simhash
from plyforge.llm.common import materialize

from .test_decontaminate import brute as contaminated
from .test_langid import WORDS, sentences
from .test_simhash import brute_components, brute_fingerprint


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    texts, langs = [], []
    for lang in WORDS:
        for t in sentences(rng, lang, 60):
            texts.append(t)
            langs.append(lang)
    items = [" ".join(f"q{k}x{i}" for i in range(20)) for k in range(3)]
    texts += [f"{texts[0]} {items[0]}", items[1], None, "", "12 34 !!", *texts[:5]]
    langs += ["en", "en", "en", None, "de", *langs[:5]]
    bad = [" ".join(f"{w}%%%" for w in t.split()) for t in texts[:90]]
    n = len(texts)
    rows = [(i, t, lang, f"s{i % 3}", len(t or "")) for i, (t, lang) in enumerate(zip(texts + bad, langs + langs[:90]))]
    labels = [(i, int(i < n), 0) for i in range(len(rows)) if i % 10]
    path = tmp_path_factory.mktemp("sf")
    for name, data, schema in (
        ("documents", [*rows, rows[3], (None, texts[1], "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", list(enumerate(items)), "item_id long, text string"),
    ):
        spark.createDataFrame(data, schema).coalesce(2).write.parquet(f"{path}/{name}.parquet")
    return str(path), n


def test_every_stage(spark, corpus):
    path, n_clean = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.select("doc_id", "text", "lang", "source", "n_chars").collect()
        docs = materialize(stage(spark, docs, path), name)
        kept[name] = (before, docs.collect())
        if name != "best_fit_packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            assert set(map(tuple, kept[name][1])) <= set(map(tuple, before))
    before, after = kept["language_id"]
    assert sorted(map(str, after)) == sorted(str(r) for r in before if r.text and any(c.isalpha() for c in r.text))
    before, after = kept["quality_classifier"]
    clean = [r for r in before if r.doc_id is not None and r.doc_id < n_clean]
    assert len([r for r in after if r.doc_id is not None and r.doc_id < n_clean]) >= 0.97 * len(clean)
    assert len([r for r in after if r.doc_id is not None and r.doc_id >= n_clean]) <= 5
    before, after = kept["simhash_near_dedup"]
    ids = [(-1 if r.doc_id is None else r.doc_id) for r in before]
    reps = brute_components([brute_fingerprint(r.text) for r in before], [1 << 60 if i < 0 else i for i in ids])
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in after if r.doc_id is not None) == sorted({r for r in reps if r < 1 << 60})
    before, after = kept["benchmark_decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    bad = {r[0] for r in contaminated([(r.doc_id, r.text) for r in before], items) if r[5]}
    assert bad and {r.doc_id for r in after} == {r.doc_id for r in before} - bad
    before, after = kept["best_fit_packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before} and len({r.sequence_id for r in after}) <= sum(r.length for r in after) // 1024 + 2


def test_run_over_nothing(spark, corpus, tmp_path):
    path, _ = corpus
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_null_ids_are_kept_apart(spark):
    docs = spark.createDataFrame([(None, "one two three four", "en", "s", 1), (None, "other words are here now", "en", "s", 1), (None, "one two three four", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 2
    assert {r.component_id for r in simhash.near_duplicates(docs).collect()} == {None}


def test_unlike_texts_of_one_id_both_stay(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a, "en", "s", 1), (5, b, "en", "s", 1), (5, b, "en", "s", 1), (7, b + " more", "en", "s", 2), (None, a, "en", "s", 1), (9, None, None, None, None), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == [(3, ""), (5, a), (5, b)]
