from collections import Counter
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from plyforge.llm import hilbert
from plyforge.llm.common import scratch


def test_curve_visits_every_cell_by_single_steps():
    for d, bits in ((2, 3), (3, 2), (4, 1)):
        cells = np.array(list(product(range(1 << bits), repeat=d)))
        index = hilbert.hilbert_index(cells, bits)
        assert sorted(index.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def check(df, got, shards):
    counts = Counter(r.shard for r in got)
    assert len(got) == df.count() and max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for s in counts:
        rows = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in rows] == list(range(counts[s]))
        assert [r.hilbert for r in rows] == sorted(r.hilbert for r in rows)
    ends = sorted((r.shard, r.slot, r.hilbert) for r in got)
    assert [e[2] for e in ends] == sorted(e[2] for e in ends)


def test_shards(spark):
    rng = np.random.default_rng(1)
    rows = [(i, str(rng.choice(["en", "de", "fr"])), f"s{rng.integers(0, 9)}", int(rng.integers(1, 5000)), "clash") for i in range(301)]
    rows += [(7, "en", "s1", 3, "clash")] * 150 + [(None, None, None, None, None)] * 4  # a hot row, and nulls
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, size long, shard string").repartition(5)
    dims = {"lang": hilbert.text_rank(F.col("lang")), "source": hilbert.text_rank(F.col("source")), "size": F.col("size"), "id": F.col("doc_id")}
    for shards in (8, 3):
        out = hilbert.hilbert_shards(df, dims, "doc_id", shards)
        check(df, out.collect(), shards)
    bounds = hilbert.shard_bounds(out, ["size", "lang"]).collect()
    assert len(bounds) == 3 and sum(b.n_rows for b in bounds) == len(rows)
    path = scratch(spark, "hilbert")
    hilbert.write_shards(out, path, 3)
    assert spark.read.parquet(path).count() == len(rows)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "doc_id long, size long")
    dims = {"size": F.col("size"), "id": F.col("doc_id")}
    got = hilbert.hilbert_shards(df, dims, "doc_id", 8).collect()
    check(df, got, 8)
    assert hilbert.hilbert_shards(df.limit(0), dims, "doc_id", 8).count() == 0


def test_text_rank_orders_strings(spark):
    words = ["", "a", "ab", "abc", "b", "de", "en", "é", "日本"]
    got = [r.r for r in spark.createDataFrame([(w,) for w in words], "w string").select(hilbert.text_rank(F.col("w")).alias("r")).collect()]
    assert got == sorted(got)


def test_filters_skip_shards(spark):
    """Few values or many: a filter on any dimension leaves a good part of the shards unread; and odd column names stay."""
    rng = np.random.default_rng(3)
    rows = [(i, ["de", "en", "es", "fr"][int(rng.integers(4))], int(rng.integers(1, 5000)), 1, 2) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, size long, _m int, _p int").repartition(4)
    dims = {"lang": hilbert.text_rank(F.col("lang")), "size": F.col("size")}
    out = hilbert.hilbert_shards(df, dims, "doc_id", 16)
    assert {"_m", "_p"} <= set(out.columns)
    bounds = hilbert.shard_bounds(out, ["lang", "size"]).collect()
    skipped = lambda lo, hi, c: np.mean([r[f"max_{c}"] < lo or r[f"min_{c}"] > hi for r in bounds])
    assert min(skipped(x, x, "lang") for x in ("de", "fr")) >= 0.6 and min(skipped(x, x, "lang") for x in ("en", "es")) >= 0.3
    assert all(skipped(a, a + 300, "size") >= 0.5 for a in range(100, 4700, 500))


def test_query_columns(spark, tmp_path):
    """Size, checksum, law and slots of the registered query, against Python."""
    import zlib

    from plyforge.llm import queries

    texts = ["plain", "É ü 日本", "", None, "plain", "x" * 3000, "a\nb"] * 5
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op7_hilbert_shards(spark, str(tmp_path)).collect()}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        assert (got[i].size, got[i].text_crc32, got[i].law, got[i].grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    counts = Counter(r.shard for r in got.values())
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in got.values() if r.shard == s) == list(range(n)) for s, n in counts.items())
