import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from plyforge.llm import divergence
from plyforge.llm.queries import ORACLES

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, most=50):
    rows = [((lang or ""), (source or ""), WORD.findall((text or "").translate(UPPER))) for text, lang, source in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        docs = Counter(w for r in own for w in set(r[2]))
        kept = {w for w, n in docs.items() if n >= least}
        count = {s: Counter(w for r in own if r[1] == s for w in r[2] if w in kept) for s in {r[1] for r in own}}
        whole = sum(count.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        for s in p:
            pairs = sorted(((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode()) for o in p if o != s))
            terms = sorted((q[w] - p[s][w], w.encode()) for w in kept if count[s][w] and p[s][w] > q[w])[:most]
            out += [(lang, s, part, item.decode(), -v, i) for part, found in (("pair", pairs), ("term", terms)) for i, (v, item) in enumerate(found, 1)]
    return sorted(out)


def texts(rng, n, words, sources, power):
    """Sources of very different sizes, each with words of its own, most words rare."""
    vocabulary = np.array([f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(words)])
    rows = []
    for _ in range(n):
        s = int(sources * rng.random() ** power)
        at = (words * rng.random(rng.integers(0, 25)) ** 3).astype(int)
        rows.append((" ".join(vocabulary[(at + 7 * s * (rng.random(len(at)) < 0.4).astype(int)) % words]), "x" if rng.random() < 0.7 else "y", f"s{s}"))
    return rows


@pytest.mark.parametrize("heavy_share", [0.0, 0.25, 1.0])
@pytest.mark.parametrize("sizes", [(128, 512), (3, 5)])
def test_equals_brute_force_however_it_is_split(spark, monkeypatch, heavy_share, sizes):
    monkeypatch.setattr(divergence, "TILE", sizes[0])
    monkeypatch.setattr(divergence, "BLOCK", sizes[1])
    rows = texts(np.random.default_rng(3), 700, 120, 11, 2)
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    got = sorted(map(tuple, divergence.divergence(df, least_docs=6, heavy_share=heavy_share).collect()))
    want = brute(rows, 6)
    assert got == want and {r[2] for r in want} == {"pair", "term"}


def test_edges(spark):
    rows = [(None, None, None), ("", "", "a"), ("Ünder ÄB äb K1k", "l", "a"), ("undKr 12 _", "l", None), ("x" * 200_000 + " b", "l", "b"), ("one", "alone", "c"), ("one", "alone", "c"), ("b a", "l", "a"), ("b a", "l", "a")]
    df = spark.createDataFrame([(*r, 1, "t", "q") for r in rows], "text string, lang string, source string, value int, term string, p string")
    for least in (1, 2, 30):
        assert sorted(map(tuple, divergence.divergence(df, least_docs=least).collect())) == brute(rows, least)
    got = divergence.divergence(df.limit(0))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and got.count() == 0


def test_shares_are_exact_past_64_bits(spark):
    df = spark.createDataFrame([(3_000_000_000_000, 9_000_000_000_000, 1000)], "n long, total long, v long")
    assert df.selectExpr(divergence.share("n", "total")).first()[0] == 1 + 10**9 * (3 * 10**12 + 5) // (9 * 10**12 + 5000)


def test_query_equals_sql(spark):
    from plyforge.llm.queries import op11_source_divergence

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(ORACLES["op11_source_divergence"])
    names = [c[0] for c in want.description]
    got = op11_source_divergence(spark, sf)
    assert got.columns == names and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
