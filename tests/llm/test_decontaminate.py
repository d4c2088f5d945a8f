import hashlib
import random
import re

from plyforge.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    wins = [(i, w[s : s + 13]) for i, t in items for w in [words(t)] if w for s in range(max(1, len(w) - 12))]
    out = []
    for doc, text in docs:
        w, places, named = words(text), set(), set()
        for i, win in wins:
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    places |= set(range(s, s + len(win)))
                    named.add(i)
        names = ",".join(sorted(str(i) for i in named if i is not None))
        out.append((-1 if doc is None else doc, len(w), len(places), len(named - {None}), hashlib.sha256(names.encode()).hexdigest(), bool(places) and 20 * len(places) >= len(w)))
    return sorted(out)


def cases():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "Ünï", "日本"]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate((13, 14, 40, 20, 5, 3, 13))]
    items += [(50, "rare"), (51, "two Words"), (52, None), (53, " ,.; "), (None, "nameless item here"), (0, items[0][1]), (60, items[2][1]), (100, "same " * 30)]
    docs = [(i, " ".join(say(rng.randint(0, 120)))) for i in range(12)]
    for i, t in items[:8]:
        docs.append((20 + i, " ".join(say(30)) + "\n" + t.upper().replace(" ", ", ") + "! " + " ".join(say(40))))
        docs.append((40 + i, t))
        docs.append((60 + i, " ".join(words(t)[:12]) + " " + " ".join(say(50))))
    docs += [(90, None), (91, ""), (92, "?!"), (93, "rare"), (94, "x rare y two words z"), (95, "same " * 500), (95, "same " * 500), (95, "other"), (None, "Nameless item HERE"), (96, "long text " * 30_000 + items[1][1])]
    return docs, items


def rows(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def test_against_brute_force(spark):
    docs, items = cases()
    table = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, words string, n_hit int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert rows(decontaminate.contamination(table, bench)) == want
    assert rows(decontaminate.contamination(table, bench, most_broadcast=40)) == want  # in blocks
    table = table.withColumnsRenamed({"words": "k1", "n_hit": "_k2"}).withColumn("row", table.doc_id).withColumn("key", table.text)
    kept = decontaminate.decontaminate(table, bench)
    assert kept.columns == table.columns == ["doc_id", "text", "k1", "_k2", "row", "key"] and kept.first().k1 == "clash"
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [w[0] for w in want if not w[5]]


def test_empty_tables(spark):
    docs, items = cases()
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(decontaminate.contamination(table, bench.limit(0))) == brute(docs, [])
    assert decontaminate.contamination(table.limit(0), bench).count() == 0
    assert decontaminate.decontaminate(table.limit(0), bench.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    docs, items = cases()
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    plan = decontaminate.contamination(table, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
