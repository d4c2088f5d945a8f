import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plyforge.llm import common, token_store
from plyforge.llm.packing import pack_documents, sum_of_squares
from plyforge.llm.tokens import ChunkEncoder

TEXTS = ["", " ", "  a  b", "a \n b", "x   ", " y", "it's we'll ' s", "a\x1cb \x1c c", "tab\t\tx y\n\n  z  ", "É é ÉÉ    a", " \n", "é a  b  ", "日本 語 ", "a <|endoftext|> b", "Words, and words. and 'Words", "x" * 3000, "la " * 5000]


@pytest.mark.parametrize(("name", "spaced"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_chunks_give_the_whole_texts_ids(name, spaced):
    import pyarrow as pa

    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    for bound in (800_000, 5):  # the second forgets at once
        flat, ends = ChunkEncoder(path, spaced, bound).encode(pa.array(TEXTS), most_bytes=20)
        for k, text in enumerate(TEXTS):
            assert flat[ends[k] : ends[k + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_perfect_hash():
    keys = np.concatenate([np.arange(-500, 5000, 3), [2**62, -(2**63)]]).astype(np.int64)
    mph = token_store.PerfectHash.build(keys)
    assert sorted(mph.slots(keys)) == list(range(len(keys)))
    with pytest.raises(ValueError):
        token_store.PerfectHash.build(np.array([7, 7]))


def test_store(spark):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(7 * i - 20, t, "clash") for i, t in enumerate(TEXTS)] + [(5000, None, "x"), (5000, "again", "x"), (5000, "again", "x"), (None, "no key", "x"), (None, "no key", "x"), (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    store = token_store.TokenStore.write(docs, common.scratch(spark, "test"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, ranges=4)
    want, start = [], 0
    null_last = lambda r: 1 << 62 if r[0] is None else r[0]
    for doc, ids in sorted((null_last(r), plain.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in rows):
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((null_last(r), r.start, r.n_tokens, r.ids_crc32) for r in store.rows().collect())
    # rows of one key lie in the order of their texts' hashes
    assert [g[0] for g in got] == [w[0] for w in want] and sorted(g[2:] for g in got) == sorted(w[2:] for w in want)
    assert [g for g in got if g[0] < 5000] == [w for w in want if w[0] < 5000]
    assert [g[1] for g in got] == np.concatenate([[0], np.cumsum([g[2] for g in got])[:-1]]).tolist()
    some = spark.createDataFrame([(1,), (7 * 6 - 20,), (99999,), (None,)], "doc_id long")
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in store.get(some).collect()}
    assert ids == {1: plain.encode(TEXTS[3], add_special_tokens=False).ids + [1], 22: plain.encode(TEXTS[6], add_special_tokens=False).ids + [1]}


def test_store_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_store.TokenStore.write(docs, common.scratch(spark, "test"), public_tokenizers.path("word_bpe_49k.json")).rows().count() == 0


def test_one_key_over_several_shards_and_a_long_text(spark):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    long = "some words to repeat. " * 2_400_000  # over 50 MB
    rows = [(1, "first"), *[(5, f"hot {i}") for i in range(900)], *[(5, "copy")] * 900, (9, "last")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    docs = docs.unionByName(spark.createDataFrame([(7, "some words to repeat. ")], "doc_id long, text string").selectExpr("doc_id", "repeat(text, 2400000) text"))
    store = token_store.TokenStore.write(docs, common.scratch(spark, "test"), public_tokenizers.path("word_bpe_49k.json"), ranges=5, part_docs=300, part_bytes=1 << 20)
    got = sorted(store.rows(with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [1, *[5] * 1800, 7, 9] and [r.row for r in got] == [0, *range(1800), 0, 0]
    assert len({(s.rpartition("-")[0]) for s in store.names}) > 1 and len(store.names) >= 6
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    ids = lambda t: plain.encode(t, add_special_tokens=False).ids + [1]
    assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in got[1:1801]) == sorted(ids(t) for k, t in rows if k == 5)
    assert got[1801].n_tokens == 5 * 2_400_000 + 1 and got[1801].ids_crc32 == zlib.crc32(got[1801].ids) and len(long) > 50_000_000
    assert np.frombuffer(got[1801].ids, "<u4")[-6:].tolist() == ids("some words to repeat.")
    some = store.get(spark.createDataFrame([(5,), (6,)], "doc_id long"), with_ids=False).collect()
    assert sorted(r.row for r in some) == list(range(1800))


def test_wide_ids(spark, tmp_path):
    from tokenizers import models, pre_tokenizers

    wide = Tokenizer(models.WordLevel({"<unk>": 0} | {f"t{i}": i for i in range(1, 70_000)}, unk_token="<unk>"))
    wide.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    wide.save(f"{tmp_path}/wide.json")
    assert token_store.type_size(f"{tmp_path}/wide.json", 1) == 4 and token_store.type_size(public_tokenizers.path("word_bpe_49k.json"), 1) == 2
    docs = spark.createDataFrame([(1, "t69999 t1"), (2, "t65536 t65535")], "doc_id long, text string")
    store = token_store.TokenStore.write(docs, common.scratch(spark, "test"), f"{tmp_path}/wide.json")
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in store.rows(with_ids=True).collect()} == {1: [69999, 1, 1], 2: [65536, 65535, 1]}


def test_sum_of_squares_by_hand():
    bins, offsets = sum_of_squares(np.array([6, 6, 5, 4, 4, 10]), 10)
    # 6 | 6 | 5: gaps 4, 4, 5; the first 4 closes a gap of the commoner kind, the second the other
    assert bins.tolist() == [0, 1, 2, 1, 0, 3] and offsets.tolist() == [0, 0, 0, 6, 6, 0]


def test_packing(spark):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(i, t, "clash") for i, t in enumerate([*TEXTS, None, "la " * 900, "word and word"])] + [(3, "dup", "z"), (3, "dup", "z"), (None, "no key", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    got = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True).toPandas()
    want = sorted((r[0] if r[0] is not None else -1, tuple(plain.encode(r[1] or "", add_special_tokens=False).ids + [2])) for r in rows)
    whole = []
    for doc, x in got.fillna({"doc_id": -1}).sort_values(["doc_id", "piece"]).groupby("doc_id"):
        if (x["piece"] == 0).sum() == 1:
            whole.append((int(doc), tuple(np.frombuffer(b"".join(x["ids"]), "<u4").tolist())))
            assert x["start"].tolist() == np.concatenate([[0], np.cumsum(x["length"])[:-1]]).tolist()
            assert (x["length"].iloc[1:] == 1024).all()
    assert whole == [w for w in want if w[0] != 3]
    for _, x in got.groupby("sequence_id"):
        x = x.sort_values("offset")
        assert x["offset"].tolist() == np.concatenate([[0], np.cumsum(x["length"])[:-1]]).tolist() and x["length"].sum() <= 1024
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 1024) + 1
    assert pack_documents(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).collect() == []


def test_packing_in_many_groups(spark):
    """The second pass packs what lay loose again: every piece once, no overlap, few sequences."""
    from plyforge.llm.packing import pack

    rng = np.random.default_rng(12)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(rng.choice([1000, 700, 600, 500, 30, 5], 700))]
    items = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(5)
    one, many = (pack(items, len(rows), group_items=n).toPandas() for n in (32_768, 40))
    for got in (one, many):
        assert sorted(zip(got.doc_id, got.length)) == [(r[0], r[3]) for r in rows]
        for _, x in got.groupby("sequence_id"):
            x = x.sort_values("offset")
            assert x["offset"].tolist() == np.concatenate([[0], np.cumsum(x["length"])[:-1]]).tolist() and x["length"].sum() <= 1024
    least = -(-sum(r[3] for r in rows) // 1024)
    assert one.sequence_id.nunique() <= many.sequence_id.nunique() <= one.sequence_id.nunique() * 1.05 + 2 and many.sequence_id.nunique() >= least


@pytest.mark.parametrize(("name", "spaced"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_plain_words_on_both_sides_of_a_line_end_go_to_the_model(name, spaced):
    import pyarrow as pa

    path = public_tokenizers.path(name)
    enc = ChunkEncoder(path, spaced)
    plain, seen = enc.tokenizer, []

    class Told:
        def encode_batch_fast(self, chunks, add_special_tokens):
            seen.extend(chunks)
            return plain.encode_batch_fast(chunks, add_special_tokens=add_special_tokens)

    enc.tokenizer = Told()
    texts = ["one end.\nThe next, line\nand Éàü,\nünd.", "end. end,\nend", "a.\n\nb c\n d.\r\ne it's.\nx1 a\n", " end\nEnd. (x\ny)"]
    flat, ends = enc.encode(pa.array(texts))
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert not [c for c in seen if c.strip(" ").replace(".\n", "").replace(",\n", "").replace("\n", "").strip(".,").isalpha() and not c.endswith("\n") and "\n\n" not in c]


def odd_texts(seed: int, n: int) -> list[str]:
    """Texts of a few characters each, among them white space and letters of every kind that cuts ask about."""
    rng = np.random.default_rng(seed)
    some = [*"abAZéßÀÿ×÷ªÃ日й.,!'$17|<>\n\n\t\r", *" " * 8, "'s", "'LL", "<|endoftext|>", "́", "̸", "…", "“", "\U0001f600", "\x00", "\x1c", "\x7f", "\x85", "\xa0", " ", "᠎", " ", " ", "​", " ", " ", "　"]
    return ["".join(rng.choice(rng.choice(some, rng.integers(2, 12)), rng.integers(0, 20))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_odd_texts_give_the_librarys_ids(seed):
    import pyarrow as pa

    path, texts = public_tokenizers.path("byte_bpe_50k.json"), odd_texts(seed, 3000)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for bound, run in ((400_000, 6 << 20), (300, 200)):
        flat, ends = ChunkEncoder(path, False, bound).encode(pa.array(["before. ", *texts])[1:], most_bytes=run)
        assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == want


class Counting:
    """Stands in for a vocabulary's model and keeps the words that it is given."""

    def __init__(self, model):
        self.model, self.seen = model, []

    def tokenize(self, word):
        self.seen.append(word)
        return self.model.tokenize(word)


def test_a_word_is_encoded_once_whatever_stands_beside_it():
    import pyarrow as pa

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, plain, whole = ChunkEncoder(path, False), Tokenizer.from_file(path), []
    enc.model = Counting(enc.model)

    class Told:
        def encode_batch_fast(self, chunks, add_special_tokens):
            whole.extend(chunks)
            return plain.encode_batch_fast(chunks, add_special_tokens=add_special_tokens)

    enc.tokenizer = Told()
    texts = ["a schön word, word. word.\nword,***\nword$$$ word!! schön*** word", "word\nword schön.### x word%%% schön"]
    flat, ends = enc.encode(pa.array(texts))
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert sorted(enc.model.seen) == sorted(["a", "Ġschön".replace("ö", "Ã¶"), "Ġword", "word", "Ġx"])
    assert len(whole) == len(set(whole)) and not [c for c in whole if any(x.isalpha() for x in c)]


def test_chunks_met_again_stay_known():
    import pyarrow as pa

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, plain = ChunkEncoder(path, False, max_chunks=20), Tokenizer.from_file(path)
    enc.model = Counting(enc.model)
    for k in range(12):
        text = f"the end of {chr(97 + k)}aa {chr(97 + k)}bb"
        assert enc.encode(pa.array([text]))[0].tolist() == plain.encode(text, add_special_tokens=False).ids
        assert len(enc.known) <= 20
    assert len(enc.model.seen) == len(set(enc.model.seen)) == 3 + 24
