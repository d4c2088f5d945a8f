"""What a task holds at once: two Python workers share an executor's memory with its JVM."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from plyforge.llm import near_copies, packing


class Caught:
    """Stands in for a DataFrame and keeps what is given to mapInArrow."""

    def __init__(self, schema):
        self.schema = schema

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        return self


def peak_of(run, batch: pa.RecordBatch) -> tuple[float, list[pa.RecordBatch]]:
    """The most MB of Python and numpy at once, and the rows."""
    tracemalloc.start()
    try:
        out = list(run(iter([batch])))
        return tracemalloc.get_traced_memory()[1] / 2**20, out
    finally:
        tracemalloc.stop()


def words(n_texts: int, n_words: int) -> pa.RecordBatch:
    rng = np.random.default_rng(5)
    each = [" ".join(f"w{k:x}" for k in row) for row in rng.integers(0, 20_000, (n_texts, n_words)).tolist()]
    return pa.RecordBatch.from_arrays([pa.array(range(n_texts), pa.int64()), pa.array(each)], ["doc_id", "text"])


def test_pieces_hold_a_megabyte_of_text_at_a_time(spark):
    batch, docs = words(1200, 800), Caught(None)
    run = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")).run
    list(run(iter([batch])))  # the chunks are known from here on
    peak, out = peak_of(run, batch)
    assert sum(b.num_rows for b in out) >= 1200 and peak < 50


def test_shingle_sets_are_made_from_a_megabyte_of_text_at_a_time(spark, tmp_path):
    batch = words(600, 800)
    docs = Caught(spark.createDataFrame([], "doc_id long, text string").schema)
    peak, out = peak_of(near_copies.with_set(docs, f"file://{tmp_path}", "doc_id", "text", 5).run, batch)
    assert peak < 90
    n, files = 0, []
    for b in out:
        files += b.column("file").to_pylist()
        for row in b.to_pylist():
            grams = near_copies.grams_at(f"file://{tmp_path}", row["file"], row["start"], row["n"])
            text = batch.column("text").slice(row["key"], 1)
            alone, ends = near_copies.shingle_sets(text)
            assert np.array_equal(grams, alone) and row["fp"] == int(near_copies.set_fingerprints(alone, ends).view(np.int64)[0])
            n += 1
    assert n == 600 and len(set(files)) == 1
