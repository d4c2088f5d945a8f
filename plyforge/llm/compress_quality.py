"""Quality by compression: a text is good if a good dictionary makes it smaller.

zstandard dictionaries of several sizes are trained on good and on bad labelled
texts. Texts are compressed in blocks, so that a long text's own repetition does
not drown what the dictionaries know; the sizes are summed over blocks and
dictionaries. The normalised difference (bad size - good size) / (bad size +
good size) is all that the score reads: isotonic regression turns it into a
probability. Each half of the labelled texts trains dictionaries, and the curve
is fitted on what the other half's dictionaries say of it. A score then adds up
both halves' dictionaries: twice as many as the curve has seen at once, and the
difference, being normalised, is their mean but for how much each compresses.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType

from .common import frugal, runs, text_column


@dataclass
class Curve:
    """P(y = 1) as a function that never falls: isotonic regression, straight between the middles of its steps."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.at, self.value)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, share: float) -> Curve:
        """Pool neighbours while a step would fall; a step of n rows counts one more row of the labels' share."""
        order = np.argsort(x, kind="stable")
        steps: list[list[float]] = []  # rows, sum of y, sum of x
        for v in np.unique(x[order]):
            mine = x == v
            steps.append([float(mine.sum()), float(y[mine].sum()), float(v) * mine.sum()])
            while len(steps) > 1 and steps[-2][1] * steps[-1][0] >= steps[-1][1] * steps[-2][0]:
                top = steps.pop()
                steps[-1] = [p + q for p, q in zip(steps[-1], top, strict=True)]
        n, total, place = np.array(steps).T
        return cls(place / n, np.maximum.accumulate((total + share) / (n + 1)))


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or where there is too little text for one, the last `size` bytes of the text itself."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(samples)[-size:]


def compressor(raw: bytes, level: int):
    if len(raw) < 8:  # the library takes no shorter one
        return zstandard.ZstdCompressor(level=level, write_content_size=False).compress
    held = zstandard.ZstdCompressionDict(raw)
    held.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_dict_id=False).compress


@dataclass
class CompressionModel:
    good: list[bytes]
    bad: list[bytes]
    level: int
    block: int
    curve: Curve | None = None
    share: float = 0.5

    def sizes(self, texts: list[str]) -> np.ndarray:
        """(texts, 2): the summed compressed sizes of whole texts by the good and by the bad dictionaries."""
        both = [[compressor(raw, self.level) for raw in side] for side in (self.good, self.bad)]
        out = np.zeros((len(texts), 2))
        for i, t in enumerate(texts):
            raw = t.encode()
            blocks = [raw[k : k + self.block] for k in range(0, len(raw), self.block)]
            out[i] = [sum(len(c(x)) for c in side for x in blocks) for side in both]
        return out

    def differences(self, texts: list[str]) -> np.ndarray:
        """Normalised size differences of texts, none of them empty."""
        a, b = self.sizes(texts).T if texts else np.zeros((2, 0))
        return (b - a) / (b + a)

    def scores(self, texts: list[str]) -> np.ndarray:
        """0 to 1; empty texts, and all where there was one class to learn from, get the labels' own share."""
        out = np.full(len(texts), self.share)
        full = [i for i, t in enumerate(texts) if t]
        if self.curve is not None and full:
            out[full] = self.curve(self.differences([texts[i] for i in full]))
        return out


def fit_texts(good: list[str], bad: list[str], sizes: tuple[int, ...] = (16_384, 32_768, 65_536), level: int = 3, block: int = 512) -> CompressionModel:
    """Every second text of each class trains one set of dictionaries, the others another; each set's differences on
    the other half fit the curve. A class of one text has it in both halves; without a text of both classes there is
    no curve."""
    share = (len(good) + 1) / (len(good) + len(bad) + 2)
    if not good or not bad:
        return CompressionModel([], [], level, block, None, share)
    halves = [[x[h::2] or x for x in (good, bad)] for h in (0, 1)]
    models = [CompressionModel(*[[dictionary([t.encode() for t in x], size) for size in sizes] for x in half], level, block) for half in halves]
    x = np.concatenate([m.differences(t) for m, half in zip(models, halves[::-1], strict=True) for t in half])
    y = np.concatenate([np.full(len(t), float(good_one)) for half in halves[::-1] for t, good_one in zip(half, (1, 0), strict=True)])
    return CompressionModel(models[0].good + models[1].good, models[0].bad + models[1].bad, level, block, Curve.fit(x, y, share), share)


def share_of(column: str, share: float) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))


def fit(docs: DataFrame, labels: DataFrame, known: Column, key: str = "doc_id", text: str = "text", quality: str = "quality", most_texts: int = 8000, most_bytes: int = 48_000_000) -> CompressionModel:
    """Learn from labelled rows where `known` (of the labels' columns) holds.

    most_texts bounds the labels drawn, by a hash of their key and one share
    for both classes, which keeps the labels' own odds; that many rows are
    broadcast to find their texts. most_texts and most_bytes then bound what
    reaches the driver, whatever the tables' size. Equal texts teach once a
    label, and a text under both labels teaches both; labels other than 0 and 1, null keys and null or empty texts teach nothing.
    """
    marks = labels.filter(known & F.col(quality).isin(0, 1)).select(F.col(key).alias("k"), F.col(quality).alias("y")).filter("k is not null").distinct()
    marks = marks.filter(share_of("k", most_texts / max(marks.count(), 1)))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t <> ''").join(F.broadcast(marks), "k")
    rows = rows.groupBy(F.xxhash64("t").alias("h"), "y").agg(F.first("t").alias("t"))
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("t"))).first()
    drawn = rows.filter(share_of("h", min(most_texts / max(n, 1), most_bytes / max(size or 1, 1))))
    got = sorted({(r.t, r.y) for r in drawn.collect()}, key=lambda x: (zlib.crc32(x[0].encode()), x))
    return fit_texts([t for t, y in got if y == 1], [t for t, y in got if y == 0])


def score(docs: DataFrame, model: CompressionModel, text: str = "text") -> DataFrame:
    """docs with score and predicted, replacing columns of these names.

    Whole texts are compressed. Null and empty texts get the labels' share of
    good ones, equal texts equal scores. All other columns and rows, also those
    of null or repeated keys, stay as they are; an empty table stays empty.
    """
    docs = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch, text)
            s = np.concatenate([model.scores(texts[a:b].to_pylist()) for a, b in runs(texts)] or [np.empty(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    schema = docs.schema
    return docs.mapInArrow(frugal(run), type(schema)(list(schema.fields)).add("score", "double").add("predicted", IntegerType()))
