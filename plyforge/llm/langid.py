"""Language identification in two steps: family, then language within it.

Both steps are one-versus-one linear support vector machines over hashed
n-grams of one to four bytes. A text's margin for a pair is the mean of its
n-grams' weights, so a batch of whole texts is scored by table lookups alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import frugal, text_column, utf8

#: Closely related languages by ISO 639-1 code. A language outside has a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}


def family(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def hashed_ngrams(data: np.ndarray, dims: int) -> list[np.ndarray]:
    """For each position, the hashes of the 1-, 2-, 3- and 4-grams that start there (A-Z lower-cased, digits alike)."""
    x = data.astype(np.uint32)
    x = np.where((x >= 65) & (x <= 90), x + 32, x)
    x = np.where((x >= 48) & (x <= 57), 48, x).astype(np.uint32)
    out, gram = [], np.zeros(len(x), np.uint32)
    for n in range(1, 5):
        gram = gram.copy()
        part = x[n - 1 :] if n - 1 < len(x) else x[:0]
        gram[: len(part)] |= part << np.uint32(8 * (n - 1))
        with np.errstate(over="ignore"):
            h = (gram + np.uint32(n * 0x9E37)) * np.uint32(0x9E3779B1)
        out.append((h >> np.uint32(16)) % np.uint32(dims))
    return out


def features(texts: list[str], dims: int) -> np.ndarray:
    """The rows' shares of hashed n-grams, as score_texts sums them."""
    out = np.zeros((len(texts), dims), np.float32)
    for i, t in enumerate(texts):
        for h in hashed_ngrams(np.frombuffer(t.encode() + b"\0\0\0", np.uint8), dims):
            h = h[:-3]
            if len(h):
                out[i] += np.bincount(h, minlength=dims).astype(np.float32) / (4 * len(h))
    return out


def train_svm(x: np.ndarray, y: np.ndarray, strength: float = 1e-4, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (dims + 1, the last the bias) of a linear SVM for y in {-1, 1}: averaged Pegasos on centred, scaled rows.

    x is centred and scaled in place, as the driver's memory is small.
    """
    squares = np.concatenate([(x[k : k + 256] * x[k : k + 256]).sum(axis=1) for k in range(0, len(x), 256)])
    scale = 1.0 / max(float(np.sqrt(squares).mean()), 1e-12)
    mean = x.mean(axis=0)
    rng, w, total, steps, t = np.random.default_rng(seed), np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), 0, 0
    rows = x
    rows -= mean
    rows *= scale
    weight = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9))
    size = 32
    for r in range(rounds):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), size):
            t += 1
            at = order[k : k + size]
            margin = y[at] * (rows[at] @ w[:-1] + w[-1])
            bad = at[margin < 1]
            rate = 1.0 / (strength * (t + 1.0 / strength))
            w[:-1] *= 1 - rate * strength
            if len(bad):
                g = (y[bad] * weight[bad])[:, None]
                w[:-1] += rate * 30 * (g * rows[bad]).sum(axis=0) / len(at)
                w[-1] += rate * float(g.sum()) / len(at)
            if r >= rounds // 2:
                total += w
                steps += 1
    w = total / max(steps, 1)
    return np.concatenate([w[:-1] * scale, [w[-1] - scale * float(w[:-1] @ mean)]])


class LanguageModel:
    """The machines of both steps: for each (a, b), weights whose positive margin means a."""

    def __init__(self, machines: list[tuple[str, str, bool]], weights: np.ndarray, languages: list[str], scale: np.ndarray):
        self.machines, self.weights, self.languages, self.scale = machines, weights, languages, scale

    @classmethod
    def fit(cls, texts: list[str], langs: list[str], dims: int = 4096) -> LanguageModel:
        x, lang = features(texts, dims), np.array(langs, object)
        fam = np.array([family(s) for s in langs], object)
        machines, weights, scale = [], [], []

        def add(names: np.ndarray, a: str, b: str, within: bool) -> None:
            rows = np.flatnonzero((names == a) | (names == b))
            y = np.where(names[rows] == a, 1.0, -1.0)
            w = train_svm(x[rows], y)
            margin = np.concatenate([x[rows[k : k + 256]] @ w[:-1] for k in range(0, len(rows), 256)]) + w[-1]
            machines.append((a, b, within))
            weights.append(w)
            scale.append(4.0 / max(float(np.abs(margin).mean()), 1e-9))

        for a, b in combinations(sorted(set(fam)), 2):
            add(fam, a, b, False)
        for f in sorted(set(fam)):
            for a, b in combinations(sorted(set(lang[fam == f])), 2):
                add(lang, a, b, True)
        table = np.array(weights) if weights else np.zeros((0, dims + 1))
        return cls(machines, table.astype(np.float32), sorted(set(langs)), np.array(scale))

    def margins(self, texts: pa.Array) -> np.ndarray:
        """(texts, machines), calibrated to the training margins' mean."""
        data, ends = utf8(texts)
        n = np.diff(ends)
        out = np.zeros((len(n), len(self.machines)))
        dims = self.weights.shape[1] - 1
        table = np.ascontiguousarray(self.weights[:, :-1].T)
        step, full = 1 << 20, np.flatnonzero(n)
        k = 0
        while k < len(full):  # runs of texts of about a megabyte; a longer one is its own run
            stop = max(k + 1, int(np.searchsorted(ends[full], ends[full[k]] + step)))
            rows = full[k:stop]
            a, b = ends[rows[0]], ends[rows[-1] + 1]
            starts = ends[rows] - a
            padded = np.concatenate([data[a:b], np.zeros(3, np.uint8)])
            grams = hashed_ngrams(padded, dims)
            # An n-gram that would run over its text's end sees zero bytes instead, as in features().
            edge = np.unique(np.concatenate([ends[rows + 1] - a - j for j in (1, 2, 3)]))
            edge = edge[edge >= 0]
            owner = np.searchsorted(starts, edge, side="right") - 1
            left = ends[rows + 1][owner] - a - edge
            for e_n in range(2, 5):
                at = edge[left < e_n]
                if len(at):
                    keep = left[left < e_n]
                    tail = np.zeros((len(at), 4), np.uint8)
                    for j in range(3):
                        has = keep > j
                        tail[has, j] = padded[at[has] + j]
                    grams[e_n - 1][at] = hashed_tail(tail, e_n, dims)
            for m in range(len(self.machines)):
                w = table[:, m]
                s = np.zeros(b - a, np.float32)
                for g in grams:
                    s += w[g[: b - a]]
                out[rows, m] = np.add.reduceat(s, starts, dtype=np.float64) / (4 * n[rows])
            k = stop
        return (out + self.weights[:, -1]) * self.scale

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each text; `und` and 0 for texts without a letter."""
        m = self.margins(texts)
        p = 1 / (1 + np.exp(-np.clip(m, -30, 30)))
        fams = sorted({family(s) for s in self.languages})

        def decide(names: list[str], within: bool) -> tuple[np.ndarray, np.ndarray]:
            """Votes' winner of the pairs of names; its least pair probability."""
            at = [(k, names.index(a), names.index(b)) for k, (a, b, w) in enumerate(self.machines) if w == within and a in names and b in names]
            votes, sure = np.zeros((len(m), len(names))), np.ones((len(m), len(names)))
            for k, a, b in at:
                votes[:, a] += (m[:, k] > 0) + 1e-3 * np.tanh(m[:, k] / 8)
                votes[:, b] += (m[:, k] <= 0) - 1e-3 * np.tanh(m[:, k] / 8)
                sure[:, a] = np.minimum(sure[:, a], p[:, k])
                sure[:, b] = np.minimum(sure[:, b], 1 - p[:, k])
            best = votes.argmax(axis=1)
            return best, sure[np.arange(len(m)), best]

        lang, score = np.full(len(m), "und", object), np.zeros(len(m))
        if not self.languages:
            return lang, score
        best, sure = decide(fams, False)
        for i, f in enumerate(fams):
            rows = np.flatnonzero(best == i)
            names = [s for s in self.languages if family(s) == f]
            inner, within = decide(names, True)
            lang[rows] = np.array(names, object)[inner[rows]]
            score[rows] = sure[rows] * within[rows]
        letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
        lang[~letters], score[~letters] = "und", 0.0
        return lang, score


def hashed_tail(tail: np.ndarray, n: int, dims: int) -> np.ndarray:
    """Hashes of the n-grams that the rows of tail begin."""
    return hashed_ngrams(tail.reshape(-1), dims)[n - 1].reshape(-1, 4)[:, 0]


def sample_labelled(docs: DataFrame, text: str, lang: str, known: Column, per_language: int, most_bytes: int) -> tuple[list[str], list[str]]:
    """About per_language distinct texts of each language, and of about most_bytes in all, by a hash of the text.

    Only hashes and lengths are shuffled to count distinct texts, so copies
    neither use up a language's share nor reach the driver twice.
    """
    rows = docs.filter(known & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"), F.xxhash64(text).alias("h"))
    distinct = rows.groupBy("l", "h").agg(F.max(F.octet_length("t").cast("long")).alias("b"))
    counts = {r.l: (r.n, r.b) for r in distinct.groupBy("l").agg(F.count("*").alias("n"), F.sum("b").alias("b")).collect()}
    if not counts:
        return [], []
    share = {l: min(1.0, per_language / n, most_bytes / len(counts) / max(b, 1)) for l, (n, b) in counts.items()}
    by_lang = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    drawn = rows.filter(F.pmod("h", F.lit(1 << 20)) < by_lang[F.col("l")] * (1 << 20))
    got = sorted({(r.l, r.t) for r in drawn.groupBy("l", "h").agg(F.first("t").alias("t")).collect()})
    return [t for _, t in got], [l for l, _ in got]


def fit(docs: DataFrame, known: Column, text: str = "text", lang: str = "lang", per_language: int = 600, most_bytes: int = 64_000_000, dims: int = 4096) -> LanguageModel:
    """Learn from the rows where `known` holds. per_language and most_bytes bound the texts that reach the driver.

    Rows with a null text or language, or where `known` is null, teach nothing;
    equal texts of a language count once, whatever their keys, and a text under
    two languages once for each. A table without such rows gives a model that
    knows no language.
    """
    return LanguageModel.fit(*sample_labelled(docs, text, lang, known, per_language, most_bytes), dims)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1), replacing columns of these names.

    Whole texts are scored. A null text, or one without a letter, is `und` with
    score 0, as is everything where nothing was learned. Of languages with equal
    votes and margins the first by name is taken. Every row is judged by its own
    text, so keys may repeat or be null; an empty table stays empty. All other
    columns stay.
    """
    docs = docs.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = model.predict(text_column(batch, text))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    schema = docs.schema
    return docs.mapInArrow(frugal(run), type(schema)(list(schema.fields)).add("lang_pred", "string").add("score", "double"))
