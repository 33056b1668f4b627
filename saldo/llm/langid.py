"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its hashed character n-grams (within words, with word
ends marked); a linear softmax on that average gives the languages. Both are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled rows. A held-back part of the
sample sets the softmax temperature and the confidence below which a text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.llm.common import slices

#: Hash buckets, a power of two.
BUCKETS = 4096
DIM = 16
NGRAMS = (1, 2, 3)
#: Bound on the labelled rows that the classifier is fitted on (expected size of the hash sample).
TRAIN_ROWS = 4000
#: Share of correctly labelled calibration texts that rejection may cost.
FALSE_REJECT = 0.001
UNDETERMINED = "und"
#: Characters whose n-grams a worker holds at once.
SLICE_CHARS = 1_000_000

_letter: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letter


def subword_counts(texts: list[str | None], buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Hashed n-gram counts of each whole text, lower-cased; all zero for a text without a letter.

    Works on about SLICE_CHARS characters at once; a longer text is cut at blanks, as no n-gram holds one inside.
    """
    lowered = [(t or "").lower() for t in texts]
    for a, b in slices([len(t) for t in lowered], SLICE_CHARS):
        if len(lowered[a]) <= SLICE_CHARS:
            yield from _counts(lowered[a:b], buckets)
            continue
        total, at, text = np.zeros(buckets, np.int64), 0, lowered[a]
        while at < len(text):
            end = text.find(" ", at + SLICE_CHARS)
            end = len(text) if end < 0 else end
            total += next(_counts([text[at:end]], buckets))
            at = end
        yield total


def _counts(lowered: list[str], buckets: int) -> Iterator[np.ndarray]:
    codes = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    codes[~_is_letter()[codes]] = 0x20
    gap = codes == 0x20
    ends = np.cumsum([len(t) + 1 for t in lowered])
    found, edges = [], []
    for n in NGRAMS:
        size = len(codes) - n + 1
        h = np.full(size, n, np.uint32)
        for k in range(n):
            h ^= codes[k : k + size]
            h *= np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        inner = range(n) if n == 1 else range(1, n - 1)
        good = np.ones(size, bool)
        for k in inner:  # a blank may stand at either end only: it marks a word's end
            good &= ~gap[k : k + size]
        if n == 2:
            good &= ~(gap[:size] & gap[1:])
        found.append((h & np.uint32(buckets - 1))[good].astype(np.int32))
        edges.append(np.concatenate([[0], np.cumsum(good)])[np.minimum(ends, size)])
    starts = [0] * len(NGRAMS)
    for k in range(len(lowered)):
        yield np.bincount(np.concatenate([f[a : e[k]] for f, a, e in zip(found, starts, edges)]), minlength=buckets)
        starts = [e[k] for e in edges]


@dataclass
class LanguageModel:
    """labels in order; table: each bucket's share of the logits (embedding times softmax weights)."""

    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        n = counts.sum(-1, keepdims=True)
        z = (counts @ self.table / np.maximum(n, 1) + self.bias) / self.temperature
        z = np.exp(z - z.max(-1, keepdims=True))
        return z / z.sum(-1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Label, score and rejection of each text; `und`, 0 and rejected where there is no letter."""
        labels, scores, rejected = [], [], []
        for counts in subword_counts(texts, len(self.table)):
            if not counts.any() or not self.labels:
                labels.append(UNDETERMINED), scores.append(0.0), rejected.append(True)
                continue
            p = self.probabilities(counts)
            k = int(p.argmax())
            labels.append(self.labels[k]), scores.append(float(p[k])), rejected.append(bool(p[k] < self.reject_below))
        return labels, scores, rejected


def loss_and_gradients(emb: np.ndarray, out: np.ndarray, bias: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean cross-entropy of rows x (n-gram shares) and labels y, and its gradients by embeddings, softmax weights and bias."""
    mean = x @ emb
    z = mean @ out + bias
    z = np.exp(z - z.max(1, keepdims=True))
    p = z / z.sum(1, keepdims=True)
    at = np.arange(len(y))
    loss = float(-np.log(np.maximum(p[at, y], 1e-30)).mean())
    p[at, y] -= 1
    p /= len(y)
    return loss, x.T @ (p @ out.T), mean.T @ p, p.sum(0)


def train(counts: np.ndarray, names: list[str], *, dim: int = DIM, epochs: int = 30, rate: float = 8.0, seed: int = 7) -> LanguageModel:
    """Fit on rows of n-gram counts. One row in five is held back for temperature and rejection."""
    labels = sorted(set(names))
    buckets = counts.shape[1] if counts.ndim == 2 else BUCKETS
    if not labels:
        return LanguageModel([], np.zeros((buckets, 0)), np.zeros(0), 1.0, 0.0)
    y = np.array([labels.index(x) for x in names])
    x = counts / np.maximum(counts.sum(1, keepdims=True), 1).astype(np.float32)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    emb = rng.normal(0, 1 / dim, (buckets, dim)).astype(np.float32)
    out = np.zeros((dim, len(labels)), np.float32)
    bias = np.zeros(len(labels), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        fit = rng.permutation(fit)
        for at in range(0, len(fit), 32):
            rows = fit[at : at + 32]
            _, d_emb, d_out, d_bias = loss_and_gradients(emb, out, bias, x[rows], y[rows])
            out -= step * d_out
            bias -= 0.1 * step * d_bias
            emb -= step * d_emb
    model = LanguageModel(labels, (emb @ out).astype(np.float64), bias.astype(np.float64), 1.0, 0.0)
    if len(held):
        losses = []
        for t in np.geomspace(0.1, 10, 41):
            model.temperature = float(t)
            p = model.probabilities(x[held])[np.arange(len(held)), y[held]]
            losses.append((-np.log(np.maximum(p, 1e-12)).mean(), float(t)))
        model.temperature = min(losses)[1]
        p = model.probabilities(x[held])
        right = np.sort(p.max(1)[p.argmax(1) == y[held]])
        # confidence of the lowest correctly labelled text that may still be lost; never above even odds
        model.reject_below = float(min(right[int(FALSE_REJECT * len(right))], 0.5)) if len(right) else 0.0
    return model


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", id_col: str = "doc_id", rows: int = TRAIN_ROWS, buckets: int = BUCKETS) -> LanguageModel:
    """Train on rows of docs with a language: all of them, or where there are more than `rows`, a hash sample of about that size.

    Executors reduce sampled texts to n-gram counts, so the driver holds at most about `rows` sparse vectors.
    Of sampled rows that share an id one counts (the smallest language, then text); rows without an id count as one.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    total = known.select(lang).count()
    share = min(1.0, rows / max(total, 1))
    picked = known.where(F.pmod(F.xxhash64(id_col, F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept = [(i, n, np.flatnonzero(c), c) for i, n, c in zip(pdf["i"], pdf["n"], subword_counts(list(pdf["t"]), buckets)) if c.any()]
            if kept:
                yield pd.DataFrame({"i": [k[0] for k in kept], "n": [k[1] for k in kept], "at": [k[2].astype(np.int32) for k in kept], "c": [k[3][k[2]].astype(np.int32) for k in kept]})

    once = picked.groupBy(F.xxhash64(id_col).alias("i")).agg(F.min(F.struct(F.col(lang).alias("n"), F.col(text).alias("t"))).alias("r")).select("i", "r.n", "r.t")
    got = once.mapInPandas(reduce, "i long, n string, at array<int>, c array<int>").toPandas()
    got = got.sort_values(["i", "n"], kind="stable")
    counts = np.zeros((len(got), buckets), np.float32)
    for k, (at, c) in enumerate(zip(got["at"], got["c"])):
        counts[k, np.asarray(at, int)] = c
    return train(counts, list(got["n"]))


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score and lang_rejected; columns of docs so named are replaced.

    A null text, or one without a letter, is `und` with score 0 and rejected. Every row stays, repeats included.
    """
    new = ("lang_pred", "lang_score", "lang_rejected")
    keep = [c for c in docs.columns if c.lower() not in new]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: buckets x languages

    @F.pandas_udf("lang_pred string, lang_score double, lang_rejected boolean")
    def run(t: pd.Series) -> pd.DataFrame:
        a, b, c = shared.value.predict(list(t))
        return pd.DataFrame({"lang_pred": a, "lang_score": b, "lang_rejected": c})

    return docs.select(*[F.col(f"`{c}`") for c in keep], run(F.col(text)).alias("_said")).select(*[f"`{c}`" for c in keep], *[F.col("_said")[n].alias(n) for n in new])
