"""Toxicity: a linear classifier regularised by counterfactual identity swaps.

Features are the distinct lower-cased words of a whole text and their prefixes. Weights are fitted by
accelerated proximal gradient descent on three terms: the logistic loss of the labels, a penalty on the
squared change of a text's score when its identity terms are swapped for others of the same kind, and
an L1 term that leaves few weights other than zero. The swap penalty takes weight off the identity terms
themselves, so neutral mentions of a group don't raise a score. A labelled text that mentions no group is given
a neutral mention, one term drawn by the text's hash whatever its label, and is swapped and penalised like any.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound on the labelled rows that the classifier is fitted on (expected size of the hash sample).
TRAIN_ROWS = 6000
PREFIXES = (5, 6, 7)
MIN_DOCS = 3
THRESHOLD = 0.7

#: Identity terms by kind; a counterfactual swaps a term for the next one of its kind.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino"),
    ("african", "european", "american", "chinese", "indian", "mexican"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("deaf", "blind", "disabled", "autistic"),
)

_word = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """Distinct words of the whole text and, marked by a star, prefixes of longer words."""
    words = set(_word.findall((text or "").lower()))
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in PREFIXES))


def swapped(words: set[str], by: int = 1) -> set[str] | None:
    """The features with every identity term replaced by another of its kind, or None without such a term."""
    new, hit = set(words), False
    for kind in IDENTITY_TERMS:
        mine = [t for t in kind if t in words]
        if mine:
            hit = True
            other = [kind[(kind.index(t) + by) % len(kind)] for t in mine]
            for group, op in ((mine, new.difference_update), (other, new.update)):
                for t in group:
                    op({t} | {t[:n] + "*" for n in PREFIXES if len(t) > n})
    return new if hit else None


def with_mention(words: set[str], draw: int) -> set[str]:
    """The features with a neutral mention of one identity term, unless they have one."""
    if any(t in words for kind in IDENTITY_TERMS for t in kind):
        return words
    terms = [t for kind in IDENTITY_TERMS for t in kind]
    t = terms[draw % len(terms)]
    return words | {t} | {t[:n] + "*" for n in PREFIXES if len(t) > n}


@dataclass
class ToxicityModel:
    bias: float = -3.0
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        """Probability that the text would be marked toxic."""
        words = set(_word.findall((text or "").lower()))
        get = self.weights.get
        z = self.bias + sum(get(w, 0.0) for w in words & self.weights.keys())
        for n in PREFIXES:
            z += sum(get(p, 0.0) for p in {w[:n] + "*" for w in words if len(w) > n} & self.weights.keys())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(packed: list[str], labels: list[int], *, swap_penalty: float = 1.0, l1: float = 1e-3, rounds: int = 120) -> ToxicityModel:
    """Fit on texts' features, each text's joined by newlines, with labels 0 or 1.

    Features of fewer than MIN_DOCS texts are left out. Scores of one text in five, from a model that did
    not see it, set scale and shift of the final scores (Platt scaling), so that a score is a probability.
    """
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return ToxicityModel(float(np.log(share / (1 - share))) if len(y) else -3.0)
    packed = ["\n".join(sorted(with_mention(set(s.split("\n")), zlib.crc32(s.encode("utf-8", "surrogatepass"))))) for s in packed]
    code = lambda w: zlib.crc32(w.encode("utf-8", "surrogatepass")) & 0x3FFFFF
    often = np.zeros(1 << 22, np.int32)
    for s in packed:
        often[np.unique(np.fromiter(map(code, s.split("\n")), np.int64))] += 1
    index: dict[str, int] = {}
    cols = [np.array([index.setdefault(w, len(index)) for w in s.split("\n") if w and often[code(w)] >= MIN_DOCS], np.int32) for s in packed]
    del often
    pairs: list[tuple[int, list[int], list[int]]] = []
    for k, s in enumerate(packed):
        words = set(s.split("\n"))
        for by in (1, 2):
            other = swapped(words, by) or words
            pairs.append((k, [index[w] for w in other - words if w in index], [index[w] for w in words - other if w in index]))
    part = np.random.default_rng(11).permutation(len(y))
    held, fit_on = part[: len(y) // 5], part[len(y) // 5 :]
    scale, shift = 1.0, 0.0
    if len(held) and len(set(y[held])) == 2 and len(set(y[fit_on])) == 2:
        w, b = Objective(cols, y, fit_on, pairs, len(index), swap_penalty).descend(l1, rounds)
        scale, shift = _platt(np.array([w[cols[k]].sum() + b for k in held]), y[held])
    w, b = Objective(cols, y, np.arange(len(y)), pairs, len(index), swap_penalty).descend(l1, rounds)
    return ToxicityModel(float(scale * b + shift), {name: float(scale * w[k]) for name, k in index.items() if w[k]})


class Objective:
    """Mean weighted logistic loss of the texts in `use`, and swap_penalty times the mean squared change of their pairs' scores."""

    def __init__(self, cols: list[np.ndarray], y: np.ndarray, use: np.ndarray, pairs: list, m: int, swap_penalty: float):
        self.n, self.m, self.swap_penalty = len(use), m, swap_penalty
        self.pos = float(y[use].mean())
        self.rows = np.repeat(np.arange(self.n), [len(cols[k]) for k in use])
        self.at = np.concatenate([cols[k] for k in use])
        self.y = y[use]
        weight = np.where(self.y == 1, 0.5 / self.pos, 0.5 / (1 - self.pos)) ** 0.5  # half-way towards balance
        self.weight = weight / weight.mean()
        inside = set(use.tolist())
        pairs = [q for q in pairs if q[0] in inside]
        pairs = [q for q in pairs if q[1] or q[2]]  # others change no score
        self.p = len(pairs)
        self.more, self.less = (
            (np.repeat(np.arange(self.p), [len(q[i]) for q in pairs]), np.array([k for q in pairs for k in q[i]], np.int64)) for i in (1, 2)
        )

    def value_and_gradient(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        """Value, gradient by weights and by bias; without the L1 term."""
        z = np.bincount(self.rows, w[self.at], self.n) + b
        value = float((self.weight * (np.logaddexp(0, z) - self.y * z)).sum() / self.n)
        r = self.weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - self.y) / self.n
        grad = np.bincount(self.at, r[self.rows], self.m)
        if self.p:
            d = np.bincount(self.more[0], w[self.more[1]], self.p).astype(float) - np.bincount(self.less[0], w[self.less[1]], self.p)
            value += self.swap_penalty / self.p * float((d * d).sum())
            d *= 2 * self.swap_penalty / self.p
            grad += np.bincount(self.more[1], d[self.more[0]], self.m) - np.bincount(self.less[1], d[self.less[0]], self.m)
        return value, grad, float(r.sum())

    def descend(self, l1: float, rounds: int) -> tuple[np.ndarray, float]:
        """Weights and bias by accelerated proximal gradient descent."""
        bound = self.weight.max() * (_norm(self.rows, self.at, self.n, self.m) + self.n) / (4 * self.n)
        if self.p:
            bound += 4 * self.swap_penalty / self.p * (_norm(*self.more, self.p, self.m) + _norm(*self.less, self.p, self.m))
        step = 1 / bound
        w, b = np.zeros(self.m), float(np.log(self.pos / (1 - self.pos)))
        v, c, t = w.copy(), b, 1.0
        for _ in range(rounds):
            _, grad, d_bias = self.value_and_gradient(v, c)
            new = v - step * grad
            new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
            b_new = c - step * d_bias
            t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
            v, c = new + (t - 1) / t_new * (new - w), b_new + (t - 1) / t_new * (b_new - b)
            w, b, t = new, b_new, t_new
        return w, b


def swap_changes(model: ToxicityModel, texts: list[str]) -> list[float]:
    """Change of score of each text, given a neutral mention where it has none, when its identity terms are swapped."""
    out = []
    for text in texts:
        words = {f for f in with_mention(features(text), zlib.crc32(text.encode("utf-8", "surrogatepass"))) if f in model.weights}
        other = {f for f in swapped(with_mention(features(text), zlib.crc32(text.encode("utf-8", "surrogatepass")))) if f in model.weights}
        a, b = (1 / (1 + np.exp(-np.clip(model.bias + sum(model.weights[f] for f in some), -40, 40))) for some in (words, other))
        out.append(float(abs(a - b)))
    return out


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a score by logistic regression with smoothed labels, by damped Newton steps."""
    goal = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        d, h = p - goal, np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        move = np.linalg.solve(hess, [(d * z).sum(), d.sum()])
        a, b = a - np.clip(move[0], -0.5, 0.5), b - np.clip(move[1], -0.5, 0.5)
    return float(a), float(b)


def _norm(rows: np.ndarray, cols: np.ndarray, n: int, m: int) -> float:
    """Largest eigenvalue of the Gram matrix of a 0/1 sparse matrix, by power iteration with a margin."""
    if not len(rows):
        return 1e-9
    x = np.ones(m)
    top = 0.0
    for _ in range(15):
        x /= max(np.linalg.norm(x), 1e-300)
        x = np.bincount(cols, np.bincount(rows, x[cols], n)[rows], m)
        top = float(np.linalg.norm(x))
    return 1.1 * top + 1e-9


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", id_col: str = "doc_id", label: str = "toxic", rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Train on labelled documents: all of them, or where there are more than `rows`, a hash sample of about that size.

    labels: (id, label 0/1), sampled before the join so that the broadcast side is bounded by `rows`.
    Rows with a null label or text are left out; of repeated labels the larger counts, of documents that share
    an id the smallest text.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max(F.col(label).cast("int")).alias("y"))
    total = known.count()
    share = min(1.0, rows / max(total, 1))
    picked = known.where(F.pmod(F.xxhash64("i", F.lit(23)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"i": pdf["i"], "y": pdf["y"], "f": ["\n".join(sorted(features(t))) for t in pdf["t"]]})

    joined = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("i"), F.col(text).alias("t")).join(F.broadcast(picked), "i")
    joined = joined.groupBy("i").agg(F.max("y").alias("y"), F.min("t").alias("t"))
    got = joined.mapInPandas(reduce, "i long, y int, f string").toPandas().sort_values("i", kind="stable")
    return train(list(got["f"]), [int(y) for y in got["y"]])


def score(docs: DataFrame, model: ToxicityModel, *, text: str = "text", name: str = "toxicity") -> DataFrame:
    """docs with the score as a double column; a column of docs of that name is replaced.

    Null and empty texts have no features and get the score of the bias. Every row stays, repeats included.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: features of at most `rows` texts, most of them dropped by the L1 term

    @F.pandas_udf("double")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(x) for x in t], dtype=float)

    keep = [c for c in docs.columns if c.lower() != name.lower()]
    return docs.select(*[F.col(f"`{c}`") for c in keep], run(F.col(text)).alias(name))
