"""Toxicity by a convolutional classifier over hashed word embeddings."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import release, working
from sedge.llm.supervised import labelled_sample, minibatches, scored, sigmoid

#: Hash space of the embeddings, their size, filter widths and filters of each width.
SPACE, SIZE, WIDTHS, FILTERS = 1 << 24, 8, (1, 2, 3), 8
_WORD = re.compile(r"[^\W\d_]+")


def _buckets(word: str) -> tuple[int, int, int]:
    """Buckets of the word, its first four and its first six letters."""
    return tuple(zlib.crc32(f"{n}{part}".encode("utf-8", "surrogatepass")) % SPACE for n, part in enumerate((word, word[:4], word[:6])))


@dataclass
class Convolution:
    """Rows of the embedding table that training touched (all others are zero), filters, output weights.

    A word's vector is the sum of its three buckets' rows.  As filters are linear, every distinct word's response to
    every filter column is worked out once for a worker's cache, and a text's responses are sums of table rows."""

    buckets: np.ndarray
    rows: np.ndarray
    filters: dict[int, np.ndarray]
    out: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._reset()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        self._reset()

    def _reset(self) -> None:
        self._known: dict[str, int] = {}
        self._table = np.zeros((1024, sum(WIDTHS) * FILTERS), np.float32)

    def _learn(self, words: set[str]) -> None:
        if len(self._known) + len(words) > 200_000:
            self._reset()
        new = list(words)
        b = np.array([_buckets(w) for w in new]).reshape(-1)
        at = np.minimum(np.searchsorted(self.buckets, b), max(0, len(self.buckets) - 1))
        hit = (self.buckets[at] == b)[:, None] if len(self.buckets) else np.zeros((len(b), 1), bool)
        x = np.where(hit, self.rows[at] if len(self.buckets) else 0, 0).reshape(len(new), 3, -1).sum(axis=1) if len(self.buckets) else np.zeros((len(new), SIZE))
        y = np.concatenate([x @ self.filters[k][j] for k in WIDTHS for j in range(k)], axis=1)
        n = len(self._known) + 1  # row 0 is the padding
        while n + len(new) > len(self._table):
            self._table = np.concatenate([self._table, np.zeros_like(self._table)])
        self._table[n : n + len(new)] = y
        self._known.update(zip(new, range(n, n + len(new)), strict=True))

    def score(self, texts: list[str]) -> np.ndarray:
        working("toxicity")
        out = np.zeros(len(texts))
        for n, t in enumerate(texts):
            words = _WORD.findall(t.lower())
            ids = list(map(self._known.get, words))
            if None in ids:
                self._learn({w for w, i in zip(words, ids, strict=True) if i is None})
                ids = [self._known.get(w) for w in words]
                if None in ids:
                    self._learn(set(words))
                    ids = [self._known[w] for w in words]
            out[n] = self._pooled(np.array([0, 0, *ids, 0, 0], np.int64))
        return sigmoid(out)

    def _pooled(self, ids: np.ndarray) -> float:
        """The text's logit: filters slide over the whole padded text, each keeps its maximum."""
        total, column, n = self.bias, 0, 0
        best = [np.full(FILTERS, -np.inf) for _ in WIDTHS]
        for at in range(0, len(ids), 50_000):
            x = self._table[ids[max(0, at - max(WIDTHS) + 1) : at + 50_000]]
            column = 0
            for w, k in enumerate(WIDTHS):
                m = len(x) - k + 1
                if m > 0:
                    y = sum(x[j : m + j, column + j * FILTERS : column + (j + 1) * FILTERS] for j in range(k))
                    best[w] = np.maximum(best[w], y.max(axis=0))
                column += k * FILTERS
        for b in best:
            total += float(self.out[n : n + FILTERS] @ np.maximum(b, 0))
            n += FILTERS
        return total


def train(sample: list[tuple], epochs: int = 8, rate: float = 0.15, seed: int = 6) -> Convolution:
    """Learns from (doc_id, text, label, lang) rows.

    Through max pooling only the winning positions get a gradient, so a step touches few rows; Adagrad on those.  A
    tenth of the sample is kept back to set each language's threshold (below)."""
    rng = np.random.default_rng(seed)
    filters = {k: rng.standard_normal((k, SIZE, FILTERS)) * 0.5 for k in WIDTHS}
    out, bias = np.full(len(WIDTHS) * FILTERS, 0.5), -2.0
    y = np.array([r[2] for r in sample], float)
    if not len(y) or y.min() == y.max():
        return Convolution(np.zeros(0, np.int64), np.zeros((0, SIZE)), filters, out, bias)
    known: dict[str, int] = {}
    bags = [np.array([known.setdefault(w, len(known)) for w in _WORD.findall(r[1].lower())], np.int64) for r in sample]
    buckets, inverse = np.unique(np.array([_buckets(w) for w in known]).reshape(-1), return_inverse=True)
    three = np.concatenate([inverse.reshape(-1, 3), np.full((1, 3), len(buckets))])  # the last word pads
    rows = np.concatenate([rng.standard_normal((len(buckets), SIZE)) * 0.01, np.zeros((1, SIZE))])
    sums = {"E": np.full_like(rows, 1e-2), "o": np.full_like(out, 1e-2), **{k: np.full_like(f, 1e-2) for k, f in filters.items()}}
    fit = np.array([i for i in range(len(y)) if i % 10]) if len(y) >= 200 else np.arange(len(y))
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    epochs = max(epochs, min(60, 16_000 // len(y)))
    for batch in minibatches(len(fit), 32, epochs, seed):
        grad_f, grad_o, hit, grad_e, grad_b = {k: np.zeros_like(f) for k, f in filters.items()}, np.zeros_like(out), [], [], 0.0
        for i in fit[batch]:
            ids = three[np.concatenate([[-1, -1], bags[i], [-1, -1]])]
            x = rows[ids].sum(axis=1)
            best = []
            for k in WIDTHS:
                z = sum(x[j : len(x) - k + 1 + j] @ filters[k][j] for j in range(k))
                t = z.argmax(axis=0)
                best.append((t, np.maximum(z[t, np.arange(FILTERS)], 0)))
            m = np.concatenate([b[1] for b in best])
            d = weight[i] * (sigmoid(out @ m + bias) - y[i]) / len(batch)
            grad_o += d * m
            grad_b += d
            for n, (k, (t, v)) in enumerate(zip(WIDTHS, best, strict=True)):
                back = d * out[n * FILTERS : (n + 1) * FILTERS] * (v > 0)
                for j in range(k):
                    grad_f[k][j] += x[t + j].T * back
                    hit.append(ids[t + j].reshape(-1))
                    grad_e.append(np.repeat((filters[k][j] * back).T, 3, axis=0))
        at, where = np.unique(np.concatenate(hit), return_inverse=True)
        g = np.zeros((len(at), SIZE))
        np.add.at(g, where, np.concatenate(grad_e))
        g[at == len(buckets)] = 0
        sums["E"][at] += g * g
        rows[at] -= rate * g / np.sqrt(sums["E"][at])
        for k in WIDTHS:
            grad_f[k] += 1e-4 * filters[k]
            sums[k] += grad_f[k] ** 2
            filters[k] -= 0.2 * rate * grad_f[k] / np.sqrt(sums[k])
        sums["o"] += grad_o**2
        out -= 0.2 * rate * grad_o / np.sqrt(sums["o"])
        bias -= 0.5 * rate * grad_b
    used = (sums["E"][:-1] > 1e-2).any(axis=1)  # a row that no step moved holds only its small first noise
    model = Convolution(buckets[used], rows[:-1][used], filters, out, float(bias))
    model.thresholds = _thresholds(model, [sample[i] for i in range(len(y)) if i % 10 == 0])
    return model


def _thresholds(model: Convolution, rows: list[tuple], least: int = 10) -> dict[str, float]:
    """For each language with enough rows of both kinds, the cut with the best F1 on the kept-back rows, nearest to 0.5; '' is for the rest."""
    out = {"": 0.5}
    if not rows:
        return out
    scores, y = model.score([r[1] for r in rows]), np.array([r[2] for r in rows])
    for lang in sorted({r[3] for r in rows if r[3] is not None}):
        at = np.array([r[3] == lang for r in rows])
        if min(y[at].sum(), (1 - y[at]).sum()) >= least:
            cuts = np.arange(5, 96) / 100
            f1 = [2 * ((scores[at] >= c) & (y[at] == 1)).sum() / max(1, (scores[at] >= c).sum() + y[at].sum()) for c in cuts]
            out[lang] = float(min((c for c, f in zip(cuts, f1, strict=True) if f == max(f1)), key=lambda c: abs(c - 0.5)))
    return out


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", cut: float = 0.5, text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (score >= cut), and threshold and flagged (score >= the language's threshold).

    The model learns from a bounded sample of labelled rows outside the held-out fold, from texts alone, on the driver;
    lang only picks the threshold of `flagged`, never a score.  Every whole text is scored where the scan reads it.  A
    null or empty text scores as one without words; a null or rare language gets the threshold 0.5; without labels of
    both kinds the model is untrained.  Repeated rows score alike; extra columns are ignored.
    """
    spark = docs.sparkSession
    fitted = train(labelled_sample(docs, labels, label, text))
    model = spark.sparkContext.broadcast(fitted)
    release()
    docs = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    out = scored(docs, lambda texts: model.value.score(texts), cut, text, ["lang"])
    cuts = F.create_map(*(F.lit(x) for pair in (fitted.thresholds or {"": 0.5}).items() for x in pair))
    out = out.withColumn("threshold", F.coalesce(F.try_element_at(cuts, F.coalesce(F.col("lang"), F.lit(""))), F.lit(0.5)))
    return out.withColumn("flagged", (F.col("score") >= F.col("threshold")).cast("int")).drop("lang")
