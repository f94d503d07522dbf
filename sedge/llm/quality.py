"""Document quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import caches, release, working
from sedge.llm.supervised import Adam, labelled_sample, minibatches, scored, sigmoid

#: Words of a passage, its feature buckets (word shapes, words, two for repeats), units of the encoder and of attention.
PASSAGE, SHAPES, WORDS, UNITS, GATE = 64, 192, 64, 24, 12
FEATURES = SHAPES + WORDS + 2
_CLASSES = (("a", re.compile(r"[^\W\d_A-Z]+")), ("A", re.compile(r"[A-ZÀ-ÖØ-Þ]+")), ("0", re.compile(r"[0-9]+")))


def _shape(word: str) -> str:
    """Runs of lower-case letters, capitals and digits as one sign each, other characters as they are, runs of one cut to two."""
    for sign, pattern in _CLASSES:
        word = pattern.sub(lambda m, s=sign: (s + s if len(m[0]) > 1 else s) if s != "a" else s, word)
    return re.sub(r"(.)\1{2,}", r"\1\1", word)


class _Codes(dict):
    """Word -> shape bucket, word bucket and 31 bits of its hash in one number."""

    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.lower().encode("utf-8", "surrogatepass"))
        code = zlib.crc32(_shape(word).encode("utf-8", "surrogatepass")) % SHAPES << 48 | h % WORDS << 40 | h
        if len(self) < 250_000:
            self[word] = code
        return code


_codes = _Codes()
caches("quality", _codes.clear)


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and each passage's text number.  A passage is PASSAGE words in a row, of
    the whole text; a text without words is one passage without features."""
    codes, owner, first = [], [], 0
    for n, t in enumerate(texts):
        words = t.split()
        codes.append(np.fromiter(map(_codes.__getitem__, words), np.int64, len(words)))
        owner += [n] * max(1, -(-len(words) // PASSAGE))
    x = np.zeros((len(owner), FEATURES))
    flat = x.reshape(-1)
    for c in codes:
        if len(c):
            at = (first + np.arange(len(c)) // PASSAGE) * FEATURES
            same = np.zeros(len(c), bool)
            same[1:] = (c[1:] & 0xFFFFFFFF) == (c[:-1] & 0xFFFFFFFF)
            every = np.concatenate([at + (c >> 48), at + SHAPES + (c >> 40 & 0xFF), at[same] + SHAPES + WORDS])
            lo, hi = first * FEATURES, (first + -(-len(c) // PASSAGE)) * FEATURES
            flat[lo:hi] = np.bincount(every - lo, minlength=hi - lo)
        first += max(1, -(-len(c) // PASSAGE))
    n = x[:, :SHAPES].sum(axis=1, keepdims=True)
    x /= np.maximum(n, 1)
    x[:, -1] = np.log1p(n[:, 0]) / 5
    return np.sqrt(x), np.array(owner)


@dataclass
class Attention:
    """Encoder tanh(x W + b), gated attention w.(tanh(V h) * sigmoid(U h)), logistic score of the weighted passages."""

    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int) -> Attention:
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.standard_normal(s) * (0.5 if s[0] == FEATURES else 1 / np.sqrt(s[0]))
        return cls({"W": draw(FEATURES, UNITS), "b": np.zeros(UNITS), "V": draw(UNITS, GATE), "U": draw(UNITS, GATE), "w": draw(GATE, 1)[:, 0] * 0.1, "o": draw(UNITS, 1)[:, 0], "c": np.zeros(1)})

    def forward(self, x: np.ndarray, owner: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        a = (t * s) @ p["w"]
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        a = np.exp(a - np.maximum.reduceat(a, starts)[owner])
        a /= np.add.reduceat(a, starts)[owner]
        z = np.add.reduceat(h * a[:, None], starts, axis=0)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "y": sigmoid(z @ p["o"] + p["c"]), "starts": starts}

    def gradients(self, x: np.ndarray, owner: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, owner)
        d = weight * (f["y"] - label) / len(label)
        dz = d[:, None] * p["o"]
        dh = f["a"][:, None] * dz[owner]
        da = (f["h"] * dz[owner]).sum(axis=1)
        da = f["a"] * (da - np.add.reduceat(f["a"] * da, f["starts"])[owner])
        g = da[:, None] * p["w"]
        dt, ds = g * f["s"] * (1 - f["t"] ** 2), g * f["t"] * f["s"] * (1 - f["s"])
        dh += dt @ p["V"].T + ds @ p["U"].T
        dh *= 1 - f["h"] ** 2
        return {"W": x.T @ dh + 1e-5 * p["W"], "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ da, "o": f["z"].T @ d + 1e-4 * p["o"], "c": d.sum(keepdims=True)}

    def score(self, texts: list[str]) -> np.ndarray:
        working("quality")
        if not texts:
            return np.zeros(0)
        return self.forward(*passages(texts))["y"]


def train(sample: list[tuple], epochs: int = 25, rate: float = 0.01, seed: int = 5) -> Attention:
    """Learns from (doc_id, text, label, ...) rows; classes weigh alike.  Without rows of both labels the new model."""
    model = Attention.new(seed)
    y = np.array([r[2] for r in sample], float)
    if not len(y) or y.min() == y.max():
        return model
    bags = [passages([r[1]])[0].astype(np.float32) for r in sample]
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    adam = Adam(model.p, rate)
    epochs = max(epochs, min(200, 20_000 // len(y)))
    for rows in minibatches(len(y), 64, epochs, seed):
        x = np.concatenate([bags[i] for i in rows]).astype(np.float64)
        owner = np.repeat(np.arange(len(rows)), [len(bags[i]) for i in rows])
        adam.step(model.gradients(x, owner, y[rows], weight[rows]))
    return model


def _model(docs: DataFrame, labels: DataFrame, label: str, text: str) -> Broadcast:
    model = docs.sparkSession.sparkContext.broadcast(train(labelled_sample(docs, labels, label, text)))
    release()
    return model


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", cut: float = 0.3, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= cut) for every row of docs.

    The model learns from a bounded sample of labelled rows outside the held-out fold (supervised.SAMPLE_ROWS of each
    class), on the driver, from texts alone; scoring reads every whole text, in passages, where the scan reads it.
    A null or empty text is one passage without words and gets a score too.  Without labels of both kinds scores are
    those of an untrained model.  Repeated rows score alike; extra columns are ignored but for `keep`.
    """
    model = _model(docs, labels, label, text)
    return scored(docs, lambda texts: model.value.score(texts), cut, text, keep)


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", cut: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns; needs one map, no join."""
    model = _model(docs, labels, label, text)
    names = {c: f"c{n}" for n, c in enumerate(docs.columns)}
    rows = docs.withColumnsRenamed(names).withColumn("doc_id", F.lit(None).cast("long"))
    out = scored(rows, lambda texts: model.value.score(texts), cut, names[text], list(names.values()))
    return out.where("predicted = 1").select(*(F.col(n).alias(c) for c, n in names.items()))
