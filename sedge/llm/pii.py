"""Personal data: fixed patterns as a base, and a linear-chain conditional random field that adds to them."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import texts_of

KINDS = ("email", "ip", "card", "phone")
#: 0: outside; 2k + 1 and 2k + 2: first and further token of kind k.
LABELS = 1 + 2 * len(KINDS)

# fixed values: the four base patterns
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HOT = re.compile(r"[0-9@]")
_BLANKS = " \t\n\x0b\x0c\r"
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_AFTER = re.compile(r" *([^ \n]*)")


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(map(int, reversed(digits))):
        total += d if n % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def valid(kind: str, text: str) -> bool:
    """Whether a candidate of this kind counts."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))
    digits = re.sub("[^0-9]", "", text)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping e-mail addresses, found from their @: the local part is the run of its characters before it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) by start, then kind.

    The patterns of ip, card and phone are searched for with possessive runs, so long digit runs cost one pass."""
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    if _HOT.search(text):
        for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
            out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if valid(KINDS[kind], m.group())]
    return sorted(out, key=lambda s: (s[0], s[2]))


def as_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


# ---- the random field -----------------------------------------------------------------------------------------------


def shape(token: str) -> str:
    """Digit runs as their length (9 at most), letter runs as x, others as they are, repeats once."""
    t = re.sub(r"[0-9]+", lambda m: str(min(9, len(m[0]))), re.sub(r"[^\W\d_]+", "x", token))
    return re.sub(r"(.)\1+", lambda m: m[1] if not m[1].isdigit() else m[0], t)


def features(token: str) -> list[str]:
    """Word-shape features of one token; '' stands for a line's or text's end."""
    if not token:
        return ["end"]
    s, digits = shape(token), sum(c.isdigit() for c in token)
    core = s.strip(".,;:!?*$&%#\"'")
    if not digits and "@" not in token:
        return ["cold", f"cold:{core[-2:]}"]
    return [f"s:{core}", f"n:{min(digits, 20)}", f"first:{core[:1]}", f"last:{core[-1:]}", f"two:{core[:2]}", f"dots:{min(4, token.count('.'))}", f"at:{'@' in token}", f"dash:{min(3, token.count('-'))}", f"letters:{bool(re.search(r'[^\W\d_]', token))}", f"signs:{''.join(sorted(set(re.findall('[()+@./-]', core))))}"]


def examples(n: int = 700, seed: int = 8) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """A small labelled table made from rules: (text, [(start, end, kind)]), with look-alikes that are no personal data."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "er", "on", "th", "de", "ch", "ou", "ga", "li", "st")) for _ in range(r.randint(1, 4)))
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        digits = r.choice("3456") + d(r.choice((13, 14, 14, 15)))
        digits += next(c for c in "0123456789" if luhn(digits + c))
        cut = r.choice(("", " ", "-", ""))
        return cut.join(digits[i : i + 4] for i in range(0, len(digits), 4)) if cut else digits

    def phone() -> str:
        a, b, c = d(3), d(3), d(4)
        return r.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{d(2)} {a} {b} {c}", f"+1-{a}-{b}-{c}", f"+{d(2)}{a}{b}{c}", f"({a}) {b} {c}", f"+{d(2)} {d(3)} {d(7)}"))

    makers = {
        "email": lambda: f"{word()}{r.choice(('.', '_', ''))}{d(r.randint(0, 2))}@{word()}{d(r.randint(0, 1))}.{r.choice(('com', 'org', 'example.com', 'de'))}",
        "ip": lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)),
        "card": card,
        "phone": phone,
    }
    none = (lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"{d(2)}:{d(2)}", lambda: f"{d(1)}.{d(1)}", lambda: f"version {d(1)}.", lambda: f"{d(r.randint(1, 7))}", lambda: f"${d(2)}.{d(2)}", lambda: f'"{hashlib.md5(d(9).encode()).hexdigest()}"', lambda: f"password={hashlib.md5(d(9).encode()).hexdigest()[:18]}", lambda: f"{d(1)}.{d(1)}.{d(2)}", lambda: f"{word()}@{word()}", lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: f"{d(2)}%", lambda: f"{d(5)}-{d(4)}", lambda: f"{d(3)} {d(3)} {d(2)}", lambda: f"@{word()}", lambda: f"{d(21)}", lambda: f"{d(1)},{d(3)},{d(3)}")
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 4)):
            text += "".join(word() + r.choice((" ", " ", ", ", ". ")) for _ in range(r.randint(0, 3)))
            if r.random() < 0.55:
                kind = r.choice(KINDS)
                x = makers[kind]()
                spans.append((len(text), len(text) + len(x), kind))
            else:
                x = r.choice(none)()
            text += x + r.choice((" ", " ", ", ", ". ", "%%% ", "*** "))
        out.append((text, spans))
    return out


def _runs(text: str) -> Iterator[tuple[list[tuple[int, int]], str, str]]:
    """Runs of neighbouring tokens that hold a digit or an @: their places, and the tokens before and after.

    A token without either can only be outside, so the chain falls apart there and decoding the runs one by one is exact."""
    run: list[tuple[int, int]] = []
    end, m = 0, _HOT.search(text)
    while m:
        a = m.start()
        while a > end and text[a - 1] not in _BLANKS:
            a -= 1
        t = _TOKEN.match(text, a)
        b = t.end()
        if run and text[run[-1][1] : a].strip(" ") == "":
            run.append((a, b))
        else:
            if run:
                yield _placed(text, run)
            run = [(a, b)]
        end, m = b, _HOT.search(text, b)
    if run:
        yield _placed(text, run)


def _placed(text: str, run: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], str, str]:
    start, end = run[0][0], run[-1][1]
    while start > 0 and text[start - 1] == " ":
        start -= 1
    at = start
    while at > 0 and text[at - 1] not in " \n":
        at -= 1
    return run, text[at:start], _AFTER.match(text, end)[1]


class Field:
    """Weights of token features for the token itself, the one before and the one after; transitions; start and end at 0."""

    def __init__(self, known: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.known, self.weights, self.moves, self.cache = known, weights, moves, {}

    def __getstate__(self):
        return {"known": self.known, "weights": self.weights, "moves": self.moves}

    def __setstate__(self, state):
        self.__init__(**state)

    def vectors(self, token: str) -> np.ndarray:
        """The token's part in its own, its follower's and its forerunner's label scores."""
        if token not in self.cache:
            if len(self.cache) > 50_000:
                self.cache.clear()
            at = [self.known[f] for f in features(token) if f in self.known]
            self.cache[token] = self.weights[:, at].sum(axis=1) if at else np.zeros((3, LABELS))
        return self.cache[token]

    def emissions(self, tokens: list[str], before: str, after: str) -> np.ndarray:
        v = np.stack([self.vectors(t) for t in (before, *tokens, after)])
        return v[1:-1, 0] + v[:-2, 1] + v[2:, 2]

    def decode(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi over many runs at once: sorted by length, a step advances all runs that still go on."""
        order = sorted(range(len(runs)), key=lambda n: -len(runs[n]))
        out: list = [None] * len(runs)
        for at in range(0, len(order), 2048):
            part = order[at : at + 2048]
            sizes = np.array([len(runs[n]) for n in part])
            score = np.stack([runs[n][0] for n in part]) + self.moves[0]
            back = []
            for t in range(1, sizes[0]):
                live = int((sizes > t).sum())
                step = score[:live, :, None] + self.moves
                best = step.argmax(axis=1)
                back.append(best)
                score[:live] = np.take_along_axis(step, best[:, None, :], axis=1)[:, 0] + np.stack([runs[n][t] for n in part[:live]])
            last = (score + self.moves[:, 0]).argmax(axis=1)
            for k, n in enumerate(part):
                path = [last[k]]
                for t in range(sizes[k] - 1, 0, -1):
                    path.append(back[t - 1][k][path[-1]])
                out[n] = np.array(path[::-1])
        return out


def _allowed() -> np.ndarray:
    """0 where label j may follow label i, else a large penalty: further tokens only follow their own kind."""
    out = np.zeros((LABELS, LABELS))
    for k in range(len(KINDS)):
        out[:, 2 * k + 2] = -1e4
        out[2 * k + 1 : 2 * k + 3, 2 * k + 2] = 0
    return out


def train(table: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 12, rate: float = 0.2, seed: int = 8) -> Field:
    """Maximum likelihood by forward-backward and Adagrad, one run of tokens at a time."""
    known: dict[str, int] = {}
    data = []
    for text, spans in table:
        for run, before, after in _runs(text):
            gold = []
            for a, b in run:
                label = 0
                for s, e, kind in spans:
                    if a < e and s < b:
                        label = 2 * KINDS.index(kind) + (1 if a <= s or not gold else 2)
                gold.append(label)
            tokens = [before, *(text[a:b] for a, b in run), after]
            data.append(([[known.setdefault(f, len(known)) for f in features(t)] for t in tokens], gold))
    w, moves, allowed = np.zeros((3, len(known), LABELS)), np.zeros((LABELS, LABELS)), _allowed()
    sums, msums = np.full_like(w, 0.1), np.full_like(moves, 0.1)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for n in rng.permutation(len(data)):
            at, gold = data[n]
            size = len(gold)
            e = np.stack([w[0][at[t + 1]].sum(axis=0) + w[1][at[t]].sum(axis=0) + w[2][at[t + 2]].sum(axis=0) for t in range(size)])
            m = moves + allowed
            f, b = np.zeros((size, LABELS)), np.zeros((size, LABELS))
            f[0] = e[0] + m[0]
            for t in range(1, size):
                f[t] = e[t] + np.logaddexp.reduce(f[t - 1][:, None] + m, axis=0)
            b[-1] = m[:, 0]
            for t in range(size - 2, -1, -1):
                b[t] = np.logaddexp.reduce(m + (e[t + 1] + b[t + 1])[None, :], axis=1)
            z = np.logaddexp.reduce(f[-1] + b[-1])
            g = np.exp(f + b - z)
            gm = np.zeros_like(moves)
            gm[0] += g[0]
            gm[:, 0] += g[-1]
            for t in range(1, size):
                gm += np.exp(f[t - 1][:, None] + m + (e[t] + b[t])[None, :] - z)
            for t, y in enumerate(gold):
                g[t, y] -= 1
                gm[gold[t - 1] if t else 0, y] -= 1
            gm[gold[-1], 0] -= 1
            for t in range(size):
                for o, k in ((0, t + 1), (1, t), (2, t + 2)):
                    i = at[k]
                    grad = g[t] + 1e-3 * w[o][i]
                    sums[o][i] += grad**2
                    w[o][i] -= rate * grad / np.sqrt(sums[o][i])
            msums += gm**2
            moves -= rate * gm / np.sqrt(msums)
    return Field(known, w, moves + allowed)


@cache
def default_field() -> Field:
    return train(examples())


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    """The span without signs that only stand around it."""
    while a < b and not (text[a].isalnum() or text[a] in "+("):
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return a, b


def find(texts: list[str], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text its base spans, and those and the field's together.

    A field's span counts if its trimmed text passes its kind's check (an e-mail: that it is one) and it overlaps no
    base span."""
    base = [base_spans(t) for t in texts]
    runs, emitted = [], []
    for n, text in enumerate(texts):
        for run, before, after in _runs(text):
            runs.append((n, run))
            emitted.append(field.emissions([text[a:b] for a, b in run], before, after))
    more: dict[int, list] = {}
    for (n, run), path in zip(runs, field.decode(emitted), strict=True):
        t = 0
        while t < len(path):
            if not (y := path[t]):
                t += 1
                continue
            kind, first = (y - 1) // 2, t
            t += 1
            while t < len(path) and path[t] == 2 * kind + 2:
                t += 1
            a, b = _trim(texts[n], run[first][0], run[t - 1][1])
            part = texts[n][a:b]
            shaped = (_DOMAIN.search(part) and 0 < part.find("@") and part.count("@") == 1) if kind == 0 else re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}" if kind == 1 else r"[0-9](?:[ -]?[0-9])+" if kind == 2 else r"\(?[+0-9][\x20().0-9-]*[0-9]", part)
            if shaped and valid(KINDS[kind], part):
                more.setdefault(n, []).append((a, b, kind))
    out = []
    for n, spans in enumerate(base):
        new = [s for s in more.get(n, ()) if not any(s[0] < e and a < s[1] for a, e, _ in spans)]
        out.append((spans, sorted(spans + new, key=lambda s: (s[0], s[2]))))
    return out


def find_pii(docs: DataFrame, table: list[tuple[str, list[tuple[int, int, str]]]] | None = None, text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the base), base_sha256, spans, and n_added by the field, for every row.

    Every whole text is searched where the scan reads it.  The field is trained on the driver from the small labelled
    `table` (default: examples()).  A null or empty text has no spans; repeated rows are searched each; a null doc_id
    stays null; extra columns are ignored.
    """
    field = docs.sparkSession.sparkContext.broadcast(train(table) if table else default_field())
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = find(texts_of(part), field.value)
                counts = [pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)]
                digest = pa.array([hashlib.sha256(as_text(base).encode()).hexdigest() for base, _ in found], pa.string())
                spans = pa.array([as_text(every) for _, every in found], pa.string())
                added = pa.array([len(every) - len(base) for base, every in found], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, digest, spans, added], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
