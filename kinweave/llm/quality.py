"""Quality classifier from weak labels.

Heuristic labellers vote on each text: 1 (junk), 0 (fine) or -1 (abstain). Labellers overlap, and junk comes in kinds: a
kind is found by some labellers and held for fine by the others. So a text is fine or of one of as many kinds of junk as there are labellers.
Expectation-maximisation over the table of vote patterns of all documents (at most 3 ** labellers rows, so its
size doesn't grow with the corpus) estimates how often each labeller objects to fine texts and to each kind, and how common
each kind is; every round raises the posterior density. A text's chance of junk then follows from its pattern. These chances train a
logistic scorer on hashed features of the text, which judges every document, also where all labellers abstain.

The scorer is fitted on a bounded sample: about `sample` documents with the smallest hashes of id and text, and as
many of those that the labellers hold for junk, so that rare junk is learnt; rows that repeat are one. All counts are over all documents.

Defined results: a null or empty text counts as junk with score 0 and isn't kept (parameter keep_empty). Rows that repeat are
judged each alike. If no document has a vote, all are kept. An empty table gives an empty one.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import LOWER_CODE, U64, mix64, slices, tidied, word_hash, word_spans

ABSTAIN, FINE, JUNK = -1, 0, 1
#: Width of the hashed features.
WIDTH = 1 << 12
SAMPLE = 4000
#: Bytes of text that are measured at once; the arrays made of them are some 50 times larger.
PIECE = 1 << 20
#: What each chance of an objection has seen beforehand, of objections and of approvals.
SEEN = 0.5
#: Signs that prose rarely ends words with, punctuation around words, and the widest word end that a feature names.
ODD = b"#$%&*@^~|<>{}[]\\=+_"
AROUND = b".,;:!?\"'()"

# what a byte adds to a word's packed counts: 16 bits each for characters, capitals, small letters and other letters
_CHAR, _UPPER, _SMALL, _OTHER = (1 << s for s in (0, 16, 32, 48))
_ADDS = np.array([(_CHAR if c & 0xC0 != 0x80 else 0) + (_UPPER if 65 <= c <= 90 else _SMALL if 97 <= c <= 122 else _OTHER if c >= 0xC0 else 0) for c in range(256)], dtype=U64)
_BARE = LOWER_CODE.copy()
_BARE[list(AROUND)] = 0


def _member(signs: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(signs)] = True
    return out


_IS_ODD, _IS_STOP, _IS_LOUD = _member(ODD), _member(b".!?"), _member(b"!?")
_IS_END = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)])
_IS_DIGIT = np.array([48 <= c <= 57 for c in range(256)])


def measure(texts: list[bytes | None]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The figures that labellers and features share, a value per text; and the slot of each word's make-up, with the words per text.

    All words of a batch are measured at once, from counts of their bytes by kind.
    """
    raw = np.frombuffer(b"\n".join([t or b"" for t in texts]) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    starts, sizes, at = word_spans(raw)
    words = np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(texts))
    n = np.maximum(words, 1)
    if len(starts):
        packed = np.add.reduceat(_ADDS[raw[at]], np.r_[0, np.cumsum(sizes)[:-1]])
        chars, upper, small, other = [(packed >> U64(s) & U64(0xFFFF)).astype(np.int64) for s in (0, 16, 32, 48)]
        for i in np.flatnonzero(sizes > 0xFFFF):  # too long for 16 bits
            adds = _ADDS[raw[starts[i] : starts[i] + sizes[i]]]
            chars[i], upper[i], small[i], other[i] = (int((adds >> U64(s) & U64(1)).sum()) for s in (0, 16, 32, 48))
        bare = word_hash(raw, starts, sizes, at, _BARE)
        last, third = raw[starts + sizes - 1], raw[starts + np.maximum(sizes - 3, 0)]
        second = np.where(sizes > 1, raw[starts + np.maximum(sizes - 2, 0)], 0).astype(np.uint8)
        first = raw[starts]
    else:
        chars = upper = small = other = np.empty(0, dtype=np.int64)
        bare, last, second, third, first = np.empty(0, dtype=U64), *(np.empty(0, dtype=np.uint8) for _ in range(4))
    caps = (upper > 0) & (small == 0) & (chars > 1)
    odd = (chars > 1) & (_IS_ODD[last] | _IS_ODD[second] | ((sizes > 2) & _IS_ODD[third]))
    bars = (sizes == 1) & ((first == 124) | (first == 62))
    short = chars - _IS_END[last] <= 3
    letters = upper + small + other
    owner = np.repeat(np.arange(len(texts)), words)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(owner, flags, len(texts)) / n

    cuts = np.r_[0, np.cumsum(words)]
    top, pair, run, distinct, repeat, lines = (np.zeros(len(texts)) for _ in range(6))
    for i, text in enumerate(texts):
        own = [x for x in (text or b"").split(b"\n") if x.strip()]
        lines[i] = len(own)
        repeat[i] = 1 - len(set(own)) / len(own) if own else 0
        b = bare[cuts[i] : cuts[i + 1]]
        if len(b):
            counts = _run_lengths(np.sort(b))
            top[i], distinct[i] = counts.max(), len(counts)
            run[i] = _run_lengths(b).max()
        if len(b) > 1:
            pair[i] = _run_lengths(np.sort(b[:-1] * U64(0x9E3779B97F4A7C15) ^ b[1:])).max()
    size = np.bincount(np.searchsorted(ends, np.arange(len(raw)), side="right"), (raw & 0xC0) != 0x80, len(texts)) if len(raw) < 1 << 16 else np.add.reduceat(((raw & 0xC0) != 0x80).astype(np.int64), np.r_[0, ends[:-1]])
    case = np.where(upper == 0, 0, np.where((small == 0) & (upper > 1), 2, 1)) + 3 * ((letters == 0).astype(np.int64) + 2 * _IS_DIGIT[first])
    tail = np.where(_IS_END[last], last, 0).astype(np.int64)
    tail = tail + 256 * np.where((tail > 0) & _IS_END[second], second, 0).astype(np.int64)
    makes = (mix64((case * 65536 + tail).astype(U64)) % U64(WIDTH)).astype(np.int64)
    figures = {
        "words": words, "lines": lines, "mean": share(chars), "caps": share(caps), "bang": share(_IS_LOUD[last] & _IS_LOUD[second]), "odd": share(odd), "bars": share(bars),
        "short": share(short), "repeat_lines": repeat, "distinct": distinct / n, "top": top / n, "pair": pair / n, "run": run,
        "stops": share(_IS_STOP[last]), "letters": np.bincount(owner, letters, len(texts)) / np.maximum(1, size - 1),
    }
    return figures, makes, words


def _run_lengths(x: np.ndarray) -> np.ndarray:
    return np.diff(np.flatnonzero(np.r_[True, x[1:] != x[:-1], True]))


def _vote(junk: np.ndarray, fine: np.ndarray) -> np.ndarray:
    return np.where(junk, JUNK, np.where(fine, FINE, ABSTAIN))


#: Name and votes of each labeller, given the figures of measure().
LABELLERS = (
    ("capitals", lambda s: _vote(s["caps"] > 0.5, s["caps"] < 0.05)),
    ("shouting", lambda s: _vote(s["bang"] > 0.3, s["bang"] < 0.02)),
    ("symbols", lambda s: _vote(s["odd"] > 0.3, s["odd"] < 0.05)),
    ("menu bars", lambda s: _vote(s["bars"] > 0.15, s["bars"] < 0.02)),
    ("no function words", lambda s: _vote((s["words"] >= 20) & (s["short"] < 0.12), s["short"] > 0.25)),
    ("word runs", lambda s: _vote(s["run"] >= 8, s["run"] <= 3)),
    ("one pair rules", lambda s: _vote((s["words"] >= 30) & (s["pair"] > 0.15), s["pair"] < 0.03)),
    ("repeated lines", lambda s: _vote((s["lines"] >= 6) & (s["repeat_lines"] > 0.5), (s["lines"] >= 2) & (s["repeat_lines"] < 0.1))),
    ("few distinct words", lambda s: _vote((s["words"] >= 50) & (s["top"] > 0.3), s["top"] < 0.12)),
    ("letters", lambda s: _vote((s["words"] >= 20) & (s["letters"] < 0.55), s["letters"] > 0.7)),
)


def patterns_of(texts: list[bytes | None]) -> np.ndarray:
    """The votes on each text as one number in base 3; -1 for a text without words."""
    s, _, words = measure(texts)
    out = np.zeros(len(texts), dtype=np.int64)
    for _, vote in LABELLERS:
        out = 3 * out + vote(s) + 1
    return np.where(words > 0, out, -1)


def unpack(pattern: int) -> tuple[int, ...]:
    out = []
    for _ in LABELLERS:
        pattern, v = divmod(pattern, 3)
        out.append(v - 1)
    return tuple(reversed(out))


class WeakModel:
    """A text is fine (class 0) or of a kind of junk, one for each labeller; labellers are independent given the class.

    An abstention says nothing: short texts, on which most labellers abstain, aren't junk for that. Rounds start from the texts
    to which nobody objects as fine, and the others shared among the kinds of their objectors. The likelihood, with the
    density of the beta prior that SEEN stands for, rises in every round; the rounds end when it rises by a 1e-8th or less.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 300):
        k = patterns.shape[1] if len(patterns) else len(LABELLERS)
        self.shares, self.objects, self.rounds = np.full(k + 1, 1 / (k + 1)), np.full((k + 1, k), 0.5), 0
        self.densities: list[float] = []
        if not len(patterns):
            return
        junk, fine, weight = (patterns == JUNK).astype(float), (patterns == FINE).astype(float), counts.astype(float)
        post = np.concatenate([(junk.sum(axis=1, keepdims=True) == 0).astype(float), junk / np.maximum(junk.sum(axis=1, keepdims=True), 1)], axis=1)
        post = 0.98 * post + 0.02 / (k + 1)  # no class is closed to any text
        for self.rounds in range(1, rounds + 1):
            mass = weight[:, None] * post
            self.shares = mass.sum(axis=0) / weight.sum()
            bad = mass.T @ junk + SEEN
            self.objects = bad / (bad + mass.T @ fine + SEEN)
            joint = self._joint(patterns)
            whole = _log_sum(joint)
            post = np.exp(joint - whole[:, None])
            prior = SEEN * (np.log(self.objects) + np.log1p(-self.objects)).sum()
            self.densities.append(float((weight * whole).sum() + prior))
            if self.rounds > 1 and self.densities[-1] - self.densities[-2] <= 1e-8 * abs(self.densities[-2]):
                break

    @property
    def prior(self) -> float:
        """The share of junk."""
        return float(self.shares[1:].sum())

    def _joint(self, patterns: np.ndarray) -> np.ndarray:
        """Logarithms of the chance of each class together with the votes, a row per pattern."""
        votes = (patterns == JUNK) @ np.log(self.objects).T + (patterns == FINE) @ np.log1p(-self.objects).T
        return votes + np.log(np.maximum(self.shares, 1e-300))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The chance of junk for each row of votes."""
        if not len(patterns):
            return np.empty(0)
        joint = self._joint(patterns)
        return np.exp(_log_sum(joint[:, 1:]) - _log_sum(joint))

    def accuracy(self, patterns: np.ndarray, counts: np.ndarray) -> dict[int, float]:
        """For each labeller by number, the estimated share of right votes among those it gives."""
        bad = self.posterior(patterns)
        out = {}
        for j in range(patterns.shape[1]):
            right = np.where(patterns[:, j] == JUNK, bad, 1 - bad) * (patterns[:, j] != ABSTAIN) * counts
            out[j] = float(right.sum() / max(1.0, float((counts * (patterns[:, j] != ABSTAIN)).sum())))
        return out


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1)
    return top + np.log(np.exp(x - top[:, None]).sum(axis=1))


_STEPS = {
    "caps": (0.02, 0.1, 0.3, 0.6), "bang": (0.01, 0.1, 0.3, 0.6), "odd": (0.02, 0.1, 0.3, 0.6), "bars": (0.01, 0.1, 0.3),
    "short": (0.05, 0.12, 0.2, 0.3, 0.45), "repeat_lines": (0.05, 0.2, 0.5), "top": (0.08, 0.15, 0.3, 0.5), "pair": (0.02, 0.06, 0.15, 0.3),
    "run": (2, 4, 8, 16), "mean": (3, 4, 5, 6, 8, 12), "stops": (0.02, 0.05, 0.1, 0.2), "letters": (0.4, 0.6, 0.7, 0.78, 0.85), "distinct": (0.1, 0.3, 0.5, 0.8),
}


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % WIDTH


_SLOTS = {k: np.array([_slot(f"{k}>{i}") for i in range(len(steps) + 1)]) for k, steps in _STEPS.items()}


def _step_slots(figures: dict[str, np.ndarray]) -> np.ndarray:
    """A column of slots for each figure, by the steps that it has passed."""
    return np.stack([_SLOTS[k][np.searchsorted(np.array(steps, dtype=float), figures[k], side="left")] for k, steps in _STEPS.items()], axis=1)


def features(texts: list[bytes | None]) -> list[dict[int, float]]:
    """Hashed features: a slot worth 1 for each figure, and the slot of each word's make-up, worth 2 / words."""
    figures, makes, words = measure(texts)
    out = []
    for steps, own in zip(_step_slots(figures), np.split(makes, np.cumsum(words)[:-1]), strict=True):
        row: dict[int, float] = {}
        for slot in steps.tolist():
            row[slot] = row.get(slot, 0.0) + 1
        for slot, k in zip(*(x.tolist() for x in np.unique(own, return_counts=True)), strict=True):
            row[slot] = row.get(slot, 0.0) + 2 * k / len(own)
        out.append(row)
    return out


class Scorer:
    """A logistic model over hashed features; the score is the chance that a text is fine."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, rows: list[dict[int, float]], junk: np.ndarray, rounds: int = 300, rate: float = 0.5, l2: float = 1e-4) -> Scorer:
        """Full-batch AdaGrad on the posterior labels; both classes weigh the same."""
        weights, bias = np.zeros(WIDTH), 0.0
        if not rows:
            return cls(weights, 0.0)
        at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        slot = np.fromiter(itertools.chain.from_iterable(r.keys() for r in rows), dtype=np.int64)
        value = np.fromiter(itertools.chain.from_iterable(r.values() for r in rows), dtype=float)
        good = 1 - junk
        mass = np.where(good.sum() > 0, 0.5 * good / max(good.sum(), 1e-9), 0) + np.where(junk.sum() > 0, 0.5 * junk / max(junk.sum(), 1e-9), 0)
        seen, seen_bias = np.full(WIDTH, 1e-8), 1e-8
        for _ in range(rounds):
            logit = np.bincount(at, weights[slot] * value, len(rows)) + bias
            slope = mass * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - good)
            step = np.bincount(slot, slope[at] * value, WIDTH) + l2 * weights
            seen += step**2
            weights = weights - rate * step / np.sqrt(seen)
            g = slope.sum()
            seen_bias += g * g
            bias -= rate * g / math.sqrt(seen_bias)
        return cls(weights, float(bias))

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        """0 for texts without words."""
        figures, makes, words = measure(texts)
        logit = self.bias + self.weights[_step_slots(figures)].sum(axis=1)
        logit = logit + 2 * np.bincount(np.repeat(np.arange(len(texts)), words), self.weights[makes], len(texts)) / np.maximum(words, 1)
        return np.where(words > 0, 1 / (1 + np.exp(-np.clip(logit, -30, 30))), 0.0)


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 1, PIECE):
            made = patterns_of(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int32())], names=["h", "pattern"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 1, PIECE):
            texts = batch.column(1).to_pylist()
            made = features(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(patterns_of(texts), pa.int32()), pa.array([list(m) for m in made], pa.list_(pa.int32())), pa.array([list(m.values()) for m in made], pa.list_(pa.float64()))], names=["h", "pattern", "slots", "parts"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[WeakModel, Scorer]:
    """The weak-label model over all documents, and the scorer that its posteriors train on the bounded sample."""
    keyed = docs.select(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("h"), F.col(text_col).cast("binary").alias("t"))
    voted = keyed.mapInArrow(tidied(_patterns), "h long, pattern int").where("pattern >= 0")
    table = voted.groupBy("pattern").agg(F.count("*").alias("n")).toPandas().sort_values("pattern")  # 3 ** labellers rows at most
    patterns = np.array([unpack(p) for p in table["pattern"]], dtype=np.int64).reshape(len(table), len(LABELLERS))
    model = WeakModel(patterns, table["n"].to_numpy())
    post = model.posterior(patterns)
    chance = dict(zip(table["pattern"].tolist(), post.tolist(), strict=True))
    total = int(table["n"].sum()) if len(table) else 0
    bad = sum(n for n, p in zip(table["n"], post, strict=True) if p >= 0.5)

    def bar(n: int) -> int:
        """The hash below which about `sample` of n rows lie."""
        return min((1 << 63) - 1, -(1 << 63) + int(min(1.0, sample / max(n, 1)) * (1 << 64)))

    junk = [p for p, c in chance.items() if c >= 0.5]
    in_sample = F.col("h") <= bar(total - bad)
    if junk:
        in_sample = F.when(F.col("pattern").isin(junk), F.col("h") <= bar(bad)).otherwise(in_sample)
    # a second look only at the texts that the sample can hold
    near = keyed.where(F.col("h") <= max(bar(total - bad), bar(bad)))
    chosen = near.mapInArrow(tidied(_sampled), "h long, pattern int, slots array<int>, parts array<double>").where(F.col("pattern") >= 0).where(in_sample)
    got = chosen.dropDuplicates(["h", "pattern"]).collect()  # about 2 * sample rows
    got.sort(key=lambda r: (r["h"], r["pattern"]))
    rows = [dict(zip(r["slots"], r["parts"], strict=True)) for r in got]
    scorer = Scorer.fit(rows, np.array([chance.get(r["pattern"], model.prior) for r in got]))
    return model, scorer


def score_documents(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """docs with quality_score, the chance that the text is fine."""
    held = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        own, rows, out, size = held.value, [], [], 0
        for t in texts:
            rows.append(bytes(t) if t is not None else None)
            size += len(rows[-1] or b"")
            if size > PIECE:
                out.append(own.score(rows))
                rows, size = [], 0
        if rows:
            out.append(own.score(rows))
        return pd.Series(np.concatenate(out) if out else np.empty(0), dtype=float)

    return docs.withColumn("quality_score", score(F.col(text_col).cast("binary")))


def classify(docs: DataFrame, threshold: float = 0.4, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, keep_empty: bool = False) -> DataFrame:
    """docs with quality_score and keep (boolean), replacing columns of these names."""
    model, scorer = fit(docs, id_col, text_col, sample)
    plain = docs.drop("quality_score", "keep")
    empty = F.trim(F.coalesce(F.col(text_col), F.lit(""))) == ""
    scored = score_documents(plain, scorer, text_col)
    return scored.withColumn("keep", F.when(empty, F.lit(keep_empty)).when(F.lit(model.rounds == 0), F.lit(True)).otherwise(F.col("quality_score") >= threshold))
