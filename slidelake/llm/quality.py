"""Operator 9: document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, table, text_runs
from .labelled import FOLDS, fold_of, logistic, sample_of, shares_of, sigmoid

MOST_EACH, RUN, THRESHOLD = 3000, 2_000_000, 0.3

#: Byte classes: 1 upper, 2 lower or part of a longer character, 3 digit, 4 space, 5 sentence mark, 6 other mark.
_CLASS = np.full(256, 6, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 1, 2, 2, 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 5
OWN = 10


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of every line of the texts, the lines' lengths in bytes, and the number of lines of each text.

    Lines are parted by newline bytes; an empty text is one empty line. All are counted by class over one buffer.
    """
    parts = [t.split(b"\n") for t in texts]
    n_lines = np.array([len(p) for p in parts], np.int64)
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.nonzero(raw == 10)[0]
    starts = np.concatenate([[0], ends[:-1] + 1])
    kind = _CLASS[raw]
    length = ends - starts

    def count(mask: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (run[ends] - run[starts]).astype(np.float64)

    upper, lower, digit, space, point, mark = (count(kind == k) for k in range(1, 7))
    begins = kind != 4
    begins[1:] &= kind[:-1] == 4
    words = count(begins)
    double = np.zeros(len(raw), bool)  # a mark right after a mark
    double[1:] = (kind[1:] == 6) & (kind[:-1] == 6)
    doubled = count(double)
    seen_before = np.concatenate([_repeats(p) for p in parts]) if parts else np.zeros(0)
    size, letters, some = np.maximum(length, 1), np.maximum(upper + lower, 1), np.maximum(words, 1)
    last = np.where(length > 0, kind[np.maximum(ends - 1, 0)], 0)
    own = np.stack([upper / letters, digit / size, mark / size, np.minimum(mark / some, 4) / 4, np.minimum(doubled / some, 4) / 4, point / some, np.minimum(letters / some, 20) / 20, np.log1p(words) / 6, seen_before, (last == 5).astype(float)], axis=1)
    return own, length.astype(np.float64), n_lines


def _repeats(lines: list[bytes]) -> np.ndarray:
    """1 for each line that stood in its text before."""
    if len(set(lines)) == len(lines):
        return np.zeros(len(lines))
    seen: set[bytes] = set()
    out = np.zeros(len(lines))
    for i, x in enumerate(lines):
        out[i] = x in seen and x != b""
        seen.add(x)
    return out


def with_neighbours(own: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Features of a line, of the line before and of the line after (zeros at a text's ends), and a constant."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    first = np.cumsum(n_lines) - n_lines
    before[first] = 0
    after[np.cumsum(n_lines) - 1] = 0
    return np.hstack([own, before, after, np.ones((len(own), 1))])


@dataclass
class Chain:
    """Two labels, 0 bad and 1 good. A line scores x.w for good; trans[a, b] scores label b after label a."""

    w: np.ndarray
    trans: np.ndarray

    def run(self, x: np.ndarray, n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of good by line, and the expected number of each pair of neighbouring labels over all texts.

        Forward-backward over all texts at once: texts go by falling length, so step t works on a head of them.
        """
        order = np.argsort(-n_lines, kind="stable")
        first = (np.cumsum(n_lines) - n_lines)[order]
        sizes = n_lines[order]
        live = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(int(sizes[0]) if len(sizes) else 0)]
        score = np.stack([np.zeros(len(x)), x @ self.w], axis=1)
        alpha, beta = np.empty_like(score), np.zeros_like(score)
        for t, k in enumerate(live):
            at = first[:k] + t
            if t == 0:
                alpha[at] = score[at]
            else:
                alpha[at] = score[at] + np.logaddexp.reduce(alpha[at - 1][:, :, None] + self.trans[None], axis=1)
        for t in range(len(live) - 2, -1, -1):
            at = first[: live[t + 1]] + t
            beta[at] = np.logaddexp.reduce(self.trans[None] + (score[at + 1] + beta[at + 1])[:, None, :], axis=2)
        both = alpha + beta
        total = np.logaddexp(both[:, 0], both[:, 1])
        good = np.exp(both[:, 1] - total)
        inner = np.ones(len(x), bool)
        inner[first] = False
        at = np.nonzero(inner)[0]
        pair = np.exp(alpha[at - 1][:, :, None] + self.trans[None] + (score[at] + beta[at])[:, None, :] - total[at][:, None, None])
        return good, pair.sum(axis=0)


def fit_chain(x: np.ndarray, n_lines: np.ndarray, y: np.ndarray, rounds: int = 120, relabel: int = 2, ridge: float = 1.0) -> Chain:
    """Maximum likelihood by Adam. Lines start with their document's label; then lines of bad documents that the field
    takes for good are labelled so (a bad document keeps at least its worst line), and the fit goes on."""
    label = np.repeat(y, n_lines).astype(float)
    doc = np.repeat(np.arange(len(y)), n_lines)
    first = np.cumsum(n_lines) - n_lines
    inner = np.ones(len(x), bool)
    inner[first] = False
    at = np.nonzero(inner)[0]
    chain = Chain(np.zeros(x.shape[1]), np.zeros((2, 2)))
    for again in range(relabel + 1):
        if again:
            good, _ = chain.run(x, n_lines)
            worst = np.full(len(y), 2.0)
            np.minimum.at(worst, doc, good)
            label = np.where(y[doc] == 1, 1.0, ((good > 0.5) & (good > worst[doc])).astype(float))
        held = np.zeros((2, 2))
        np.add.at(held, (label[at - 1].astype(int), label[at].astype(int)), 1)
        m, v = np.zeros(len(chain.w) + 4), np.zeros(len(chain.w) + 4)
        for k in range(1, rounds + 1):
            good, pair = chain.run(x, n_lines)
            g = np.concatenate([x.T @ (label - good) - ridge * chain.w, (held - pair).ravel() - ridge * chain.trans.ravel()]) / len(y)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
            chain.w, chain.trans = chain.w + step[:-4], chain.trans + step[-4:].reshape(2, 2)
    return chain


def quality_of(good: np.ndarray, length: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' marginals, by text."""
    first = np.cumsum(n_lines) - n_lines
    weight = np.maximum(length, 1.0)
    return np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first) if len(first) else np.zeros(0)


def logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


@dataclass
class QualityModel:
    chain: Chain
    a: float
    b: float

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """Probability of label 1; null counts as empty."""
        own, length, n_lines = line_features([t or b"" for t in texts])
        good, _ = self.chain.run(with_neighbours(own, n_lines), n_lines)
        return sigmoid(self.a * logit(quality_of(good, length, n_lines)) + self.b)

    def scores_in(self, column: pa.Array) -> np.ndarray:
        """Of a column of binaries, in runs of bounded size."""
        parts = [self.scores(texts) for _, texts in text_runs(column, RUN)]
        return np.concatenate(parts) if parts else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most_each: int = MOST_EACH) -> QualityModel:
    """The field and the map from mean marginal to probability, fitted to at most most_each documents of each label.

    Labels are cut to the learning fold first: nothing here sees a held-out one. Only line features come to the driver. The
    field is trained on one half of the sample (every other document by id), the other half fits the map, weighted back to
    the labels' own shares; a half without both labels gives way to the whole. Without labels of both kinds every score is
    the one label's smoothed share. Ids labelled twice count by their larger label; documents of equal id are all taken.
    """
    labels = fold_of(labels)
    rows = sample_of(docs, labels, label, most_each).select("doc_id", "y", F.col("text").cast("binary").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, length, n = [], [], []
            for t in b.column(2).to_pylist():
                o, s, k = line_features([t or b""])
                own.append(o.astype(np.float32).tobytes())
                length.append(s.astype(np.float32).tobytes())
                n.append(int(k[0]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.binary()), pa.array(length, pa.binary()), pa.array(n, pa.int64())], names=["doc_id", "y", "own", "length", "n"])

    got = sorted(rows.mapInArrow(features, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, y int, own binary, length binary, n long").collect(), key=lambda r: (r.doc_id, r.own))
    y = np.array([r.y for r in got], np.int64)
    if len(set(y.tolist())) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        return QualityModel(Chain(np.zeros(3 * OWN + 1), np.zeros((2, 2))), 0.0, float(np.log(p / (1 - p))))
    own = np.concatenate([np.frombuffer(r.own, np.float32).reshape(-1, OWN) for r in got]).astype(np.float64)
    length = np.concatenate([np.frombuffer(r.length, np.float32) for r in got]).astype(np.float64)
    n = np.array([r.n for r in got], np.int64)
    x = with_neighbours(own, n)
    half = np.zeros(len(y), bool)
    for v in (0, 1):
        half[np.nonzero(y == v)[0][::2]] = True
    if min((half & (y == 0)).sum(), (half & (y == 1)).sum(), (~half & (y == 0)).sum(), (~half & (y == 1)).sum()) < 10:
        half = np.ones(len(y), bool)
    line = np.repeat(half, n)
    chain = fit_chain(x[line], n[half], y[half])
    good, _ = chain.run(x, n)
    rest = ~half if not half.all() else half
    own, y = logit(quality_of(good, length, n))[rest], y[rest]
    shares = shares_of(labels, label)
    weight = np.where(y == 1, shares.get(1, 1) / (y == 1).sum(), shares.get(0, 1) / (y == 0).sum())
    weight *= len(y) / weight.sum()
    a, b = logistic(own[:, None], y, 1.0, weight)
    return QualityModel(chain, float(a), float(b))


def score_quality(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score): one row per input row.

    Null and empty texts are one empty line; ids pass through, null or repeated; equal texts have equal scores. An empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores_in(b.column(1)))], names=["doc_id", "score"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows scored below threshold, all columns as they are; texts are judged where they stand."""
    schema = docs.schema
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = model.scores_in(b.column(at).cast(pa.binary())) >= threshold
            yield b.filter(pa.array(good))

    return docs.mapInArrow(run, schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
