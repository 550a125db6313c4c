"""Operator 5: ordinal cumulative-link regression of graded ratings on hashed text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.llm.common import Hashes, batches, record, texts
from lectio.llm.features import byte_grams, sampled_texts, sigmoid, word_counts

#: Sizes of the word and of the byte n-gram features, and rated documents of each grade that the fit may take.
WORDS, BYTES, EACH = 4096, 2048, 1200


def vector(text: bytes | None, hashes: Hashes) -> np.ndarray:
    text = text or b""
    return np.concatenate([word_counts(hashes.of(text.lower().split()), WORDS), byte_grams(text, BYTES), [np.float32(np.log1p(len(text)) / 12)]])


class CumulativeLink:
    """P(grade >= k) = sigmoid(w·x - theta_k), one w for all grades, theta ascending (theta_1 and positive steps)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, reg: float = 1e-4, steps: int = 1500, rate: float = 0.05, seed: int = 0):
        self.grades = np.unique(y)
        level, k = np.searchsorted(self.grades, y), len(self.grades)
        weight = len(y) / (k * np.bincount(level, minlength=k))[level]
        rng, w = np.random.default_rng(seed), np.zeros(x.shape[1])
        step = np.zeros(max(0, k - 1))
        state = [np.zeros_like(v) for v in (w, w, step, step)]
        for t in range(1, steps + 1 if k > 1 else 1):
            i = rng.integers(0, len(y), min(256, len(y)))
            theta = self._theta(step)
            p = sigmoid((x[i] @ w)[:, None] - theta)
            # likelihood of a level is the difference of neighbouring tails
            tails = np.hstack([np.ones((len(i), 1)), p, np.zeros((len(i), 1))])
            like = np.maximum(tails[np.arange(len(i)), level[i]] - tails[np.arange(len(i)), level[i] + 1], 1e-9)
            d = p * (1 - p)
            up, low = np.zeros_like(d), np.zeros_like(d)
            has, lacks = level[i] > 0, level[i] < k - 1
            up[has, level[i][has] - 1] = 1
            low[lacks, level[i][lacks]] = 1
            g = -(weight[i] / like)[:, None] * d * (up - low)  # by the score minus each theta
            gw = x[i].T.astype(float) @ g.sum(1) / len(i) + reg * w
            gt = -g.sum(0) / len(i)
            gs = np.r_[gt.sum(), [gt[j:].sum() * np.exp(step[j]) for j in range(1, k - 1)]]
            for v, grad, m, s in ((w, gw, state[0], state[1]), (step, gs, state[2], state[3])):
                m[:] = 0.9 * m + 0.1 * grad
                s[:] = 0.999 * s + 0.001 * grad * grad
                v -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        self.w, self.theta = w, self._theta(step)

    @staticmethod
    def _theta(step: np.ndarray) -> np.ndarray:
        return step[:1].sum() + np.r_[0.0, np.cumsum(np.exp(step[1:]))] if len(step) else step

    def tails(self, x: np.ndarray) -> np.ndarray:
        return sigmoid((x @ self.w)[:, None] - self.theta)

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(self.grades.astype(float))


def fit(docs: DataFrame, ratings: DataFrame, each: int = EACH) -> CumulativeLink | None:
    """ratings: (doc_id, grade). Fitted on whole texts of a sample of at most `each` rows a grade; None without any."""
    schema = pa.schema([("grade", pa.int64()), ("x", pa.binary())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches(rows, 500):
            yield record(schema, b.column(1), [vector(t, hashes).astype(np.float16).tobytes() for t in b.column(0).to_pylist()])

    rows = sampled_texts(docs, ratings, "grade", each)
    got = rows.select("text", F.col("grade").cast("long").alias("grade")).mapInArrow(run, "grade long, x binary").collect()
    got.sort(key=lambda r: (r.grade, bytes(r.x)))
    return CumulativeLink(np.stack([np.frombuffer(r.x, np.float16) for r in got]).astype(np.float32), np.asarray([r.grade for r in got])) if got else None


def grade(docs: DataFrame, model: CumulativeLink | None, at_least: int | None = None, chance: float = 0.5) -> DataFrame:
    """(doc_id, expected_grade, tails, tail_probability, selected): tails[k] is P(grade >= grades[k + 1]).

    selected: tail_probability = P(grade >= at_least), by default of the lowest grade but one, is `chance` or more.
    Null and empty texts are graded as the empty text. Without a model the grade is null and nothing is selected.
    Each row of a repeated doc_id is judged by itself; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("tails", pa.list_(pa.float64())), ("tail_probability", pa.float64()), ("selected", pa.bool_())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, m = Hashes(), shared.value
        for b in batches(rows, 500):
            if m is None:
                yield record(schema, b.column(0), *([None] * b.num_rows for _ in range(3)), [False] * b.num_rows)
                continue
            tails = m.tails(np.stack([vector(t, hashes) for t in b.column(1).to_pylist()]))
            k = 0 if at_least is None else int(np.searchsorted(m.grades, at_least)) - 1
            tail = np.ones(len(tails)) if k < 0 or not tails.shape[1] else tails[:, k] if k < tails.shape[1] else np.zeros(len(tails))
            yield record(schema, b.column(0), m.expected(tails), list(tails), tail, tail >= chance)

    return texts(docs).mapInArrow(run, "doc_id long, expected_grade double, tails array<double>, tail_probability double, selected boolean")
