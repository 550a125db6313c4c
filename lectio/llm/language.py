"""Operator 3: hierarchical language identification, families first and one-versus-one support vector machines within."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.llm.common import batches, record, texts
from lectio.llm.features import byte_grams, sampled_texts, sigmoid

# Closely related written languages by ISO 639-1 code. A code in none of them is a family by itself.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "baltic": ["lt", "lv"],
    "celtic": ["br", "cy", "ga", "gd"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indic": ["bn", "hi", "mr", "ne", "pa", "ur"],
    "semitic": ["ar", "he", "mt"],
}
#: Size of the features, and documents of each language that the fit may take.
SIZE, EACH = 2048, 800


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes), lang)


def svm(x: np.ndarray, y: np.ndarray, reg: float = 1e-4, epochs: int = 30, seed: int = 0) -> np.ndarray:
    """Linear support vector machine by averaged subgradient steps, classes weighted alike; a last pair of weights maps margins to probabilities."""
    rng, n = np.random.default_rng(seed), len(x)
    w, mean, t = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), 0
    weight = np.where(y > 0, n / max(1, 2 * (y > 0).sum()), n / max(1, 2 * (y < 0).sum()))
    xb = np.hstack([x, np.ones((n, 1), x.dtype)])
    for _ in range(epochs):
        for i in np.array_split(rng.permutation(n), max(1, n // 64)):
            t += 1
            bad = (y[i] * (xb[i] @ w) < 1) * weight[i] * y[i]
            w = w * (1 - 1 / (t + 10)) + (bad @ xb[i]) / (len(i) * reg * (t + 10) * 1000)
            mean += w
    w = mean / t
    m, a = xb @ w, np.array([1.0, 0.0])
    target = np.where(y > 0, 1 - 1 / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    for _ in range(50):  # Platt's two parameters by Newton steps
        p = sigmoid(a[0] * m + a[1])
        g = np.array([((p - target) * m).sum(), (p - target).sum()]) + 1e-3 * a
        h = p * (1 - p)
        a -= np.linalg.solve(np.array([[(h * m * m).sum(), (h * m).sum()], [(h * m).sum(), h.sum()]]) + 1e-3 * np.eye(2), g)
    return np.r_[w, a]


class Hierarchy:
    """Family machines (one against the rest), and within each family a machine for every pair of languages."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        names, of = np.asarray(langs), np.asarray([family(k) for k in langs])
        self.families = sorted(set(of))
        self.inside = {f: sorted(set(names[of == f])) for f in self.families}
        self.roots = [svm(x, np.where(of == f, 1.0, -1.0)) for f in self.families] if len(self.families) > 1 else []
        self.pairs = {}
        for f, ls in self.inside.items():
            for a, b in combinations(ls, 2):
                i = np.flatnonzero((names == a) | (names == b))
                self.pairs[a, b] = svm(x[i], np.where(names[i] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        def p(w):
            return sigmoid((x @ w[:-3] + w[-3]) * w[-2] + w[-1])

        root = np.stack([p(w) for w in self.roots], 1) if self.roots else np.ones((len(x), 1))
        pick, lang, score = root.argmax(1), np.empty(len(x), object), np.zeros(len(x))
        for k, f in enumerate(self.families):
            ls = self.inside[f]
            votes, chance = np.zeros((len(x), len(ls))), np.ones((len(x), len(ls)))
            for i, j in combinations(range(len(ls)), 2):
                q = p(self.pairs[ls[i], ls[j]])
                votes[:, i] += (q >= 0.5) + q * 1e-3
                votes[:, j] += (q < 0.5) + (1 - q) * 1e-3
                chance[:, i], chance[:, j] = np.minimum(chance[:, i], q), np.minimum(chance[:, j], 1 - q)
            best, here = votes.argmax(1), pick == k
            lang[here] = np.asarray(ls, object)[best[here]]
            score[here] = (root[:, k] * chance[np.arange(len(x)), best])[here]
        return list(lang), score


def fit(docs: DataFrame, each: int = EACH, size: int = SIZE) -> Hierarchy | None:
    """Fitted on whole texts of a sample of at most `each` documents a language and features.MOST in all; no language of a
    row is left out while there are at most as many. Only the sample's ids, which are bounded, go to the texts, which
    become features where they lie. Of rows that repeat a doc_id the smallest text and lang count; rows of a null doc_id
    teach nothing. None when no row has doc_id, text and lang.
    """
    schema = pa.schema([("lang", pa.string()), ("x", pa.binary())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            yield record(schema, b.column(1), [byte_grams(t, size).astype(np.float32).tobytes() for t in b.column(0).to_pylist()])

    known = docs.where("text is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    got = sampled_texts(known, known, "lang", each).select("text", "lang").mapInArrow(run, "lang string, x binary").collect()
    got.sort(key=lambda r: (r.lang, bytes(r.x)))
    return Hierarchy(np.stack([np.frombuffer(r.x, np.float32) for r in got]), [r.lang for r in got]) if got else None


def identify(docs: DataFrame, model: Hierarchy | None, size: int = SIZE) -> DataFrame:
    """(doc_id, lang_pred, score, tag) of every whole text; `und` with score 0 if it is null, has no letter, or nothing could be fitted.

    A letter is what Unicode calls one (str.isalpha); digits, fractions and Roman numeral signs aren't. Only the text
    enters a prediction. Each row of a repeated or null doc_id is judged by itself; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("tag", pa.int64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows, 500):
            raw = b.column(1).to_pylist()
            if shared.value is None:
                langs, scores = ["und"] * len(raw), [0.0] * len(raw)
            else:
                langs, scores = shared.value.predict(np.stack([byte_grams(t or b"", size) for t in raw]))
            known = [bool(t) and any(map(str.isalpha, t.decode("utf-8", "replace"))) for t in raw]
            yield record(schema, b.column(0), [k if ok else "und" for k, ok in zip(langs, known, strict=True)], [float(s) if ok else 0.0 for s, ok in zip(scores, known, strict=True)], b.column(2))

    return texts(docs, F.crc32(F.col("text").cast("binary")).alias("tag")).mapInArrow(run, "doc_id long, lang_pred string, score double, tag long")
