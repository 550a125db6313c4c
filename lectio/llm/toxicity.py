"""Operator 8: toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from lectio.llm.common import CACHE_ENTRIES, batches, record, texts
from lectio.llm.features import sampled_texts, sigmoid

#: Words of a window and from one window's start to the next; labelled documents of each class that the fit may take.
WINDOW, STRIDE, EACH = 48, 32, 1200
#: Bytes of a labelled text that the fit may take.
MOST_BYTES = 1 << 16
#: Passes over the sample, more where that makes fewer than so many updates.
EPOCHS, UPDATES = 12, 400
#: Hash bits of the word and the character inputs, width of an input, units in each direction.
WORD_BITS, CHAR_BITS, WIDTH, UNITS = 18, 18, 16, 12
#: Lengths of character n-grams; inputs met in fewer documents of the fit stay zero, as unseen ones are.
GRAMS, LEAST_DOCS = (4, 5), 4
PUNCTUATION = b".,;:!?|%*&$#\"'()[]{}<>-_"


def word_list(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def inputs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its hashed index; and all words' hashed character n-grams, with the word that each belongs to."""
    bare = [w.strip(PUNCTUATION) or w for w in words]
    ids = np.fromiter((xxhash.xxh32_intdigest(w) >> (32 - WORD_BITS) for w in bare), np.int64, len(bare))
    a = np.frombuffer(b"".join(b"^" + w + b"$" for w in bare), np.uint8).astype(np.uint32)
    sizes = np.fromiter((len(w) + 2 for w in bare), np.int64, len(bare))
    owner = np.repeat(np.arange(len(bare)), sizes)
    ends = np.cumsum(sizes)
    found, owners = [], []
    for n in GRAMS:
        if len(a) < n:
            continue
        at = np.flatnonzero(np.arange(len(a)) + n <= ends[owner])
        h = np.full(len(at), n, np.uint32)
        for j in range(n):
            h = (h ^ a[at + j]) * np.uint32(0x01000193) + np.uint32(j)
        found.append(((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - CHAR_BITS)).astype(np.int64))
        owners.append(owner[at])
    if not found:
        return ids, np.zeros(0, np.int64), np.zeros(0, np.int64)
    g, o = np.concatenate(found), np.concatenate(owners)
    by = np.argsort(o, kind="stable")
    return ids, g[by], o[by]


def windows(n: int, size: int = WINDOW, stride: int = STRIDE) -> np.ndarray:
    """Starts of the overlapping windows that cover n words; one empty window for none."""
    return np.arange(0, max(1, n - (size - stride)), stride)


def _recur(pre, mask, u, back: bool, keep: bool):
    """Hidden states of one direction. pre(t) gives a step's input terms of the three gates."""
    b, t_all, k = len(mask), mask.shape[1], u.shape[0]
    h, out, held = np.zeros((b, k), np.float32), np.zeros((t_all, b, k), np.float32), []
    for t in range(t_all - 1, -1, -1) if back else range(t_all):
        x, hu = pre(t), h @ u
        rz = np.float32(0.5) * np.tanh(np.float32(0.5) * (x[:, : 2 * k] + hu[:, : 2 * k])) + np.float32(0.5)
        r, z = rz[:, :k], rz[:, k:]
        n = np.tanh(x[:, 2 * k :] + r * hu[:, 2 * k :])
        m = mask[:, t, None]
        new = h + m * (1 - z) * (n - h)
        if keep:
            held.append((t, h, r, z, n, hu[:, 2 * k :]))
        h = out[t] = new
    return out, held


def _recur_grad(dout, held, mask, u, shape):
    """Gradients of the input terms and of u."""
    k, du, dpre, dh = u.shape[0], np.zeros_like(u), np.zeros(shape, np.float32), 0.0
    for t, h, r, z, n, hn in reversed(held):
        d = dout[t] + dh
        m = mask[:, t, None]
        dn = d * m * (1 - z) * (1 - n * n)
        dz = d * m * (h - n) * z * (1 - z)
        dr = dn * hn * r * (1 - r)
        g = np.hstack([dr, dz, dn])
        dpre[:, t] = g
        gu = np.hstack([dr, dz, dn * r])
        du += h.T @ gu
        dh = d * (1 - m * (1 - z)) + gu @ u.T
    return dpre, du


class Network:
    """Word inputs (a hashed word vector plus hashed character n-gram vectors) → both directions → attention → logit."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        r = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"x": r(WIDTH, 6 * UNITS), "bx": np.zeros(6 * UNITS, np.float32), "uf": r(UNITS, 3 * UNITS), "ub": r(UNITS, 3 * UNITS), "v": r(2 * UNITS), "o": r(2 * UNITS), "c": np.zeros(1, np.float32)}
        self.words = (0.05 * rng.standard_normal((1 << WORD_BITS, WIDTH))).astype(np.float32)
        self.chars = (0.05 * rng.standard_normal((1 << CHAR_BITS, WIDTH))).astype(np.float32)

    def vectors(self, ids, grams, owner) -> tuple[np.ndarray, np.ndarray]:
        """Input vectors of words, and the weight of each n-gram in its word's."""
        x, many = self.words[ids], np.bincount(owner, minlength=len(ids))
        scale, starts = (1 / np.sqrt(np.maximum(many, 1))).astype(np.float32), np.cumsum(many) - many
        for i in range(0, len(ids), 8192):  # what is gathered for n-grams is many times the words
            some = i + np.flatnonzero(many[i : i + 8192])
            if len(some):
                a, b = starts[some[0]], starts[some[-1]] + many[some[-1]]
                x[some] += np.add.reduceat(self.chars[grams[a:b]], starts[some] - a, axis=0) * scale[some, None]
        return x, scale

    def run(self, table: np.ndarray, idx: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows idx (rows of table: the input terms of a word for both directions)."""
        p, g = self.p, 3 * UNITS
        hf, kf = _recur(lambda t: table[idx[:, t], :g], mask, p["uf"], False, keep)
        hb, kb = _recur(lambda t: table[idx[:, t], g:], mask, p["ub"], True, keep)
        h = np.concatenate([hf, hb], 2)
        e = np.exp(np.clip(h @ p["v"], -20, 20)) * mask.T
        a = e / np.maximum(e.sum(0), 1e-9)
        pool = np.einsum("tb,tbk->bk", a, h)
        logit = pool @ p["o"] + p["c"]
        return (logit, h, a, pool, kf, kb) if keep else logit

    def grads(self, x: np.ndarray, idx, mask, y, weight):
        """Gradients by parameters and by the input vectors x."""
        p, table = self.p, x @ self.p["x"] + self.p["bx"]
        logit, h, a, pool, kf, kb = self.run(table, idx, mask, True)
        d = ((sigmoid(logit) - y) * weight / len(y)).astype(np.float32)
        dpool = d[:, None] * p["o"]
        da = np.einsum("bk,tbk->tb", dpool, h)
        de = a * (da - (a * da).sum(0))
        dh = a[:, :, None] * dpool + de[:, :, None] * p["v"]
        shape = (*mask.shape, 3 * UNITS)
        pf, duf = _recur_grad(dh[:, :, :UNITS], kf, mask, p["uf"], shape)
        pb, dub = _recur_grad(dh[:, :, UNITS:], kb, mask, p["ub"], shape)
        dpre = np.concatenate([pf, pb], 2).reshape(-1, 6 * UNITS)
        dtable = np.zeros_like(table)
        np.add.at(dtable, idx.ravel(), dpre)
        return {"x": x.T @ dtable, "bx": dtable.sum(0), "uf": duf, "ub": dub, "v": np.einsum("tb,tbk->k", de, h), "o": pool.T @ d, "c": d.sum(keepdims=True)}, dtable @ p["x"].T


def train(labelled: list[tuple[bytes, int]], epochs: int = EPOCHS, batch: int = 96, seed: int = 0) -> Network | None:
    """Each document is its highest-scoring window. Input vectors start from log odds of their presence in the two classes."""
    y = np.asarray([k for _, k in labelled], np.float32)
    if not len(y) or y.min() == y.max():
        return None
    net, rng, index = Network(seed), np.random.default_rng(seed), {}
    docs = [np.asarray([index.setdefault(w, len(index) + 1) for w in word_list(t)] or [0], np.int64) for t, _ in labelled]
    ids, grams, owner = inputs(list(index))
    cut = np.searchsorted(owner, np.arange(len(ids) + 1))
    live: list[np.ndarray] = []
    pos, n_pos, n_neg = y > 0, (y > 0).sum(), (y == 0).sum()
    for table, of in ((net.words, lambda u: ids[u]), (net.chars, lambda u: np.concatenate([grams[cut[k] : cut[k + 1]] for k in u] or [grams[:0]]))):
        seen = np.zeros((2, len(table)))
        for d, k in zip(docs, pos, strict=True):
            u = np.unique(d) - 1
            seen[int(k), np.unique(of(u[u >= 0]))] += 1
        odds = np.log((seen[1] + 0.5) / (n_pos + 1)) - np.log((seen[0] + 0.5) / (n_neg + 1))
        table[:, 0] += np.clip(odds, -1, 4)
        live.append((seen.sum(0) >= LEAST_DOCS).astype(np.float32))
        table *= live[-1][:, None]
    net.p["x"][0] *= 2
    rows, of = [], []
    for k, d in enumerate(docs):
        padded = np.r_[d, np.zeros(WINDOW, np.int64)]
        for s in windows(len(d)):
            rows.append(padded[s : s + WINDOW] if s + WINDOW <= len(d) else np.r_[d[s:], np.zeros(WINDOW, np.int64)][:WINDOW])
            of.append(k)
    rows.append(np.zeros(WINDOW, np.int64))
    idx, of = np.stack(rows), np.asarray(of)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    squares, t = [np.full(net.words.shape[0], 1e-2, np.float32), np.full(net.chars.shape[0], 1e-2, np.float32)], 0
    epochs = max(epochs, -(-UPDATES * batch // (2 * len(docs))))
    for epoch in range(epochs):
        pace = np.float32(1 if 2 * epoch < epochs else 0.3 if 4 * epoch < 3 * epochs else 0.1)
        x, _ = net.vectors(ids, grams, owner)
        table = np.vstack([np.zeros((1, WIDTH), np.float32), x]) @ net.p["x"] + net.p["bx"]
        logit = np.concatenate([net.run(table, idx[i : i + 2048], (idx[i : i + 2048] > 0).astype(np.float32)) for i in range(0, len(of), 2048)])[: len(of)]
        by = np.lexsort((-logit, of))
        top = by[np.searchsorted(of[by], np.arange(len(docs)))]
        clean = np.flatnonzero(y[of] == 0)
        chosen = np.r_[top, rng.choice(clean, min(len(clean), len(docs) // 2), replace=False), np.full(1 + len(docs) // 50, len(of))]
        for i in np.array_split(rng.permutation(chosen), max(1, len(chosen) // batch)):
            t += 1
            target = np.where(i < len(of), y[of[np.minimum(i, len(of) - 1)]], 0).astype(np.float32)
            used, local = np.unique(idx[i], return_inverse=True)
            local = local.reshape(len(i), WINDOW)
            u = used[used > 0] - 1
            each = cut[u + 1] - cut[u]
            flat = np.repeat(cut[u] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            sub_owner = np.repeat(np.arange(len(u)), each)
            x, scale = net.vectors(ids[u], grams[flat], sub_owner)
            if used[0] == 0:
                x = np.vstack([np.zeros((1, WIDTH), np.float32), x])
            g, dx = net.grads(x, local, (idx[i] > 0).astype(np.float32), target, np.float32(1))
            dx = dx[1:] if used[0] == 0 else dx
            for k, v in g.items():
                m, s = moments[k]
                v = np.clip(v, -1, 1).astype(np.float32)
                m += np.float32(0.1) * (v - m)
                s += np.float32(0.01) * (v * v - s)
                net.p[k] -= pace * np.float32(0.01) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-6)
            for emb, sq, on, at, d in ((net.words, squares[0], live[0], ids[u], dx), (net.chars, squares[1], live[1], grams[flat], (dx * scale[:, None])[sub_owner])):
                rows_at, inv = np.unique(at, return_inverse=True)
                total = np.zeros((len(rows_at), WIDTH), np.float32)
                np.add.at(total, inv, d)
                sq[rows_at] += (total * total).mean(1)
                emb[rows_at] -= pace * np.float32(0.05) * on[rows_at, None] * total / np.sqrt(sq[rows_at])[:, None]
    return net


class _Index(dict):
    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self) + 1
        self.new.append(word)
        return i


class Scorer:
    """Scores texts, with a bounded table of the input terms of words met before."""

    def __init__(self, net: Network):
        self.net = net
        self.start()

    def start(self) -> None:
        self.index, self.table = _Index(), self.net.p["bx"][None].copy()

    def __call__(self, raw: list[bytes | None]) -> np.ndarray:
        if len(self.index) > CACHE_ENTRIES // 2:
            self.start()
        docs = [np.fromiter(map(self.index.__getitem__, w), np.int64, len(w)) for w in map(word_list, raw)]
        if self.index.new:
            x, _ = self.net.vectors(*inputs(self.index.new))
            self.table, self.index.new = np.vstack([self.table, x @ self.net.p["x"] + self.net.p["bx"]]), []
        starts = [windows(len(d)) for d in docs]
        base = np.cumsum([0, *(len(d) for d in docs[:-1])])
        every = np.concatenate([*docs, np.zeros(WINDOW, np.int64)])
        first = np.concatenate([s + b for s, b in zip(starts, base, strict=True)])
        end = np.repeat(base + [len(d) for d in docs], [len(s) for s in starts])
        logit = []
        for i in range(0, len(first), 2048):
            at = first[i : i + 2048, None] + np.arange(WINDOW)
            mask = at < end[i : i + 2048, None]
            logit.append(self.net.run(self.table, np.where(mask, every[np.minimum(at, len(every) - 1)], 0), mask.astype(np.float32)))
        cuts = np.cumsum([0, *(len(s) for s in starts[:-1])])
        return sigmoid(np.maximum.reduceat(np.concatenate(logit).astype(float), cuts))


def fit(docs: DataFrame, labels: DataFrame, each: int = EACH, epochs: int = EPOCHS, most_bytes: int = MOST_BYTES) -> Network | None:
    """labels: (doc_id, label 0 or 1). Fitted on whole texts of at most `each` documents a label, none longer than most_bytes.

    So the driver holds at most 2 * each * most_bytes of text. None if a label is missing from what is left; rows of a
    null doc_id or label don't count.
    """
    got = sorted((bytes(r.text), int(r.label)) for r in sampled_texts(docs, labels, "label", each, most_bytes=most_bytes).collect())
    net = train(got, epochs)
    if net:  # the sample holds the labels in other shares than the corpus does
        every = {int(r.label): r["count"] for r in labels.where("label is not null").groupBy("label").count().collect()}
        taken = sum(y for _, y in got)
        net.p["c"] += np.float32(np.log(every[1] / every[0]) - np.log(taken / (len(got) - taken)))
    return net


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, score): the highest probability of any window of the whole text; windows overlap by WINDOW - STRIDE words.

    Null and empty texts score as a window without words; without a network every score is 0. Only the text enters.
    Each row of a repeated or null doc_id is scored by itself; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for b in batches(rows, 200):
            raw = b.column(1).to_pylist()
            yield record(schema, b.column(0), scorer(raw) if scorer else [0.0] * len(raw))

    return texts(docs).mapInArrow(run, "doc_id long, score double")
