"""Quality classifier by positive-unlabelled learning.

A small network over text statistics and hashed word frequencies minimises the non-negative unbiased risk: with class prior
p, positives P and unlabelled U, risk = p * R_P(+1) + max(0, R_U(-1) - p * R_P(-1)). Trusted positives are training labels
of 1, the unlabelled set is web text whatever its label. The prior is estimated from those two sets alone: of a classifier
that tells P from U, the threshold above which U is thinnest against P bounds the share of positives in U.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_share, small_batches
from .ragged import LOWER, chunks, owner_of, release, text_bytes, word_hashes, word_spans

FEATURES = (
    "log_bytes", "upper", "lower", "digit", "blank", "newline", "bang", "stop", "mark", "beyond_ascii", "pipe", "symbol", "log_words", "word_length",
    "distinct_words", "top_word", "repeated_next", "distinct_pairs", "upper_words", "local_distinct", "log_lines", "repeated_lines", "line_length", "long_words",
)


#: Hashed words of which a text's frequencies are features.
BUCKETS = 256


def statistics(text: str | None) -> list[float]:
    """Statistics of the whole text; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / max(n, 1)
    words = raw.split()
    k = len(words)
    w = max(k, 1)
    pairs = len(set(zip(words, words[1:]))) if k > 1 else 0
    local = sum(len(set(words[i : i + 50])) for i in range(0, k, 50))
    lines = [x for x in raw.split(b"\n") if x]
    return [
        float(np.log1p(n)), c[65:91].sum(), c[97:123].sum(), c[48:58].sum(), c[32], c[10], c[33], c[46], c[44] + c[58] + c[59] + c[63], c[128:].sum(), c[124],
        c[35:44].sum() + c[47] + c[60:63].sum() + c[91:97].sum() + c[64] + c[123] + c[125], float(np.log1p(k)), (n - c[32] * n) / w / 10,
        len(set(words)) / w, max(Counter(words).values(), default=0) / w, sum(map(bytes.__eq__, words, words[1:])) / w, pairs / max(k - 1, 1),
        sum(map(bytes.isupper, words)) / w, local / w, float(np.log1p(len(lines))), 1 - len(set(lines)) / max(len(lines), 1), float(np.log1p(n / max(len(lines), 1))),
        sum(len(x) > 20 for x in words) / w,
    ]


def word_shares(texts: pa.Array) -> np.ndarray:
    """For each text, the root of the share of its words, A-Z lower-cased, in each bucket."""
    out = []
    for a, b in chunks(texts):
        data, off = text_bytes(texts.slice(a, b - a))
        start, stop, first = word_spans(data, off)
        bucket = (word_hashes(LOWER[data], start, stop) % np.uint64(BUCKETS)).astype(np.int64)
        seen = np.bincount(owner_of(first) * BUCKETS + bucket, minlength=(b - a) * BUCKETS).reshape(b - a, BUCKETS)
        out.append(np.sqrt(seen / np.maximum(np.diff(first), 1)[:, None]))
    return np.concatenate(out) if out else np.zeros((0, BUCKETS))


def features(texts: pa.Array) -> np.ndarray:
    """One row per text, of its whole text; null counts as empty."""
    own = np.array([statistics(t.as_py()) for t in texts]).reshape(len(texts), len(FEATURES))
    return np.concatenate([own, word_shares(texts)], 1).astype(np.float32)


def slopes(s: np.ndarray, b: int, prior: float, plain: bool = False) -> np.ndarray:
    """The slope of the risk in each output before the sigmoid; ``s`` has the scores of ``b`` positives, then of the unlabelled.
    Losses are logistic: l(+1) = -log s, l(-1) = -log(1 - s), with slopes s - 1 and s. Where the unlabelled part less the
    positives' is negative, it is over-fitted, and the step goes back from it alone. ``plain``: of telling the sets apart."""
    n, g = len(s) - b, np.zeros(len(s))
    minus = -np.log1p(-np.clip(s, 0, 1 - 1e-12))
    if plain:
        g[:b], g[b:] = (s[:b] - 1) / b, s[b:] / n
    elif minus[b:].mean() - prior * minus[:b].mean() >= 0:
        g[:b], g[b:] = prior * (s[:b] - 1) / b - prior * s[:b] / b, s[b:] / n
    else:
        g[:b], g[b:] = prior * s[:b] / b, -s[b:] / n
    return g


class Network:
    """One hidden layer with sigmoid output, trained on the non-negative risk."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.p = [rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]

    def _forward(self, x: np.ndarray):
        a = np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ self.p[0] + self.p[1])
        return a, a @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._forward(x)[1], -30, 30)))

    def fit(self, pos: np.ndarray, unl: np.ndarray, prior: float, epochs: int = 60, batch: int = 512, rate: float = 3e-3, decay: float = 3e-3, seed: int = 0, plain: bool = False) -> None:
        """``plain``: on the usual risk of telling ``pos`` from ``unl``."""
        rng, step = np.random.default_rng(seed), 0
        m, v = [np.zeros_like(x) for x in self.p], [np.zeros_like(x) for x in self.p]
        for _ in range(epochs):
            order = rng.permutation(len(unl))
            for i in range(0, len(order), batch):
                u = unl[order[i : i + batch]]
                x = np.concatenate([pos[rng.integers(0, len(pos), batch)], u])
                a, z = self._forward(x)
                s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                g = slopes(s, batch, prior, plain)
                h = np.outer(g, self.p[2]) * (1 - a * a)
                t = np.clip((x - self.mean) / self.scale, -6, 6)
                grads = [t.T @ h + decay * self.p[0], h.sum(0), a.T @ g + decay * self.p[2], np.array([g.sum()])]
                step += 1
                for j, d in enumerate(grads):
                    m[j] = 0.9 * m[j] + 0.1 * d
                    v[j] = 0.999 * v[j] + 0.001 * d * d
                    self.p[j] = self.p[j] - rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)


@F.arrow_udf(T.BinaryType())
def features_of(texts: pa.Array) -> pa.Array:
    return pa.array([x.tobytes() for i in range(0, len(texts), 500) for x in features(texts.slice(i, 500))], pa.binary())


def _matrix(rows: DataFrame) -> np.ndarray:
    """The features of ``rows`` (doc_id, text), a bounded number, in order of id, however the table is laid out."""
    found = rows.select("doc_id", features_of("text").alias("x")).collect()
    found.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0, r.x))
    return np.array([np.frombuffer(r.x, np.float32) for r in found], np.float64).reshape(len(found), -1)


def spread(x: np.ndarray) -> np.ndarray:
    """The scale of each feature. A single word says far less than a statistic, so the many words weigh less."""
    return (x.std(0) + 1e-3) * np.r_[np.ones(len(FEATURES)), np.full(x.shape[1] - len(FEATURES), 16.0)]


def estimated_prior(pos: np.ndarray, unl: np.ndarray, hidden: int, seed: int, epochs: int = 15) -> float:
    """The share of positives in ``unl``: a classifier is fitted to tell halves of the two sets apart, and of the other halves
    the least ratio of those above a threshold is taken, with a margin for small numbers in its choice."""
    a, b = (x[0::2] for x in (pos, unl))
    c, d = (x[1::2] if len(x) > 1 else x for x in (pos, unl))
    net = Network(b.mean(0), spread(b), hidden, seed)
    net.fit(a, b, 0.5, epochs=epochs, seed=seed, plain=True)
    p, u = np.sort(net.score(c)), np.sort(net.score(d))
    cuts = np.unique(p)
    above_p = 1 - np.searchsorted(p, cuts) / len(p)
    above_u = 1 - np.searchsorted(u, cuts) / len(u)
    margin = np.sqrt(np.log(40) / 2 / len(p)) + np.sqrt(np.log(40) / 2 / len(u))
    best = int(np.argmin((above_u + margin) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def train(docs: DataFrame, labels: DataFrame, labelled: Column, positives: int = 6000, unlabelled: int = 12000, hidden: int = 16, seed: int = 7) -> Network | None:
    """Fits on a bounded sample: about ``positives`` trusted positives and ``unlabelled`` web texts, drawn by a hash of the
    id. ``labelled`` says of which ids labels may be used (a condition on ``doc_id``); labels of 0 are not used. An id with
    conflicting labels is no trusted positive. Texts that are null or have a null id, and null labels, teach nothing; repeated
    rows are drawn together. Without positives or texts there is no model (None)."""
    usable = labels.filter(labelled & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = usable.groupBy("doc_id").agg(F.min("quality").alias("q"))
    good = known.filter("q = 1").count()
    if not good:
        return None
    n = docs.count()
    drawn = known.filter((F.col("q") == 1) & (hash_share(3, "doc_id") < min(1.0, positives / good))).select("doc_id")
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    p = _matrix(texts.join(F.broadcast(drawn), "doc_id", "left_semi"))  # at most about `positives` ids
    u = _matrix(texts.filter(hash_share(4, "doc_id") < min(1.0, unlabelled / max(n, 1))))
    if not len(p) or not len(u):
        return None
    prior = estimated_prior(p, u, hidden, seed)
    net = Network(u.mean(0), spread(u), hidden, seed)
    net.fit(p, u, prior, seed=seed)
    return net


def quality_score(docs: DataFrame, net: Network | None, text: Column) -> Column:
    """The score of every text in 0 to 1, from its whole text alone, however long; null counts as empty, and equal texts score
    alike. 0.5 for all if there is no model."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def judge(texts: pa.Array) -> pa.Array:
        if shared.value is None or not len(texts):
            return pa.array([0.5] * len(texts), pa.float64())
        found = pa.array(np.concatenate([shared.value.score(features(texts.slice(i, 500)).astype(np.float64)) for i in range(0, len(texts), 500)]), pa.float64())
        release()
        return found

    return judge(text)
