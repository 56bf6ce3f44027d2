"""Quality classifier by co-training of a text view and a metadata view.

Views.  The text view is what a document says and how: shares of its words (A-Z lower-cased)
in ``BINS`` hash bins, and figures of its bytes and words (byte classes, repetition,
line shapes).  The metadata view is source, language and both together, each as the
logarithm of the good-to-bad odds that labelled rows give it; nothing of it comes from
the text.

Training.  A bounded sample, at most about ``SAMPLE`` labelled documents and ``SAMPLE``
unlabelled ones chosen by a hash of doc_id, comes to the driver as figures, not texts.
A tenth of the labelled ones stays out.  In each of ``ROUNDS`` rounds both views fit a
logistic regression, and each hands the other its most confident unlabelled documents as
pseudo-labels, ``GIVE`` of the pool at most for each class.  It is confident of a class
beyond the log-odds from which on it is right about ``SURE`` of the documents kept out,
``PROOF`` of them at least; a view that tells nothing hands over nothing.  Each view
is then calibrated on the rows kept out (Platt), and the calibrated log-odds are added,
weighted by what each view can tell on those rows.  Every document is scored by the
broadcast coefficients, whose number is fixed by BINS and the bounded table of metadata values.

Cases.  Null or empty text has the figures of an empty text; very long texts are read whole;
unknown or null metadata weighs nothing; a document with several labels is good if most are;
labels without an id are left out; without labels of both classes every document gets
score 0.5 and stays; equal rows stay; other columns are ignored, and keep_good keeps them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, arrow, text_column, word_hashes, word_slabs

SAMPLE, BINS, ROUNDS, GIVE, SURE, PROOF, KEEP = 8000, 256, 4, 0.05, 0.95, 5, 0.5
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t", "line": b"\n", "stop": b".,;:", "loud": b"!?", "symbol": b"#*$%&@^~", "bar": b"|_=+/\\", "bracket": b"<>[]{}()", "quote": b"\"'`-",
}
SHAPES = len(_CLASSES) + 11
TEXT = SHAPES + BINS


def _class_matrix() -> np.ndarray:
    out = np.zeros((256, len(_CLASSES) + 1))
    for k, chars in enumerate(_CLASSES.values()):
        out[list(chars), k] = 1
    out[128:, len(_CLASSES)] = 1
    return out


_MATRIX = _class_matrix()


def text_shapes(raw: bytes) -> np.ndarray:
    n = len(raw)
    out = np.zeros(SHAPES)
    if not n:
        return out
    k = len(_CLASSES) + 1
    out[:k] = np.sqrt(np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _MATRIX / n)
    words = raw.split()
    if words:
        distinct = len(set(words))
        out[k] = np.log1p(len(words)) / 10
        out[k + 1] = distinct / len(words)
        # distinct words fall behind as texts grow; set against the square root of their number
        out[k + 2] = np.log((distinct + 1) / np.sqrt(len(words) + 1)) / 4
        out[k + 3] = np.log1p(sum(map(len, words)) / len(words)) / 4
        out[k + 4] = sum(map(bytes.__eq__, words, words[1:])) / len(words)
        out[k + 5] = sum(w.isupper() for w in words) / len(words)
        out[k + 6] = max(map(len, words)) > 60
        out[k + 7] = sum(w[-1:] in b"#*$%&!" for w in words) / len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    if lines:
        out[k + 8] = 1 - len(set(lines)) / len(lines)
        out[k + 9] = np.log1p(n / len(lines)) / 10
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Logistic:
    """Ridge logistic regression on standardised figures, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        z = self._design(x)
        w = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        self.beta = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(25):
            p = _sigmoid(z @ self.beta)
            step = np.linalg.solve((z * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty), z.T @ (w * (y - p)) - penalty * self.beta)
            self.beta += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-4:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._design(x) @ self.beta, -30, 30)


def _platt(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make the log-odds fit the rows kept out; targets are smoothed, rows count as they come."""
    target = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    z, beta = np.stack([odds, np.ones(len(odds))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(z @ beta)
        step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (target - p) - 1e-3 * (beta - [1.0, 0.0]))
        beta = beta + np.clip(step, -2, 2)
    return max(float(beta[0]), 0.0), float(beta[1])


def _auc(odds: np.ndarray, y: np.ndarray) -> float:

    _, inverse, n = np.unique(odds, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[inverse]
    good = y > 0.5

    return float((rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / max(good.sum() * (~good).sum(), 1))


def _sure(odds: np.ndarray, y: np.ndarray, pool: np.ndarray, most: int) -> np.ndarray:
    """Places of the pool, ``most`` at most, where the odds are beyond those from which on ``SURE`` of the rows y are good."""
    order = np.argsort(-odds, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(odds[order][1:] != odds[order][:-1], True)  # equal odds stand or fall together
    good = np.flatnonzero((right >= SURE) & last & (np.arange(1, len(y) + 1) >= PROOF))
    if not len(good):
        return good
    best = np.argsort(-pool, kind="stable")[:most]
    return best[pool[best] >= odds[order][good[-1]]]


class Model:
    def __init__(self, text: np.ndarray, meta: list[tuple], label: np.ndarray, rounds: int = ROUNDS):
        """label: 1, 0 or nan for unlabelled rows, which stand in a fixed order."""
        known = np.flatnonzero(~np.isnan(label))
        self.flat = len(np.unique(label[known])) < 2
        if self.flat:
            return
        out = known[::10] if len(np.unique(label[known[::10]])) == 2 else known
        fit = np.setdiff1d(known, known[::10]) if len(out) < len(known) else known
        self.tables = []
        y = label[fit]
        for k in range(len(META)):
            sums: dict = {}
            for i, v in zip(fit.tolist(), y.tolist()):
                good, n = sums.get(meta[i][k], (0.0, 0))
                sums[meta[i][k]] = (good + v, n + 1)
            base = y.mean()
            self.tables.append({v: float(np.log((g + 10 * base) / (n - g + 10 * (1 - base))) - np.log(base / (1 - base))) for v, (g, n) in sums.items() if v is not None})
        views = [text, self.meta_figures(meta)]
        pool = np.flatnonzero(np.isnan(label))
        rows = [fit, fit]
        ys = [y, y]
        self.given = [0, 0]
        for turn in range(rounds + 1):
            self.fits = [Logistic(views[v][rows[v]], ys[v]) for v in (0, 1)]
            if turn == rounds or not len(pool):
                break
            taken = np.zeros(len(pool), bool)
            for v in (0, 1):
                told, asked = self.fits[v].odds(views[v][out]), self.fits[v].odds(views[v][pool])
                for side, truth in ((1, label[out]), (-1, 1 - label[out])):
                    best = _sure(side * told, truth, np.where(taken, -np.inf, side * asked), int(GIVE * len(pool)) + 1)
                    taken[best] = True
                    self.given[v] += len(best)
                    rows[1 - v] = np.concatenate([rows[1 - v], pool[best]])
                    ys[1 - v] = np.concatenate([ys[1 - v], np.full(len(best), float(side > 0))])
            pool = pool[~taken]
            if not taken.any():
                break
        odds = [self.fits[v].odds(views[v][out]) for v in (0, 1)]
        self.platt = [_platt(o, label[out]) for o in odds]
        tells = np.array([max(2 * _auc(o, label[out]) - 1, 0.0) for o in odds]) + 1e-6
        self.weight = tells / tells.max()
        self.base = float(np.log(label[known].mean() / (1 - label[known].mean())))

    def meta_figures(self, meta: list[tuple]) -> np.ndarray:
        return np.array([[t.get(m[k], 0.0) for k, t in enumerate(self.tables)] for m in meta]).reshape(-1, len(META))

    def scores(self, text: np.ndarray, meta: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability of each view and of both."""
        if self.flat or not len(text):
            return (np.full(len(text), 0.5),) * 3
        a, b = (s * f.odds(x) + o for f, x, (s, o) in zip(self.fits, (text, self.meta_figures(meta)), self.platt))
        # each calibrated view holds the base odds once
        both = self.base + self.weight[0] * (a - self.base) + self.weight[1] * (b - self.base)
        return _sigmoid(a), _sigmoid(b), _sigmoid(both)


#: What the metadata view looks at.
META = ("source", "lang", "both")


def text_figures(batch) -> np.ndarray:
    """Figures of the texts of a batch: shapes, and the square roots of the shares of their words in each bin."""
    out = np.zeros((batch.num_rows, TEXT), np.float32)
    offsets, data = text_column(batch.column("text"))
    view = memoryview(data)
    for k, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        out[k, :SHAPES] = text_shapes(bytes(view[s:e]))
    for first, last, _, data, start, end, doc in word_slabs(batch):
        bins = (word_hashes(data, start, end) >> np.uint64(65 - BINS.bit_length())).astype(np.int64)
        n = np.bincount(doc * BINS + bins, minlength=(last - first) * BINS).reshape(-1, BINS)
        out[first:last, SHAPES:] = np.sqrt(n / np.maximum(n.sum(axis=1, keepdims=True), 1))
    return out


def _figures(batch) -> tuple[np.ndarray, list[tuple]]:
    source, lang = batch.column("source").to_pylist(), batch.column("lang").to_pylist()
    return text_figures(batch), [(s, x, None if s is None or x is None else (s, x)) for s, x in zip(source, lang)]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most about 2 * sample rows of docs (doc_id, text, lang, source) and labels (doc_id, quality)."""
    marks = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    marks = marks.where("doc_id is not null")
    place = F.pmod(F.xxhash64(F.lit(11), F.coalesce("doc_id", F.lit(LAST_ID))), F.lit(1 << 30)) / float(1 << 30)
    n, labelled = docs.count(), marks.count()
    # about ``sample`` rows by the choice made here, whatever the input: a bounded broadcast
    known = docs.join(F.broadcast(marks.where(place < min(1.0, sample / max(labelled, 1)))), "doc_id")
    pool = docs.where(place < min(1.0, sample / max(n - labelled, 1))).join(marks, "doc_id", "left_anti").withColumn("label", F.lit(None).cast("double"))
    chosen = known.unionByName(pool)

    def run(batches):
        for batch in batches:
            text = text_figures(batch)
            columns = [batch.column("doc_id"), batch.column("label"), pa.array([x.tobytes() for x in text], pa.binary()), batch.column("source"), batch.column("lang")]
            yield pa.record_batch(columns, names=["doc_id", "label", "text", "source", "lang"])

    got = chosen.select("doc_id", "text", "lang", "source", "label").transform(arrow, run, "doc_id long, label double, text binary, source string, lang string").toArrow()
    raw, ids = got["text"].to_pylist(), got["doc_id"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, raw[i]))
    text = np.frombuffer(b"".join(raw[i] for i in order), np.float32).reshape(-1, TEXT).astype(float)
    source, lang, label = (got[c].to_pylist() for c in ("source", "lang", "label"))
    meta = [(source[i], lang[i], None if source[i] is None or lang[i] is None else (source[i], lang[i])) for i in order]
    return Model(text, meta, np.array([np.nan if label[i] is None else label[i] for i in order], float))


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_text, p_meta, score, kept for each row of docs."""
    rows = _columns(docs)
    model = docs.sparkSession.sparkContext.broadcast(train(rows, labels))

    def run(batches):
        for batch in batches:
            a, b, both = model.value.scores(*_figures(batch))
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(x) for x in (a, b, both)), pa.array(both >= KEEP)], names=["doc_id", "p_text", "p_meta", "score", "kept"])

    return rows.transform(arrow, run, "doc_id long, p_text double, p_meta double, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject; all columns stay."""
    model = docs.sparkSession.sparkContext.broadcast(train(_columns(docs), labels))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.value.scores(*_figures(batch))[2] >= KEEP))

    return docs.transform(arrow, run, docs.schema)
