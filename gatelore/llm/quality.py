"""A quality classifier trained by co-training.

Two views of a document each have a logistic classifier: its text (hashed character pairs, case kept, and shares of signs, capitals and repeats) and its metadata
(source, language and the recorded number of signs, none of it read from the text). Both start from the same labelled sample. Over several rounds each classifier labels
the documents of a pool of unlabelled ones that it is surest of, after calibration on held-out labels, and hands them to the
other one's training set. Finally each view is calibrated and a two-input logistic combination of the calibrated views
scores every document.

Scale: only fitting is bounded, by ``labelled_rows`` and ``pool_rows`` (the rows of the smallest key hashes, the same at
any partitioning); what reaches the driver is their hashed counts. Scoring is one pass over whole texts where they are
read, with a model of a few hundred KB, and no shuffle.

Defined results: null text is scored as empty; missing metadata is a value of its own; repeated labels of one document
count as given; labels other than 0 and 1 are ignored; without labels of both kinds every score is 0.5 and every document is
kept; repeated rows get equal answers; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelore.llm.common import discard, stage

TEXT_FEATURES = 1 << 11
TEXT_COLUMNS = TEXT_FEATURES + 4
SIGNS, UPPER = re.compile(r"[\w\s.,]+"), re.compile(r"[A-Z]")
SOURCES, LANGS, SIZES = 256, 32, 7
META_COLUMNS = SOURCES + LANGS + SIZES
LABELLED_ROWS = POOL_ROWS = 3000
ROUNDS, SURE, HANDED = 4, 0.95, 300


def text_view(text: str | None) -> np.ndarray:
    code = np.frombuffer((text or "").encode("utf-32-le", "replace"), dtype="<u4") * np.uint32(2654435761)
    shift = np.uint32(32 - TEXT_FEATURES.bit_length() + 1)
    pair = (code[:-1] ^ (code[1:] >> np.uint32(9))) * np.uint32(2246822519)
    counts = sum(np.bincount((g >> shift).astype(np.int64), minlength=TEXT_FEATURES) for g in (code, pair))
    x = np.log1p(counts).astype(np.float32)
    x /= max(float(np.linalg.norm(x)), 1e-9)
    words = (text or "").split()
    n, m = max(len(text or ""), 1), max(len(words), 1)
    signs = len(SIGNS.sub("", text or ""))
    same = sum(a == b for a, b in zip(words, words[1:]))
    shape = (signs / n, len(UPPER.findall(text or "")) / n, len(set(words)) / m, same / m)
    return np.concatenate([x, np.array(shape, dtype=np.float32)])


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    x = np.zeros(META_COLUMNS, dtype=np.float32)
    x[zlib.crc32(str(source).encode()) % SOURCES] = 1
    x[SOURCES + zlib.crc32(str(lang).encode()) % LANGS] = 1
    size = np.log1p(max(n_chars or 0, 0))
    x[-SIZES:] = n_chars is None, size / 10, *(abs(size - k) < 1 for k in range(2, 12, 2))
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, rounds: int = 120, rate: float = 0.5, l2: float = 1e-4) -> np.ndarray:
    """Logistic regression by adaptive gradient steps, both classes weighing the same; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w = np.zeros(x.shape[1], x.dtype) if start is None else start.copy()
    seen = np.full(x.shape[1], 1e-8, x.dtype)
    for _ in range(rounds if start is None else rounds // 3):
        g = (weight * (sigmoid(x @ w) - y)).astype(x.dtype) @ x + x.dtype.type(l2) * w
        seen += g * g
        w -= x.dtype.type(rate) * g / np.sqrt(seen)
    return w


def logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def fit_scale(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling: slope and shift of a logit that fit the labels by Newton steps, unweighted."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = sigmoid(a * z + b)
        r, s = p - y, np.maximum(p * (1 - p), 1e-6)
        g = np.array([(r * z).mean() + 1e-3 * (a - 1), r.mean()])
        h = np.array([[(s * z * z).mean() + 1e-3, (s * z).mean()], [(s * z).mean(), s.mean() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    return a, b


class Views:
    """The trained pair: weights and scaling of each view, and how the two are combined."""

    def __init__(self, weights: list[np.ndarray], scales: list[tuple[float, float]], mix: np.ndarray):
        self.weights, self.scales, self.mix = weights, scales, mix

    def calibrated(self, view: int, x: np.ndarray) -> np.ndarray:
        a, b = self.scales[view]
        return a * logit(x, self.weights[view]) + b

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.stack([self.calibrated(0, text), self.calibrated(1, meta)], axis=1)
        return sigmoid(z[:, 0]), sigmoid(z[:, 1]), sigmoid(logit(z, self.mix))


def co_train(labelled: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray]) -> Views | None:
    """``labelled`` and ``pool``: the text view and the metadata view of the same rows."""
    if len(set(y.tolist())) < 2:
        return None
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    check = held if held.any() else ~held
    known: list[dict[int, float]] = [{}, {}]  # what each view was handed: row of the pool, label
    weights: list[np.ndarray] = [None, None]
    scales = [(1.0, 0.0)] * 2
    for round_ in range(ROUNDS + 1):
        for v in (0, 1):
            rows = list(known[v])
            x = np.vstack([labelled[v][~held], pool[v][rows]]) if rows else labelled[v][~held]
            weights[v] = fit_logistic(x, np.concatenate([y[~held], [known[v][r] for r in rows]]), weights[v])
            scales[v] = fit_scale(logit(labelled[v][check], weights[v]), y[check])
        if round_ == ROUNDS or not len(pool[0]):
            break
        for v in (0, 1):
            p = sigmoid(scales[v][0] * logit(pool[v], weights[v]) + scales[v][1])
            share = float(y.mean())
            for label, sure, most in ((1.0, p, HANDED * share), (0.0, 1 - p, HANDED * (1 - share))):
                best = np.argsort(-sure, kind="stable")[: int(most)]
                known[1 - v].update((int(r), label) for r in best if sure[r] >= SURE and int(r) not in known[1 - v])
    views = Views(weights, scales, np.array([0.5, 0.5, 0.0]))
    z = np.stack([views.calibrated(v, labelled[v][check]) for v in (0, 1)], axis=1)
    mix = _fit_mix(z, y[check])
    return Views(weights, scales, mix)


def _fit_mix(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = np.hstack([np.clip(z, -8, 8), np.ones((len(z), 1))])
    w = np.array([0.5, 0.5, 0.0])
    for _ in range(30):
        p = sigmoid(x @ w)
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x / len(y) + np.diag([1e-2, 1e-2, 1e-6])
        w = w - np.clip(np.linalg.solve(h, x.T @ (p - y) / len(y) + np.array([1e-2, 1e-2, 0]) * (w - 0.5)), -1, 1)
    return w


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text, source, lang, size, label = (b.column(n).to_pylist() for n in ("text", "source", "lang", "n_chars", "label"))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([text_view(t).astype("<f4").tobytes() for t in text], pa.binary()),
                pa.array([meta_view(*m).astype("<f4").tobytes() for m in zip(source, lang, size)], pa.binary()),
                pa.array(label, pa.int32()),
            ],
            names=["text", "meta", "label"],
        )


def _collected(rows: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    got = rows.mapInArrow(_views, "text binary, meta binary, label int").collect()
    if not got:
        return [np.zeros((0, TEXT_COLUMNS), np.float32), np.zeros((0, META_COLUMNS), np.float32)], np.zeros(0)
    return [np.stack([np.frombuffer(r[v], "<f4") for r in got]) for v in ("text", "meta")], np.array([r["label"] or 0 for r in got], dtype=float)


def train_quality(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, pool_rows: int = POOL_ROWS) -> Views | None:
    rows = docs.selectExpr("cast(doc_id AS long) AS doc_id", "text", "source", "lang", "cast(n_chars AS long) AS n_chars")
    ids, key = rows.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct(), F.xxhash64("doc_id")
    given = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    # labels of documents that are not there take up no place in the sample
    chosen = stage(given.join(ids, "doc_id", "left_semi").orderBy(key, "label").limit(labelled_rows), "chosen")
    labelled, y = _collected(rows.join(F.broadcast(chosen), "doc_id").orderBy(key, "label").limit(labelled_rows))
    # labelled documents, those of the calibration among them, never come back as pseudo-labelled ones
    drawn = stage(ids.join(given, "doc_id", "left_anti").orderBy(F.xxhash64("doc_id", F.lit(1))).limit(pool_rows), "drawn")
    pool, _ = _collected(rows.join(F.broadcast(drawn), "doc_id").withColumn("label", F.lit(None).cast("int")).orderBy(key).limit(pool_rows))
    discard(chosen, drawn)
    return co_train(labelled, y, pool)


SCORED = "doc_id long, text_score double, meta_score double, score double, kept boolean"


def _score(batches: Iterator[pa.RecordBatch], model, threshold: float) -> Iterator[pa.RecordBatch]:
    views = model.value
    for batch in batches:
        for b in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            text, source, lang, size = (b.column(n).to_pylist() for n in ("text", "source", "lang", "n_chars"))
            if views is None:
                scores = [np.full(len(text), 0.5)] * 3
            else:
                scores = views.scores(np.stack([text_view(t) for t in text]), np.stack([meta_view(*m) for m in zip(source, lang, size)]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(s, pa.float64()) for s in scores), pa.array(scores[2] >= threshold)], names=["doc_id", "text_score", "meta_score", "score", "kept"]
            )


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **sizes) -> DataFrame:
    """One row per document: doc_id, text_score, meta_score, score (probability of good quality), kept."""
    model = docs.sparkSession.sparkContext.broadcast(train_quality(docs, labels, **sizes))
    rows = docs.selectExpr("cast(doc_id AS long) AS doc_id", "text", "source", "lang", "cast(n_chars AS long) AS n_chars")
    return rows.mapInArrow(lambda it: _score(it, model, threshold), SCORED)
