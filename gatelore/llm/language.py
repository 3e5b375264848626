"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased and their character 1- to 3-grams hashed into ``features`` columns. Weights are trained by
follow-the-regularised-leader with elastic-net (L1 and L2) penalties, which leaves most of them at zero; a temperature
fitted on a part of the sample that training never saw turns scores into calibrated probabilities.

Scale: document frequencies are counted over every learnable document, one count vector per task being added up by
feature; only the weights are fitted on a sample of different texts. Each language has its share of ``sample_rows`` by its
number of different texts, and LEAST_OF_LANG of them at least (all where it has fewer), so every learnable language is
learned however rare it is. The texts are those of the smallest hashes, hence the same at any partitioning. The driver
keeps them as sparse rows. Prediction is one pass over whole texts where they are read, the model being a few hundred KB.

Defined results: a text that is null or has no letter is ``und`` with score 0; without any learnable row every text is
``und`` with score 0; repeated rows get equal answers; ties between languages go to the first in alphabetical order; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelore.llm.common import begin_step, sliced

FEATURES = 1 << 14
SAMPLE_ROWS = 3000
LEAST_OF_LANG = 30
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def ngram_counts(text: str, features: int = FEATURES) -> np.ndarray:
    """Counts of the hashed 1-, 2- and 3-grams of a text."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    one = code * np.uint32(2654435761)
    two = (one[:-1] ^ (one[1:] >> np.uint32(7))) * np.uint32(2246822519)
    three = (two[:-1] ^ (one[2:] >> np.uint32(11))) * np.uint32(3266489917)
    shift = np.uint32(32 - features.bit_length() + 1)
    return sum(np.bincount((g >> shift).astype(np.int64), minlength=features) for g in (one, two, three))


class Model:
    """TF-IDF weights, class weights and temperature. Single-precision counts are turned into vectors in place."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        self.langs, self.idf, self.weights, self.bias, self.temperature = langs, idf.astype(np.float32), weights, bias, temperature

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts, dtype=np.float32, out=counts if counts.dtype == np.float32 else None)
        x *= self.idf
        x /= np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), np.float32(1e-9))
        return x

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax((x @ self.weights + self.bias) / self.temperature)


class SparseRows:
    """TF-IDF vectors of unit length, kept sparse; slices come out dense."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray):
        self.shape, self.dtype, self.rows = (len(rows), len(idf)), np.dtype(np.float32), []
        for at, n in rows:
            v = np.log1p(n, dtype=np.float32) * idf[at]
            self.rows.append((at, v / np.maximum(np.linalg.norm(v), np.float32(1e-9))))

    def __len__(self) -> int:
        return len(self.rows)

    def part(self, which: np.ndarray) -> SparseRows:
        out = SparseRows([], np.zeros(self.shape[1], np.float32))
        out.rows, out.shape = [self.rows[r] for r in which], (len(which), self.shape[1])
        return out

    def __getitem__(self, which: np.ndarray) -> np.ndarray:
        out = np.zeros((len(which), self.shape[1]), np.float32)
        for k, r in enumerate(which):
            out[k, self.rows[r][0]] = self.rows[r][1]
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(x: np.ndarray | SparseRows, y: np.ndarray, classes: int, rounds: int = 4, batch: int = 16, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.002) -> tuple[np.ndarray, np.ndarray]:
    """Per-coordinate follow-the-regularised-leader; the last row is the bias, which is not penalised by L1.

    Columns that are zero in a whole batch have no gradient and stay as they are, so a step looks at the others only.
    """
    columns = x.shape[1] + 1
    z, n = np.zeros((columns, classes)), np.zeros((columns, classes))
    pull = np.full((columns, 1), l1)
    pull[-1] = 0
    rng, hot = np.random.default_rng(0), np.eye(classes)

    def weights(z: np.ndarray, n: np.ndarray, pull: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= pull, 0.0, (np.sign(z) * pull - z) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(rounds):
        order = rng.permutation(len(x))
        for first in range(0, len(x), batch):
            rows = order[first : first + batch]
            some = np.hstack([x[rows], np.ones((len(rows), 1), x.dtype)])
            at = np.flatnonzero(some.any(axis=0))
            some, past = some[:, at], n[at]
            w = weights(z[at], past, pull[at])
            g = some.T @ (softmax(some @ w) - hot[y[rows]]) / len(rows)
            sigma = (np.sqrt(past + g * g) - np.sqrt(past)) / alpha
            z[at] += g - sigma * w
            n[at] = past + g * g
    w = weights(z, n, pull)
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return -float(np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean())

    low, high, g = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], df: np.ndarray, n_docs: int) -> Model | None:
    """Fit weights on four fifths of each language's rows (columns and counts), the temperature on the rest."""
    names = sorted(set(langs))
    if not names:
        return None
    model = Model(names, np.log((1.0 + n_docs) / (1.0 + df)) + 1.0, np.zeros((len(df), len(names))), np.zeros(len(names)))
    place, met, rest = {k: i for i, k in enumerate(names)}, dict.fromkeys(names, 0), []
    for k in langs:  # rows come in the order of a hash; the first of a language is always fitted
        rest.append(met[k] % 5 == 4)
        met[k] += 1
    x, y, rest = SparseRows(rows, model.idf), np.array([place[k] for k in langs]), np.array(rest)
    fitted, checked = np.flatnonzero(~rest), np.flatnonzero(rest)
    # the few rows of a rare language are shown more often
    fitted = np.repeat(fitted, np.maximum(1, LEAST_OF_LANG // np.bincount(y[fitted], minlength=len(names)))[y[fitted]])
    model.weights, model.bias = ftrl(x.part(fitted), y[fitted], len(names))
    model.weights = model.weights.astype(np.float32)
    logits = [x[checked[k : k + 64]] @ model.weights + model.bias for k in range(0, len(checked), 64)]
    model.temperature = fit_temperature(np.vstack(logits), y[checked]) if logits else 1.0
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _frequencies(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[pa.RecordBatch]:
    begin_step("language frequencies")
    df, n = np.zeros(features + 1, dtype=np.int64), 0
    for b in sliced(batches):
        for t in b.column(0).to_pylist():
            df[:-1] += ngram_counts(t, features) > 0
            n += 1
    df[-1] = n
    if n:
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["feature", "n"])


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES) -> Model | None:
    """Learn from text and lang of the rows given, lang not null."""
    usable = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0))
    df = np.zeros(features + 1, dtype=np.int64)
    counted = usable.select("text").mapInArrow(lambda it: _frequencies(it, features), "feature long, n long")
    for row in counted.groupBy("feature").agg(F.sum("n").alias("n")).collect():  # at most features + 1 rows
        df[row.feature] = row.n
    last = _last_hashes(usable, sample_rows)
    if not last:
        return None
    # the sample is chosen by hash alone; its texts are read in a second step
    ends = docs.sparkSession.createDataFrame(list(last.items()), "lang string, last long")
    sample = usable.select("text", "lang", F.xxhash64("text").alias("h")).join(F.broadcast(ends), "lang").filter("h <= last").dropDuplicates(["lang", "h"])
    got = sample.select("text", "lang", "h").mapInArrow(lambda it: _sparse(it, features), "lang string, h long, at binary, n binary").collect()
    got.sort(key=lambda r: (r["h"], r["lang"]))
    rows = [(np.frombuffer(r["at"], "<u4"), np.frombuffer(r["n"], "<u4")) for r in got]
    return train(rows, [r["lang"] for r in got], df[:-1], int(df[-1]))


def _last_hashes(usable: DataFrame, sample_rows: int) -> dict[str, int]:
    """For each language, the largest hash of the texts that are its share of the sample."""
    hashed = usable.select("lang", F.xxhash64("text").alias("h"))
    sizes = hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.min("h").alias("least")).collect()
    whole = max(1, sum(r.n for r in sizes))
    share = {r.lang: max(LEAST_OF_LANG, round(sample_rows * r.n / whole)) for r in sizes}
    # hashes are spread evenly: about twice a share, and some, are looked at
    upto = {r.lang: (1 << 63) - 1 if r.n <= 2 * share[r.lang] + 100 else max(r.least, int((2 * share[r.lang] + 100) / r.n * 2.0**64) - (1 << 63)) for r in sizes}
    if not upto:
        return {}
    ends = usable.sparkSession.createDataFrame(list(upto.items()), "lang string, upto long")
    near: dict[str, list[int]] = {}
    for r in hashed.join(F.broadcast(ends), "lang").filter("h <= upto").select("lang", "h").distinct().collect():
        near.setdefault(r.lang, []).append(r.h)
    return {k: sorted(hs)[: share[k]][-1] for k, hs in near.items()}


def _sparse(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        at, n = [], []
        for t in b.column(0).to_pylist():
            c = ngram_counts(t, features)
            here = np.flatnonzero(c)
            at.append(here.astype("<u4").tobytes())
            n.append(c[here].astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["lang", "h", "at", "n"])


def predict(texts: list[str | None], model: Model | None, features: int = FEATURES) -> tuple[list[str], list[float]]:
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    known = [k for k, t in enumerate(texts) if t and LETTER.search(t)] if model else []
    for first in range(0, len(known), 64):
        some = known[first : first + 64]
        counts = np.empty((len(some), features), np.float32)
        for row, k in enumerate(some):
            counts[row] = ngram_counts(texts[k], features)
        p = model.probabilities(model.vectors(counts))
        for k, best, score in zip(some, p.argmax(1).tolist(), p.max(1).tolist()):
            langs[k], scores[k] = model.langs[best], score
    return langs, scores


def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        langs, scores = predict(b.column("text").to_pylist(), model.value)
        added = {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())}
        yield pa.RecordBatch.from_arrays([*b.columns, *added.values()], names=[*b.schema.names, *added])


def label_language(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred and score added (in place of columns of these names)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score")
    schema = kept.withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema
    return kept.mapInArrow(lambda it: _predict(it, sent), schema)


def least_score(model: Model | None, above_chance: float) -> float:
    """So many times the chance of a guess among the learned languages, taken as four at least (a lone language is always sure)."""
    return above_chance / max(len(model.langs), 4) if model else 0.0


def _known(texts: Iterator[pa.Array], model: Model | None, above_chance: float) -> Iterator[pa.Array]:
    begin_step("language flags")
    least = least_score(model, above_chance)
    for a in texts:
        out: list[bool] = []
        for first in range(0, len(a), 128):
            out += [lang != UNKNOWN and score >= least for lang, score in zip(*predict(a.slice(first, 128).to_pylist(), model))]
        yield pa.array(out, pa.bool_())


def keep_known(docs: DataFrame, model: Model | None, above_chance: float) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose language is predicted with so many times the chance of a guess.

    Python sees the texts only and answers with a flag for each, so rows don't come back through it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def known(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _known(texts, sent.value, above_chance)

    return docs.filter(known(docs["text"]))


def identify_language(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Rows that are held out are never learned from."""
    rows = docs.select("doc_id", "text", "lang")
    model = learn(rows.filter(~held_out(F.col("doc_id"))), sample_rows)
    marked = rows.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return label_language(marked, model).drop("text")
