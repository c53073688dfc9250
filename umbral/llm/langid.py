"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Document frequencies come from all rows one may learn from; the regression is trained on a bounded sample of them by
follow-the-regularised-leader with elastic-net penalties, and its scores are calibrated by one temperature, fitted on
sampled rows that the regression didn't see.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from .common import cut, tidy

#: Hashed features.
SIZE = 1 << 16
UNKNOWN = "und"


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features (hashed 2- and 3-grams of the lower-case text between two spaces) and how often they occur."""
    s = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    two = s[:-1] * np.uint32(0x9E3779B1) ^ s[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) ^ s[2:] * np.uint32(0x27D4EB2F)
    h = np.concatenate([two, three])
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    n = np.bincount(h >> np.uint32(16), minlength=SIZE)
    at = np.flatnonzero(n)
    return at, n[at]


def weigh(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[at]
    return x / max(1e-12, float(np.sqrt(x @ x)))


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _frequencies(batches):
    df = np.zeros(SIZE, np.int64)
    n = 0
    for b in batches:
        for text in b.column(0).to_pylist():
            df[counts(text or "")[0]] += 1
            n += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[n, df[at]])], names=["feature", "n"])


def _features(batches):
    for b in batches:
        found = [counts(t or "") for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([a.astype(np.uint32).tobytes() for a, _ in found], pa.binary()), pa.array([n.astype(np.uint32).tobytes() for _, n in found], pa.binary())], names=["lang", "h", "at", "n"])


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.idf, self.weights, self.bias, self.temperature = langs, idf, weights, bias, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        at, n = counts(text)
        p = softmax((weigh(at, n, self.idf) @ self.weights[at] + self.bias) / self.temperature)
        i = int(p.argmax())
        return self.langs[i], float(p[i])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, rate: float = 1.0, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, epochs: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Follow the regularised leader, proximal, per coordinate; returns weights and bias (the last feature, always 1)."""
    z, n = np.zeros((SIZE + 1, classes)), np.zeros((SIZE + 1, classes))
    rng = np.random.default_rng(7)

    def now(at):
        w = (np.sign(z[at]) * l1 - z[at]) / ((beta + np.sqrt(n[at])) / rate + l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, w)

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, SIZE), np.append(x, 1.0)
            w = now(at)
            p = softmax(x @ w)
            p[labels[i]] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / rate
            z[at] += g - sigma * w
            n[at] += g * g
    w = now(np.arange(SIZE + 1))
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature from 1/64 to 16 with the least log loss."""
    if not len(logits):
        return 1.0
    grid = np.exp2(np.arange(-6, 4.01, 0.125))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", per_language: int = 2000, languages: int = 256) -> Model:
    """Learns from all rows of docs with a language. Frequencies count every row; the regression takes at most the
    per_language rows of each language whose key and text hash lowest (all, if there are no more; rows that repeat both
    may leave it a few short), every fifth of them for the temperature alone. That sample goes to the driver, and weights of 65,536 features a language to every worker: over
    `languages` languages it raises ValueError.

    Rows without a language teach nothing; null and empty texts count as texts of one space, and keys may repeat or be
    null. Rows that repeat a key and a text tie, and any of them stands for the others. With no row at all the model
    knows no language and predicts `und`; with one language it always predicts that. Other columns are ignored."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(key_col, text_col).alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(languages + 1).collect()}
    if len(sizes) > languages:
        raise ValueError(f"there are more than {languages} languages")
    if not sizes:
        return Model([], np.zeros(SIZE), np.zeros((SIZE, 0)), np.zeros(0), 1.0)
    langs = sorted(sizes)
    found = rows.select("text").mapInArrow(tidy(_frequencies), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()  # SIZE + 1 rows at most
    found = found.set_index("feature")["n"]
    df = np.zeros(SIZE)
    total = int(found.get(-1, 0))
    found = found[found.index >= 0]
    df[found.index.to_numpy()] = found.to_numpy()
    idf = np.log((1 + total) / (1 + df)) + 1
    # one and a half times as many by hash, so that only those are shuffled; then the lowest of them
    span = 1 << 30
    bound = F.create_map(*[x for n in langs for x in (F.lit(n), F.lit(min(span, 3 * span * per_language // (2 * sizes[n]))))])
    near = rows.where(F.pmod("h", F.lit(span)) < F.element_at(bound, F.col("lang")))
    lowest = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(span)), "h"))
    picked = near.withColumn("nth", lowest).where(F.col("nth") <= per_language).select("lang", "h", "text")
    picked = cut(picked.mapInArrow(_features, "lang string, h long, at binary, n binary"), "sample")
    fit, rest, y_fit, y_rest = [], [], [], []
    of = {n: i for i, n in enumerate(langs)}
    for r in picked.orderBy("h", "lang", "at").toLocalIterator():
        at = np.frombuffer(r["at"], np.uint32).astype(np.int32)
        x = weigh(at, np.frombuffer(r["n"], np.uint32), idf).astype(np.float32)
        last = len(fit) + len(rest)
        (rest if last % 5 == 4 else fit).append((at, x))
        (y_rest if last % 5 == 4 else y_fit).append(of[r["lang"]])
    weights, bias = ftrl(fit, np.array(y_fit), len(langs))
    logits = np.array([x @ weights[at] + bias for at, x in rest]).reshape(len(rest), len(langs))
    return Model(langs, idf, weights, bias, fit_temperature(logits, np.array(y_rest, int)))


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_as: str = "lang_pred", score_as: str = "score", least: float | None = None) -> DataFrame:
    """docs with the predicted language and its calibrated probability (0 to 1) in two more columns.

    Every whole text is read; a null text or one without a letter is `und`, with 0. With `least`, rows that are `und`
    or score less go, and no column is added. Otherwise rows are kept as they are, with their other columns, of which
    those named as the two new ones are replaced. An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = [] if least is not None else [lang_as.lower(), score_as.lower()]
    kept = [i for i, c in enumerate(docs.columns) if c.lower() not in new]
    at = docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        for b in batches:
            found = [m.predict(t) for t in b.column(at).to_pylist()]
            if least is None:
                arrays = [*(b.column(i) for i in kept), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*(b.schema.names[i] for i in kept), lang_as, score_as])
            else:
                yield b.filter(pa.array([x != UNKNOWN and s >= least for x, s in found], pa.bool_()))

    fields = [docs.schema.fields[i] for i in kept] + ([StructField(lang_as, StringType()), StructField(score_as, DoubleType())] if least is None else [])
    return docs.mapInArrow(tidy(run), StructType(fields))
