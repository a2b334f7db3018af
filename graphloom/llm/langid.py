"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed runs of 1 to 3 characters of the lower-cased text, other
characters than letters read as spaces.  Document frequencies come from every
document that may be learned from.  The weights are fit on a bounded, seeded
sample of labelled documents by follow-the-regularised-leader with elastic-net
penalties, and a temperature on a part of the sample kept apart calibrates the
probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hashed features; documents that the weights are fit on, over all languages; passes over them.
FEATURES, SAMPLE, EPOCHS = 1 << 14, 3_000, 2
#: Learning rate and its offset, and the L1 and L2 penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02

_LETTER = np.array([chr(c).isalpha() for c in range(1 << 16)])


def letters(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text, 32 where there is no letter."""
    x = np.frombuffer((text or "").lower().encode("utf-32-le"), dtype="<u4")
    low = _LETTER[np.minimum(x, 0xFFFF)]
    if (x > 0xFFFF).any():
        low = low.copy()
        for c in np.unique(x[x > 0xFFFF]):
            low[x == c] = chr(c).isalpha()
    return np.where(low, x, 32)


def counts(x: np.ndarray) -> np.ndarray:
    """How often each feature occurs in the code points."""
    h = x.astype(np.uint32)
    h1 = h * np.uint32(0x9E3779B1)
    grams = [h1]
    for n in (1, 2):
        if len(h) > n:
            h1 = (h1[:-1] ^ (h1[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + h[n:] * np.uint32(0xC2B2AE35) + np.uint32(n)
            grams.append(h1)
    out = np.zeros(FEATURES, dtype=np.int64)
    for g in grams:
        out += np.bincount((g ^ (g >> np.uint32(13))) * np.uint32(0x27D4EB2F) >> np.uint32(18), minlength=FEATURES)
    return out


@dataclass
class Model:
    """Languages, inverse document frequencies, weights (features x languages), bias and temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        x = letters(text)
        if not self.languages or not (x != 32).any():
            return "und", 0.0
        many = counts(x)
        at = np.flatnonzero(many)
        v = np.log1p(many[at]) * self.idf[at]
        norm = np.linalg.norm(v)
        logits = (v / norm) @ self.weights[at] + self.bias if norm else self.bias
        p = softmax(logits / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(languages: list[str], idf: np.ndarray, rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 42) -> Model:
    """rows: (language, features, log counts), in an order that does not depend on the run.

    A row's weighted features are made each time it is visited: held for all rows
    at once they would take several times the rows' own bytes of the driver.
    """
    rng = np.random.default_rng(seed)
    k = len(languages)
    z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))

    def weights(at: np.ndarray) -> np.ndarray:
        free = z[at] - np.sign(z[at]) * L1
        return np.where(np.abs(z[at]) <= L1, 0.0, -free / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    def visit(row: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
        y, at, tf = row
        x = tf.astype(np.float64) * idf[at]
        return y, np.append(at, FEATURES), np.append(x / np.linalg.norm(x), 1.0)  # the last is the bias

    data = [r for r in rows if np.linalg.norm(r[2].astype(np.float64) * idf[r[1]]) > 0]
    order = rng.permutation(len(data))
    apart, learn = order[: len(data) // 5], order[len(data) // 5 :]
    for _ in range(EPOCHS):
        for i in rng.permutation(learn):
            y, at, x = visit(data[i])
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            grown = np.sqrt(n[at] + g * g)
            z[at] += g - (grown - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    final = weights(np.arange(FEATURES + 1))
    temperature = 1.0
    if len(apart):
        logits = np.array([x @ final[at] for _, at, x in (visit(data[i]) for i in apart)])
        y = np.array([data[i][0] for i in apart])
        loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean()
        temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    return Model(languages, idf, final[:-1], final[-1], temperature)


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id is an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, many = np.zeros(FEATURES, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            total += counts(letters(text)) > 0
            many += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], many))], names=["feature", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [counts(letters(t)) for t in batch.column(2).to_pylist()]
        at = [np.flatnonzero(c) for c in found]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1),
                pa.array([a.astype(np.int16) for a in at], pa.list_(pa.int16())),
                pa.array([np.log1p(c[a]).astype(np.float32) for c, a in zip(found, at)], pa.list_(pa.float32())),
            ],
            names=["mark", "lang", "at", "tf"],
        )


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit a model on the rows of ``df`` that have a text and a language and are not held out."""
    own = df.where(~held_out(F.col(id_col)) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("mark"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    by_lang = {r[0]: r[1] for r in own.groupBy("lang").count().collect()}  # one row for each language
    languages = sorted(by_lang)
    if not languages:
        return Model([], np.zeros(FEATURES), np.zeros((FEATURES, 0)), np.zeros(0), 1.0)
    freq = own.select("text").mapInArrow(_document_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    found = freq.toArrow()  # one row for each feature
    df_of = np.zeros(FEATURES + 1, dtype=np.int64)
    df_of[found["feature"].to_numpy()] = found["n"].to_numpy()  # the number of texts, feature -1, comes last
    idf = np.array([np.log((1 + df_of[-1]) / (1 + n)) + 1e-3 for n in df_of[:-1]])
    # each language gives at most about SAMPLE / languages documents, drawn by their own hash
    share = SAMPLE / len(languages)
    chance = F.coalesce(*[F.when(F.col("lang") == n, F.lit(min(1.0, share / c))) for n, c in by_lang.items()])
    drawn = own.where(F.shiftrightunsigned("mark", 11) / float(1 << 53) < chance)
    rows = drawn.mapInArrow(_sparse, "mark long, lang string, at array<short>, tf array<float>").toArrow()
    place = {n: i for i, n in enumerate(languages)}
    language = np.array([place[n] for n in rows["lang"].to_pylist()], dtype=np.int64)
    ends = np.cumsum(pc.list_value_length(rows["at"]).to_numpy())
    ats, tfs = (pc.list_flatten(rows[c]).to_numpy() for c in ("at", "tf"))
    order = np.lexsort((language, rows["mark"].to_numpy()))
    del rows
    data = [(int(language[i]), ats[low:high], tfs[low:high]) for i, low, high in ((i, ends[i - 1] if i else 0, ends[i]) for i in order)]
    return fit(languages, idf, data)


def predictor(df: DataFrame, model: Model):
    """A Pandas UDF text -> (lang_pred, score); the model's size does not grow with the data."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, one row for each row of ``df``.

    Defined results: a null text or one without a letter is ``und`` with score 0,
    and so is every text if no row can be learned from; a null id counts as an
    empty one; repeated rows give repeated results; an empty table gives an
    empty result; other columns are not read.
    """
    predict = predictor(df, train(df, id_col, text_col, lang_col))
    found = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), predict(F.col(text_col).cast("string")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def identified(df: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``df`` whose text has a language: not ``und`` and a score of at least ``least``."""
    predict = predictor(df, train(df, id_col, text_col, lang_col))
    judged = df.withColumn("__langid", predict(F.col(text_col).cast("string")))
    kept = judged.where((F.col("__langid.lang_pred") != "und") & (F.col("__langid.score") >= least))
    return kept.select(*[kept[c] for c in df.columns])
