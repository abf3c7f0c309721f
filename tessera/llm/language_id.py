"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-cased text (everything that is no letter counts as a space) are
hashed to DIMS features, weighted by TF-IDF and scaled to length 1. Document frequencies come from all
labelled texts in one aggregation of at most DIMS rows. The weights are learned by follow-the-regularised-
leader with L1 and L2 penalties on about SAMPLE_PER_LANG labelled texts of each language, chosen by a
hash of the id (the documented bound of what the driver holds); a part of them is set aside to fit the temperature by
which scores are calibrated. Prediction is one pass without a shuffle, with a model of DIMS x languages.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _LETTER, classes
from .common import bounded_batches

DIMS = 1 << 14
SAMPLE_PER_LANG = 600
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.8, 1.0, 0.02, 0.02
#: One in so many sampled texts is used for the temperature only.
CALIBRATE_EVERY = 5
UNKNOWN = "und"
_BATCH = 64


def ngrams(text: str) -> np.ndarray:
    """The features of all n-grams of a text, repeated as they occur; empty if it has no letter."""
    cp = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = classes()[cp] == _LETTER
    if not letter.any():
        return np.empty(0, np.int64)
    c = np.where(letter, cp, 32).astype(np.uint32)
    space = c == 32
    c = c[~(space & np.append(False, space[:-1]))]
    a, b, d = c * np.uint32(2654435761), c * np.uint32(2246822519), c * np.uint32(3266489917)
    two = a[:-1] ^ (b[1:] >> np.uint32(3)) ^ np.uint32(0x9E3779B9)
    three = (a[:-2] ^ (b[1:-1] >> np.uint32(3)) ^ (d[2:] >> np.uint32(7))) * np.uint32(668265263)
    return (np.concatenate((a, two * np.uint32(374761393), three)) >> np.uint32(18)).astype(np.int64)


def counts(texts: list[str]) -> np.ndarray:
    """A row of n-gram counts for each text."""
    grams = [ngrams(t) for t in texts]
    flat = np.concatenate([g + i * DIMS for i, g in enumerate(grams)]) if grams else np.empty(0, np.int64)
    return np.bincount(flat, minlength=len(texts) * DIMS).reshape(len(texts), DIMS)


@dataclass
class Model:
    """Languages in order, IDF by feature, weights (feature x language, the last row is the bias), temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n = counts([t or "" for t in texts]).astype(np.float32)
        some = n.any(axis=1)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        x = n * self.idf
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        logits = (x @ self.weights[:-1]) / np.where(norm > 0, norm, 1)[:, None] + self.weights[-1]
        p = softmax(logits.astype(np.float64) / self.temperature)
        best = p.argmax(axis=1)
        return [self.langs[k] if ok else UNKNOWN for k, ok in zip(best, some, strict=True)], np.where(some, p.max(axis=1), 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_classes: int, dims: int = DIMS) -> np.ndarray:
    """Weights (dims + 1, n_classes) from sparse rows (features, values); elastic net, one coordinate's rate for each weight."""
    z, n = np.zeros((dims + 1, n_classes)), np.zeros((dims + 1, n_classes))

    def weights(i):
        zi, ni = z[i], n[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for r in order.permutation(len(rows)):
            i, v = rows[r]
            i, v = np.append(i, dims), np.append(v, 1.0)
            w = weights(i)
            err = softmax(v @ w)
            err[y[r]] -= 1
            g = v[:, None] * err
            root = np.sqrt(n[i])
            n[i] += g * g
            z[i] += g - (np.sqrt(n[i]) - root) / ALPHA * w
    return weights(np.arange(dims + 1))


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits with the least log loss against labels smoothed by one miss in n + 2; 1 where nothing was set aside."""
    if not len(y):
        return 1.0
    grid = np.geomspace(0.02, 20, 121)
    miss = 1 / (len(y) + 2)
    loss = []
    for t in grid:
        log_p = np.log(np.maximum(softmax(logits / t), 1e-12))
        loss.append(-((1 - miss) * log_p[np.arange(len(y)), y] + miss * log_p.mean(axis=1)).mean())
    return float(grid[int(np.argmin(loss))])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the labelled rows of docs (text and label not null, text with a letter). Without any: a model that knows nothing."""
    labelled = bounded_batches(docs).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where("t is not null and l is not null")

    def frequencies(batches):
        import pyarrow as pa

        df, total = np.zeros(DIMS, np.int64), 0
        for b in batches:
            texts = b.column(0).to_pylist()
            for at in range(0, len(texts), _BATCH):
                seen = counts(texts[at : at + _BATCH]) > 0
                df += seen.sum(axis=0)
                total += int(seen.any(axis=1).sum())
        f = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*f, DIMS], pa.int32()), pa.array([*df[f], total], pa.int64())], names=["f", "n"])

    stats = labelled.select("t").mapInArrow(frequencies, "f int, n bigint").groupBy("f").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(DIMS + 1, np.int64)
    n[stats["f"].to_numpy()] = stats["n"].to_numpy()
    idf = (np.log((1 + n[DIMS]) / (1 + n[:DIMS])) + 1).astype(np.float32)

    sizes = {r["l"]: r["count"] for r in labelled.groupBy("l").count().collect()}
    langs = sorted(sizes)
    if not langs or not n[DIMS]:
        return Model([], idf, np.zeros((DIMS + 1, 0), np.float32), 1.0)
    unit = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.element_at(F.create_map(*[F.lit(v) for k in langs for v in (k, min(1.0, SAMPLE_PER_LANG / sizes[k]))]), F.col("l"))

    def sparse(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, _BATCH):
                part = b.slice(at, _BATCH)
                got = counts(part.column(2).to_pylist())
                rows = [np.flatnonzero(c) for c in got]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([i.astype(np.int32) for i in rows], pa.list_(pa.int32())), pa.array([got[k][i].astype(np.int32) for k, i in enumerate(rows)], pa.list_(pa.int32()))],
                    names=["id", "l", "i", "v"],
                )

    sample = labelled.where(unit < rate).select("id", "l", "t").mapInArrow(sparse, "id string, l string, i array<int>, v array<int>").toPandas()
    sample = sample[sample["i"].map(len) > 0].sort_values(["id", "l"], kind="stable").reset_index(drop=True)
    rows = []
    for i, v in zip(sample["i"], sample["v"], strict=True):
        x = np.asarray(v, np.float64) * idf[np.asarray(i)]
        rows.append((np.asarray(i, np.int64), x / np.sqrt((x * x).sum())))
    y = sample["l"].map({k: j for j, k in enumerate(langs)}).to_numpy(np.int64) if len(sample) else np.empty(0, np.int64)
    aside = np.arange(len(rows)) % CALIBRATE_EVERY == CALIBRATE_EVERY - 1
    fit = np.flatnonzero(~aside)
    w = train_ftrl([rows[k] for k in fit], y[fit], len(langs))
    held = [(rows[k][1] @ w[rows[k][0]]) + w[-1] for k in np.flatnonzero(aside)]
    t = fit_temperature(np.array(held), y[aside]) if held else 1.0
    return Model(langs, idf, w.astype(np.float32), t)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred (a language of the model) and score (0 to 1), from the whole of text_col alone.

    A null text or one without a letter is UNKNOWN with score 0. All columns stay; those of the two names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    src = bounded_batches(docs).select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text_col)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(0, b.num_rows, _BATCH):
                part = b.slice(k, _BATCH)
                lang, score = model.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    schema = T.StructType([*src.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return src.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 0 when divided by 5; such rows are not learned from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0
