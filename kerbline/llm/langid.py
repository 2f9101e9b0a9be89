"""Language identification with a convolutional network over bytes, trained and run in numpy.

The network sees a window of `WINDOW` bytes of the lower-cased text.  Filters of several widths slide over it, each
filter's largest response is kept, and a softmax over those responses gives a probability for each language.  With bytes
as input a filter is one table per offset, from byte to response; for running, the tables of neighbouring offsets are
folded into one from byte pairs, so a filter of width four costs two look-ups.

A text is cut into windows from start to end, all of them are read, and the probabilities are averaged with the windows'
bytes as weights.

Training takes at most `PER_LANGUAGE` texts of each language (fewer of each where that would be over `MOST_TEXTS` in
all, but at least one of every language), those with the least hash of their id, and one piece of at most `PIECE` characters of each at a hashed place; rows held out by the caller are left
out.  Everything else reads all texts.

Defined results: null, and texts without a letter, are `und` with score 0; so is everything if nothing can be learned;
each input row gives one result row.  Input columns named like the added ones are replaced, any other name is free.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, release_memory

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
PER_LANGUAGE = 400
MOST_TEXTS = 20_000
PIECE = 2048
STEPS = 500
BATCH = 64
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    tables: dict[int, np.ndarray]  # width: (width, 256, FILTERS)
    weights: np.ndarray
    bias: np.ndarray


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a text, padded with zero bytes, and how many bytes each holds."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    count = -(-len(data) // WINDOW)
    padded = np.zeros(count * WINDOW, np.uint8)
    padded[: len(data)] = data
    held = np.full(count, WINDOW, np.int64)
    if count:
        held[-1] = len(data) - (count - 1) * WINDOW
    return padded.reshape(count, WINDOW), held


def _responses(tables: np.ndarray, windows: np.ndarray) -> np.ndarray:
    span = WINDOW - len(tables) + 1
    return sum(table[windows[:, i : i + span]] for i, table in enumerate(tables))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7) -> Model:
    """Adam on the cross-entropy; only the largest response of each filter passes a gradient back."""
    rng = np.random.default_rng(seed)
    tables = {w: rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
    weights = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    params = [*tables.values(), weights, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        pick = rng.integers(0, len(windows), BATCH)
        x, y = windows[pick], labels[pick]
        where, pooled = [], []
        for table in tables.values():
            r = _responses(table, x)
            at = r.argmax(axis=1)
            where.append(at)
            pooled.append(np.take_along_axis(r, at[:, None, :], axis=1)[:, 0])
        hidden = np.tanh(np.concatenate(pooled, axis=1))
        error = _softmax(hidden @ weights + bias)
        error[np.arange(len(y)), y] -= 1
        error /= len(y)
        back = (error @ weights.T) * (1 - hidden**2)
        grads = []
        for i, table in enumerate(tables.values()):
            grad = np.zeros_like(table)
            part = back[:, i * FILTERS : (i + 1) * FILTERS]
            for j in range(len(table)):
                np.add.at(grad[j], (np.take_along_axis(x, where[i] + j, axis=1), np.arange(FILTERS)[None, :]), part)
            grads.append(grad)
        grads += [hidden.T @ error + 1e-4 * weights, error.sum(axis=0)]
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(languages, tables, weights, bias)


class Predictor:
    """Runs a model with tables of byte pairs."""

    def __init__(self, model: Model):
        self.model = model
        self.folded = {w: [self._pairs(t[i], t[i + 1]) if i + 1 < w else t[i] for i in range(0, w, 2)] for w, t in model.tables.items()}

    @staticmethod
    def _pairs(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return (one[:, None, :] + two[None, :, :]).reshape(-1, FILTERS)

    def windows(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities for each window."""
        pairs = windows[:, :-1].astype(np.uint16) * np.uint16(256) + windows[:, 1:]
        pooled = []
        for width, tables in self.folded.items():
            span = WINDOW - width + 1
            total = None
            for i, table in enumerate(tables):
                at = pairs[:, 2 * i : 2 * i + span] if len(table) > 256 else windows[:, 2 * i : 2 * i + span]
                total = table.take(at, axis=0) if total is None else np.add(total, table.take(at, axis=0), out=total)
            pooled.append(total.max(axis=1))
        return _softmax(np.tanh(np.concatenate(pooled, axis=1)) @ self.model.weights + self.model.bias)

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        clear = [t is not None and any(map(str.isalpha, t)) for t in texts]
        total = np.zeros((len(texts), len(self.model.languages)))
        rows: list[np.ndarray] = []
        held: list[np.ndarray] = []
        owner: list[np.ndarray] = []

        def flush() -> None:
            if rows:
                np.add.at(total, np.concatenate(owner), self.windows(np.concatenate(rows)) * np.concatenate(held)[:, None])
                rows.clear(), held.clear(), owner.clear()

        waiting = 0
        for i, text in enumerate(texts):
            if clear[i]:
                all_windows, sizes = windows_of(text)
                for at in range(0, len(sizes), BATCH):
                    rows.append(all_windows[at : at + BATCH])
                    held.append(sizes[at : at + BATCH])
                    owner.append(np.full(len(rows[-1]), i))
                    waiting += len(rows[-1])
                    if waiting >= BATCH:
                        flush()
                        waiting = 0
        flush()
        best = total.argmax(axis=1)
        sums = total.sum(axis=1)
        names = [self.model.languages[b] if c else UNKNOWN for b, c in zip(best, clear, strict=True)]
        scores = [float(total[i, b] / sums[i]) if c else 0.0 for i, (b, c) in enumerate(zip(best, clear, strict=True))]
        return names, scores


def sample(docs: DataFrame, *, key: str, text: str, label: str, seed: int = 3) -> pd.DataFrame:
    """Pieces of texts to learn from, in the driver: `piece` and `label`, bounded as described above."""
    known = docs.filter(F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = {r[label]: r["n"] for r in known.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return pd.DataFrame({"piece": [], "label": []})
    each = max(1, min(PER_LANGUAGE, MOST_TEXTS // len(counts)))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.octet_length(text)), F.lit(1 << 40))
    share = F.lit(0)
    for name, n in counts.items():
        share = F.when(F.col(label) == name, F.lit(int(min(1.0, (1.5 * each + 8) / n) * (1 << 40)))).otherwise(share)
    place = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.greatest(F.lit(1), F.length(text) - PIECE + 1)).cast("int") + 1
    picked = known.filter(draw <= share).select(draw.alias("draw"), F.substring(F.col(text), place, F.lit(PIECE)).alias("piece"), F.col(label).alias("label"))
    rows = picked.toPandas().sort_values(["label", "draw", "piece"], kind="stable")
    return rows.groupby("label").head(each)[["piece", "label"]].reset_index(drop=True)


def learn(rows: pd.DataFrame) -> Model | None:
    languages = sorted(rows["label"].unique())
    if not languages:
        return None
    made = [windows_of(piece)[0] for piece in rows["piece"]]
    labels = np.repeat(rows["label"].map({x: i for i, x in enumerate(languages)}).to_numpy(), [len(m) for m in made])
    return train(np.concatenate(made), labels, languages)


def _predict(model: Model | None):
    def run(batches: Iterator[tuple[pd.Series]]) -> Iterator[pd.DataFrame]:
        predictor = Predictor(model) if model else None
        for texts in batches:
            names, scores = predictor.texts(texts.to_list()) if predictor else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            yield pd.DataFrame({"lang_pred": names, "score": scores})
        release_memory()

    return F.pandas_udf(run, "lang_pred string, score double")


def identify(docs: DataFrame, model: Model | None, *, text: str = "text") -> DataFrame:
    """docs with `lang_pred` and `score`; columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score")
    said = free_name(docs, "_said")
    return docs.withColumn(said, _predict(model)(F.col(text))).select(*docs.columns, f"{said}.lang_pred", f"{said}.score")


def held_out(key: Column) -> Column:
    """Rows never learned from: CRC-32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def model_of(docs: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "lang") -> Model | None:
    return learn(sample(docs.filter(~held_out(F.col(key))), key=key, text=text, label=label))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = model_of(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
