"""Operator 3: toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document's features are the distinct hashed character n-grams of its whole text. On a bounded, hash-chosen sample of
labelled rows (PER_CLASS rows of each label, one text of each id), each feature gets the log of the ratio of its smoothed document counts
under the two labels; a logistic regression with an L2 penalty is fitted on the features so scaled. The fit is one
task over the bounded sample, whose rows take BUCKETS / 8 bytes each at most, 131 MB in all; scoring is a map over all rows with one weight a feature (BUCKETS floats, broadcast).

Cases: null and empty texts have no features and get the score of the intercept; rows with a null id are scored, not
learned from; repeated rows get repeated results; an empty table gives no rows; without labels of both kinds every
score is 0.5; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import in_pieces, share_package

BUCKETS = 1 << 18
SIZES = (3, 4, 5)
#: Most labelled rows of each label that the fit uses: the documented bound of the training sample.
PER_CLASS = 2_000


class Grams:
    """Distinct hashed n-grams of texts. One instance a task: it keeps a scratch table."""

    def __init__(self):
        self.slot = np.zeros(BUCKETS, np.int64)

    def hashed(self, texts: list[str]) -> list[np.ndarray]:
        """One array of distinct buckets for each text; A-Z count as a-z, runs of blanks as one."""
        out = []
        for start, end in in_pieces(texts):
            for text in texts[start:end]:
                code = np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
                found = [self._hash(code, n) for n in SIZES if len(code) >= n]
                out.append(self._distinct(np.concatenate(found)) if found else np.zeros(0, np.int32))
        return out

    @staticmethod
    def _hash(code: np.ndarray, n: int) -> np.ndarray:
        h = np.full(len(code) - n + 1, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) ^ code[i : len(code) - n + 1 + i]
        h *= np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(46)).astype(np.int32)

    def _distinct(self, h: np.ndarray) -> np.ndarray:
        at = np.arange(len(h))
        self.slot[h] = at
        return h[self.slot[h] == at]


def packed(grams: np.ndarray) -> bytes:
    """A row's buckets as 32-bit integers, or as one bit a bucket where that is shorter: BUCKETS / 8 bytes at most."""
    if 4 * len(grams) < BUCKETS // 8:
        return np.sort(grams).astype(np.int32).tobytes()
    bits = np.zeros(BUCKETS, bool)
    bits[grams] = True
    return np.packbits(bits).tobytes()


def unpacked(row: bytes) -> np.ndarray:
    return np.frombuffer(row, np.int32) if len(row) < BUCKETS // 8 else np.flatnonzero(np.unpackbits(np.frombuffer(row, np.uint8)))


def portions(rows: list[bytes]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Ranges of rows with about a million buckets each: the range, its buckets, and each row's number of them."""
    start, found, total = 0, [], 0
    for i, row in enumerate(rows):
        found.append(unpacked(row))
        total += len(found[-1])
        if total >= 1_000_000 or i + 1 == len(rows):
            yield slice(start, i + 1), np.concatenate(found), np.array([len(f) for f in found])
            start, found, total = i + 1, [], 0


def fit(rows: list[bytes], labels: np.ndarray, rounds: int = 150, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights for every bucket, the ratio included, and the intercept.

    Rows stay packed, and only one portion of them is open at a time, so that memory is bounded by the number of rows,
    whatever the length of their texts.
    """
    positive = labels == 1
    if positive.all() or not positive.any():
        return np.zeros(BUCKETS, np.float32), 0.0
    p, q = np.ones(BUCKETS), np.ones(BUCKETS)
    for part, column, lengths in portions(rows):
        of = np.repeat(positive[part], lengths)
        p += np.bincount(column[of], minlength=BUCKETS)
        q += np.bincount(column[~of], minlength=BUCKETS)
    ratio = np.log(p / (positive.sum() + 2.0)) - np.log(q / ((~positive).sum() + 2.0))
    # n-grams that both labels use alike have a ratio near 0 and say nothing; the fit leaves them out.
    ratio[np.abs(ratio) < 0.5] = 0
    squares = np.zeros(len(rows))
    for i, row in enumerate(rows):
        own = unpacked(row)
        own = own[ratio[own] != 0]
        rows[i] = packed(own)
        squares[i] = (ratio[own] ** 2).sum()
    balance = np.where(positive, 0.5 / positive.sum(), 0.5 / (~positive).sum())
    weight, bias, target = np.zeros(BUCKETS), 0.0, positive.astype(float)
    # Nesterov's accelerated gradient; the step follows the largest row's squared length.
    step = 4.0 / (1.0 + squares.max() * 0.5)
    ahead, ahead_bias, momentum = weight.copy(), bias, 1.0
    # What few buckets leave open is kept open; more is opened anew each round.
    opened = list(portions(rows)) if sum(map(len, rows)) <= 40_000_000 and all(len(r) < BUCKETS // 8 for r in rows) else None
    for _ in range(rounds):
        scaled, slope, total = ahead * ratio, np.zeros(BUCKETS), 0.0
        for part, column, lengths in opened or portions(rows):
            row = np.repeat(np.arange(len(lengths)), lengths)
            margin = np.bincount(row, scaled[column], minlength=len(lengths)) + ahead_bias
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target[part]) * balance[part]
            slope += np.bincount(column, error[row], minlength=BUCKETS)
            total += error.sum()
        new = ahead - step * (slope * ratio + penalty * ahead)
        new_bias = ahead_bias - step * total
        next_momentum = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        beta = (momentum - 1) / next_momentum
        ahead, ahead_bias = new + beta * (new - weight), new_bias + beta * (new_bias - bias)
        weight, bias, momentum = new, new_bias, next_momentum
    return (weight * ratio).astype(np.float32), float(bias)


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, learn_from: Column, per_class: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """At most per_class rows of each label, the lowest by a hash of the id, with their texts."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & learn_from)
    known = known.groupBy("id").agg(F.max("label").alias("label")).withColumn("key", F.xxhash64("id"))
    chosen = [known.where(F.col("label") == y).orderBy("key", "id").limit(per_class) for y in (0, 1)]
    ids = chosen[0].union(chosen[1]).select(F.col("id").alias("of"), "label")
    # Bounded by 2 * per_class ids, so that a broadcast is safe and the texts of other rows never move.
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(ids), F.col("id") == F.col("of"))
    return found.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("id", "text", "label")


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, float]:
    """The fitted weights and intercept. learn_from: which rows of labels may be learned from, over a column named id."""
    share_package(docs.sparkSession)
    sample = training_rows(docs, labels, learn_from, per_class, id_col, text_col, label_col)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            rows = [packed(g) for g in grams.hashed(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), pa.array(rows, pa.binary()), batch.column("label")], ["id", "grams", "label"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = {(i, g): y for batch in batches for i, g, y in zip(*(batch.column(c).to_pylist() for c in ("id", "grams", "label")), strict=True)}
        if rows:
            keys = sorted(rows)
            labels = np.array([rows[k] for k in keys])
            del rows
            packs = [g for _, g in keys]
            del keys
            weight, bias = fit(packs, labels)
            yield pa.RecordBatch.from_pydict({"weight": pa.array([weight.tobytes()], pa.binary()), "bias": [bias]})

    rows = sample.mapInArrow(features, "id string, grams binary, label int")
    found = rows.repartition(1).mapInArrow(fitted, "weight binary, bias double").collect()
    if not found:
        return np.zeros(BUCKETS, np.float32), 0.0
    return np.frombuffer(found[0]["weight"], np.float32), found[0]["bias"]


def score(docs: DataFrame, weight: np.ndarray, bias: float, text_col: str = "text", name: str = "score") -> DataFrame:
    """The rows of docs with a score from 0 to 1."""
    model = docs.sparkSession.sparkContext.broadcast((weight, bias))

    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grams, (w, b) = Grams(), model.value
        for texts in parts:
            margin = np.array([w[g].sum() + b for g in grams.hashed(texts.tolist())], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(margin, -30, 30))))

    return docs.withColumn(name, of(F.coalesce(F.col(text_col), F.lit(""))))


def toxicity(docs: DataFrame, labels: DataFrame, cutoff: float = 0.7, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score, predicted for every row; rows held out are never learned from."""
    weight, bias = train(docs, labels, ~held_out(F.col("id")), per_class, id_col, text_col)
    rows = docs.select(F.col(id_col), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).alias("_text"))
    scored = score(rows, weight, bias, "_text")
    return scored.select(id_col, "held_out", "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, cutoff: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that score below the cutoff."""
    weight, bias = train(docs, labels, ~held_out(F.col("id")), PER_CLASS, id_col, text_col)
    return score(docs, weight, bias, text_col, "_toxicity").where(F.col("_toxicity") < cutoff).select(*docs.columns)
