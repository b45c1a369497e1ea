"""Bootstrap replicates as matrices: a batch of rows draws its weights for all replicates at once and leaves only sums.

A replicate draws each cluster a Poisson number of times of mean 1, which a hash of cluster and replicate gives. No row
is repeated for a replicate, and nothing is shuffled but one row of sums for each task and replicate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.staging import share_package

#: Probabilities that a Poisson variable of mean 1 is at most 0, 1, 2 and so on.
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(9)]
#: Rows whose weights are held at a time.
ROWS = 1024


def scrambled(x: np.ndarray) -> np.ndarray:
    """A 32-bit hash of whole numbers in plain 64-bit arithmetic, so that other engines can work it out alike."""
    z = np.asarray(x).astype(np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF)
    for shift, factor in ((15, 0x2C1B3C6D), (12, 0x297A2D39)):
        z = ((z ^ (z >> np.uint64(shift))) * np.uint64(factor)) & np.uint64(0xFFFFFFFF)
    return z ^ (z >> np.uint64(15))


def weights(clusters: np.ndarray, replicates: int) -> np.ndarray:
    """How often each replicate (column) draws each cluster (row)."""
    each = scrambled(np.arange(1, replicates + 1))
    x = scrambled((scrambled(clusters)[:, None] ^ each[None, :]).ravel()).reshape(len(clusters), replicates)
    out = np.zeros(x.shape, np.uint8)
    for p in POISSON:
        out += x >= np.uint64(math.ceil(p * 2**32))
    return out


def number(df: DataFrame, cluster: str) -> Column:
    """A whole number for each cluster: itself, or a hash of what isn't one."""
    kind = df.schema[cluster].dataType.simpleString()
    return F.col(cluster).cast("long") if kind in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(cluster)


def replicate_sums(df: DataFrame, cluster: str, columns: dict[str, Column], replicates: int) -> DataFrame:
    """replicate and the sum of each column over what the replicate draws; missing values count 0, null clusters aren't drawn."""
    share_package(df.sparkSession)
    names = list(columns)
    values = [F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"v{i}") for i, c in enumerate(columns.values())]
    rows = df.where(F.col(cluster).isNotNull()).select(number(df, cluster).alias("c"), *values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((replicates, len(names))), False
        for batch in batches:
            c, v = batch.column("c").to_numpy(), np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(names))])
            for start in range(0, len(c), ROWS):
                total += weights(c[start : start + ROWS], replicates).T.astype(float) @ v[start : start + ROWS]
            some |= len(c) > 0
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), *[pa.array(np.ascontiguousarray(t)) for t in total.T]], ["replicate", *[f"v{i}" for i in range(len(names))]])

    found = rows.mapInArrow(run, "replicate long, " + ", ".join(f"v{i} double" for i in range(len(names))))
    return found.groupBy("replicate").agg(*[F.sum(f"v{i}").alias(n) for i, n in enumerate(names)])


class Segments:
    """Sums of runs of equal scores, walked in order of group and score.

    A task sees a range of the order. Scores inside it are complete and are added up at once; the first and the last
    score of a group may go on in a neighbour's range and are kept apart, as segments of their own.
    """

    def __init__(self, replicates: int):
        self.replicates = replicates
        self.out: list[tuple] = []
        self.group: int | None = None

    def begin(self, group: int, score: float) -> None:
        zero = lambda: np.zeros(self.replicates)
        self.group, self.first, self.score, self.several = group, score, score, False
        self.p, self.q, self.mid = zero(), zero(), (zero(), zero(), zero())

    def end(self) -> None:
        if self.group is not None:
            self.out.append((self.group, self.score, 0, self.p, self.q, np.zeros(self.replicates)))
            if self.several:
                self.out.append((self.group, self.first, 1, *self.mid))
        self.group = None

    def add(self, group: int, scores: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
        """Distinct scores in order, with their drawn positives and negatives by replicate."""
        if self.group != group:
            self.end()
            self.begin(group, scores[0])
        if scores[0] == self.score or (np.isnan(scores[0]) and np.isnan(self.score)):
            self.p, self.q = self.p + p[0], self.q + q[0]
            scores, p, q = scores[1:], p[1:], q[1:]
        if not len(scores):
            return
        # What was current is complete, and so are all new ones but the last.
        if not self.several:
            self.out.append((group, self.score, 0, self.p, self.q, np.zeros(self.replicates)))
            done_p, done_q, self.several = p[:-1], q[:-1], True
        else:
            done_p, done_q = np.vstack([self.p[None], p[:-1]]), np.vstack([self.q[None], q[:-1]])
        mid_p, mid_q, u = self.mid
        if len(done_p):
            before = mid_q[None] + np.cumsum(done_q, axis=0) - done_q
            self.mid = mid_p + done_p.sum(axis=0), mid_q + done_q.sum(axis=0), u + (done_p * (before + done_q / 2)).sum(axis=0)
        self.score, self.p, self.q = scores[-1], p[-1], q[-1]


def replicate_auc(df: DataFrame, groups: list[str], cluster: str, label: str, score: str, replicates: int) -> DataFrame:
    """groups, replicate, n_positive, n_negative, auc of every replicate; auc is null where one has a single class.

    Scores are dealt by range, ties over several tasks if they are many, and ties count half.
    """
    share_package(df.sparkSession)
    rows = df.where(F.col(cluster).isNotNull() & F.col(score).isNotNull() & F.col(label).isin(0, 1))
    names = {g: f"_g{i}" for i, g in enumerate(groups)}
    # Groups are few: labels and arms. Each gets a number.
    ids = rows.select(*groups).distinct().collect() if groups else [()]
    ids = sorted((tuple(r) for r in ids), key=repr)
    which = F.lit(0)
    for n, values in enumerate(ids):
        same = F.lit(True)
        for g, v in zip(groups, values, strict=True):
            same &= F.col(g).eqNullSafe(F.lit(v))
        which = F.when(same, n).otherwise(which) if groups else F.lit(0)
    rows = rows.select(which.cast("int").alias("g"), F.col(score).cast("double").alias("s"), number(df, cluster).alias("c"), F.col(label).cast("int").alias("y"))
    rows = rows.repartitionByRange("g", "s", "c").sortWithinPartitions("g", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Segments(replicates)

        def written() -> Iterator[pa.RecordBatch]:
            for g, s, kind, p, q, u in walk.out:
                fixed = [pa.array([x] * replicates, t) for x, t in ((g, pa.int32()), (s, pa.float64()), (kind, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(np.arange(replicates)), *[pa.array(x) for x in (p, q, u)]], ["g", "s", "kind", "replicate", "p", "q", "u"])
            walk.out.clear()

        for batch in batches:
            g, s, c, y = (batch.column(n).to_numpy() for n in ("g", "s", "c", "y"))
            for start in range(0, len(g), ROWS):
                own = slice(start, start + ROWS)
                w = weights(c[own], replicates).astype(np.int32)
                fresh = np.r_[True, (np.diff(g[own]) != 0) | ~((s[own][1:] == s[own][:-1]) | (np.isnan(s[own][1:]) & np.isnan(s[own][:-1])))]
                at = np.flatnonzero(fresh)
                p, q = (np.add.reduceat(w * (y[own] == side)[:, None], at, axis=0).astype(float) for side in (1, 0))
                edges = np.r_[0, np.flatnonzero(np.diff(g[own][at])) + 1, len(at)]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    walk.add(int(g[own][at[a]]), s[own][at[a:b]], p[a:b], q[a:b])
                yield from written()
        walk.end()
        yield from written()

    found = rows.mapInArrow(run, "g int, s double, kind int, replicate long, p double, q double, u double")
    found = found.groupBy("g", "replicate", "s", "kind").agg(*[F.sum(x).alias(x) for x in "pqu"])
    earlier = Window.partitionBy("g", "replicate").orderBy("s", "kind").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("before", F.coalesce(F.sum("q").over(earlier), F.lit(0.0)))
    wins = F.col("u") + F.col("p") * F.col("before") + F.when(F.col("kind") == 0, F.col("p") * F.col("q") / 2).otherwise(0.0)
    total = found.groupBy("g", "replicate").agg(F.sum("p").alias("n_positive"), F.sum("q").alias("n_negative"), F.sum(wins).alias("wins"))
    both = F.col("n_positive") * F.col("n_negative")
    out = [F.when(both > 0, F.try_divide("wins", both)).alias("auc"), *[F.col(n).cast("long").alias(n) for n in ("n_positive", "n_negative")]]
    keys = []
    for i, g in enumerate(groups):
        value = F.lit(None).cast(df.schema[g].dataType)
        for n, values in enumerate(ids):
            value = F.when(F.col("g") == n, F.lit(values[i])).otherwise(value)
        keys.append(value.cast(df.schema[g].dataType).alias(names[g]))
    return total.select(*keys, "replicate", *out).select(*[F.col(names[g]).alias(g) for g in groups], "replicate", "n_positive", "n_negative", "auc")
