"""Operator 7: exact top-k search by a three-phase uniform threshold.

A score is the sum of partial scores over PARTS slices of the dimensions; each block of vectors keeps a list of partial
scores for every slice. In the first phase each block takes the best k of each list, completes their scores, and gives
its k best totals; the k-th best of all blocks is a lower bound of the final k-th score. In the second, this cutoff
goes back to every block: an entry that is below cutoff / PARTS in every list has a sum below the cutoff, so only
entries that reach it in some list are collected. In the third, their scores are completed, and those that reach the
cutoff go into the final ranking. The argument needs no sign of the scores, and nothing is approximate.

Vectors are quantized integers and travel as packed blocks; queries are blocks, too, so that each task multiplies two
bounded matrices. Query blocks go to all of at most GROUPS groups of vector blocks, by a shuffle on both sides: a stated
query set against all rows, of which the driver gets nothing but two counts. Vectors
with components of SMALL or more have smaller blocks of their own; where products of two blocks could pass 2**53, they
are multiplied as Python integers.

Cases: a vector that is null or holds a null or non-finite component takes no part; a null id takes no part; rows of
equal id and vector are one candidate, and a query id with several vectors keeps the best over them; a row is never a
candidate of its own id; vectors of other lengths than the query's are no candidates; ties go to the smaller id; an
empty table gives no rows; only the named columns are read. Every finite vector takes part, however large. Scores are
ranked exactly while they have 38 digits at most; larger ones, which need components above 10**16, rank as the largest
number of 38 digits. The score column is a long: a score outside its range reads as the nearest long.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import share_package, written

PARTS = 2
ROWS_A_BLOCK, QUERIES_A_BLOCK = 4096, 512
#: Groups of vector blocks at most: every query block goes to each, so that this bounds how often queries are shuffled.
GROUPS = 64
#: Components from which a vector goes to a block of large ones, and rows of such a block.
SMALL, LARGE_ROWS = 2**21, 128
#: Scores travel as Spark's widest exact numbers.
SCORE, MOST = "decimal(38,0)", 10**38 - 1
LONG = 2**63 - 1


def quantized(embeddings: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """id, vector array<double> of the whole numbers floor(scale * x); only vectors that take part."""
    v = F.col(vector_col)
    sound = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))

    def whole(x: Column) -> Column:
        # From 2**53 on every double is whole; past the largest double a component stays the largest.
        y = F.greatest(F.least(F.lit(float(scale)) * x.cast("double"), F.lit(sys.float_info.max)), F.lit(-sys.float_info.max))
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)

    return embeddings.where(sound).select(F.col(id_col).cast("long").alias("id"), F.transform(v, whole).alias("vector"))


def packed(rows: DataFrame, most: int) -> DataFrame:
    """dims, ids, vectors: blocks of at most so many rows of one length and kind, in the order the rows lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pdf = batch.to_pandas()
            large = pdf["vector"].map(lambda v: bool(len(v)) and bool(np.abs(v).max() >= SMALL)).astype(bool)
            for (dims, big), part in pdf.groupby([pdf["vector"].map(len), large]):
                step = min(most, LARGE_ROWS) if big else most
                for start in range(0, len(part), step):
                    own = part.iloc[start : start + step]
                    block = np.stack(own["vector"].to_numpy()) if dims else np.zeros((len(own), 0))
                    yield pa.RecordBatch.from_pydict({"dims": pa.array([dims], pa.int32()), "ids": pa.array([own["id"].to_numpy(np.int64).tobytes()]), "vectors": pa.array([block.astype(np.float64).tobytes()])})

    return rows.mapInArrow(run, "dims int, ids binary, vectors binary")


def as_integers(block: np.ndarray) -> np.ndarray:
    """The same whole numbers as Python integers, which have no largest one."""
    return np.array([int(x) for x in block.ravel()], object).reshape(block.shape)


class Pair:
    """One block of queries against one block of vectors, as exact matrices of partial scores."""

    def __init__(self, row: dict):
        dims = row["dims"]
        self.qid, self.xid = np.frombuffer(row["qids"], np.int64), np.frombuffer(row["ids"], np.int64)
        q, x = (np.frombuffer(row[c], np.float64).reshape(len(i), dims) for c, i in (("qvectors", self.qid), ("vectors", self.xid)))
        cuts = [*range(0, dims, max(1, -(-dims // PARTS))), dims] if dims else [0, 0]
        # Sums of products of whole numbers are exact in any order below 2**53, and always as Python integers.
        if dims and float(np.abs(q).max()) * float(np.abs(x).max()) * dims >= 2.0**53:
            q, x = as_integers(q), as_integers(x)
        self.parts = [q[:, a:b].dot(x[:, a:b].T) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.own = self.qid[:, None] == self.xid[None, :]

    def complete(self, at: np.ndarray) -> np.ndarray:
        """Sums over all lists, where at is set; below everything elsewhere."""
        out = np.full(at.shape, -np.inf, self.parts[0].dtype)
        found = sum(p[at] for p in self.parts)
        out[at] = np.array([min(max(s, -MOST), MOST) for s in found], object) if found.dtype == object else found
        return out

    def heads(self, k: int) -> np.ndarray:
        """Entries among the best k of some list."""
        at = np.zeros(self.own.shape, bool)
        for p in self.parts:
            p = np.where(self.own, -np.inf, p)
            if p.shape[1] <= k:
                return ~self.own
            top = np.argsort(-p, axis=1)[:, :k] if p.dtype == object else np.argpartition(-p, k - 1, axis=1)[:, :k]
            np.put_along_axis(at, top, True, axis=1)
        return at & ~self.own

    def reach(self, cutoffs: list[Decimal | None]) -> tuple[np.ndarray, np.ndarray]:
        """Entries that reach their share of the query's cutoff in some list, and the cutoffs as numbers.

        Python integers have exact ones: shares are compared as multiples, since numbers of 38 digits have no half.
        """
        exact = self.parts[0].dtype == object
        cutoff = np.array([-np.inf if c is None else int(c) if exact else float(c) for c in cutoffs], object if exact else float)
        at = np.zeros(self.own.shape, bool)
        for p in self.parts:
            at |= (p * len(self.parts) >= cutoff[:, None]).astype(bool)
        return at & ~self.own, cutoff


def scores_array(scores: np.ndarray) -> pa.Array:
    if scores.dtype == object:
        return pa.array([Decimal(int(s)) for s in scores], pa.decimal128(38, 0))
    return pa.array(scores.astype(np.int64)).cast(pa.decimal128(38, 0))


#: Places of queries in their block, ids of vectors, scores.
Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


def best(entries: Entries, k: int) -> Entries:
    """The k best entries of each query, ties to the smaller id."""
    q, x, scores = entries
    if scores.dtype == object:
        order = np.array(sorted(range(len(q)), key=lambda i: (q[i], -scores[i], x[i])), np.int64)
    else:
        order = np.lexsort((x, -scores, q))
    q, x, scores = q[order], x[order], scores[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], x[keep], scores[keep]


def joined(a: Entries | None, b: Entries) -> Entries:
    if a is None:
        return b
    if object in (a[2].dtype, b[2].dtype):
        a, b = ((q, x, s if s.dtype == object else np.array([int(v) for v in s], object)) for q, x, s in (a, b))
    return tuple(np.concatenate(c) for c in zip(a, b, strict=True))


def walked(batches: Iterator[pa.RecordBatch], chosen: Callable[[dict, Pair], tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """The k best for each query of what is chosen (scores, and where) of pairs of blocks.

    Pairs of one query block lie one after another, and leave k rows a query together. What is held is that block's.
    """
    qids, held = None, None

    def rows() -> pa.RecordBatch:
        q, x, scores = held
        return pa.RecordBatch.from_pydict({"query_id": np.frombuffer(qids, np.int64)[q], "vec_id": x, "score": scores_array(scores)})

    for batch in batches:
        for row in batch.to_pylist():
            if qids is not None and row["qids"] != qids:
                yield rows()
                held = None
            qids, pair = row["qids"], Pair(row)
            scores, keep = chosen(row, pair)
            q, x = np.nonzero(keep)
            held = best(joined(held, (q, pair.xid[x], scores[q, x])), k)
    if qids is not None:
        yield rows()


def met(asks: DataFrame, blocks: DataFrame, groups: int) -> DataFrame:
    """Every query block beside every block of vectors of as many dimensions.

    Both sides are shuffled and merged: Spark takes the query blocks for as small as they are before they are repeated,
    and would pass all copies through the driver.
    """
    asks = asks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return asks.join(blocks.withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int")).hint("merge"), ["dims", "group"])


def top_k(embeddings: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every query, all if fewer. is_query: over id_col."""
    share_package(embeddings.sparkSession)
    rows = written(quantized(embeddings, scale, id_col, vector_col).distinct(), "topk-vectors")
    blocks = written(packed(rows, ROWS_A_BLOCK), "topk-blocks")
    asked = rows.join(embeddings.where(is_query).select(F.col(id_col).cast("long").alias("asked")).distinct(), F.col("id") == F.col("asked"), "left_semi")
    queries = written(packed(asked.repartition(1 + asked.count() // QUERIES_A_BLOCK, "id"), QUERIES_A_BLOCK), "topk-queries")
    groups = min(max(1, blocks.count()), GROUPS)
    asks = queries.select("dims", F.col("ids").alias("qids"), F.col("vectors").alias("qvectors"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chosen(row: dict, pair: Pair) -> tuple[np.ndarray, np.ndarray]:
            at = pair.heads(k)
            return pair.complete(at), at

        return walked(batches, chosen, k)

    local = met(asks, blocks, groups).mapInArrow(first, f"query_id long, vec_id long, score {SCORE}")
    nth = Window.partitionBy("query_id").orderBy(F.desc("score"))
    # Queries with fewer than k scores anywhere have no cutoff, nor have those whose k-th is below what a score can say.
    kth = local.withColumn("nth", F.row_number().over(nth)).where((F.col("nth") == k) & (F.col("score") > F.lit(str(-MOST)).cast(SCORE)))
    cutoffs = written(kth.select("query_id", F.col("score").alias("cutoff")), "topk-cutoffs")
    return _ranked(asks, blocks, groups, cutoffs, k)


def _ranked(asks: DataFrame, blocks: DataFrame, groups: int, cutoffs: DataFrame, k: int) -> DataFrame:
    """Second and third phase. The cutoffs go to every block beside the queries that they belong to."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids in batch.column("qids").to_pylist():
                own = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_pydict({"block": pa.array([ids] * len(own), pa.binary()), "place": np.arange(len(own)), "id": own})

    places = asks.select("qids").distinct().mapInArrow(explode, "block binary, place long, id long")
    listed = places.join(cutoffs, F.col("id") == F.col("query_id"), "left").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "cutoff"))).alias("cut"))
    # Cutoffs join the query blocks before these are repeated for the groups.
    given = met(asks.join(listed.hint("merge"), F.col("qids") == F.col("block")).drop("block"), blocks, groups)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chosen(row: dict, pair: Pair) -> tuple[np.ndarray, np.ndarray]:
            at, cutoff = pair.reach([c["cutoff"] for c in row["cut"]])
            scores = pair.complete(at)
            return scores, at & (scores >= cutoff[:, None]).astype(bool)

        return walked(batches, chosen, k)

    found = given.mapInArrow(second, f"query_id long, vec_id long, score {SCORE}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    score = F.greatest(F.least("score", F.lit(LONG).cast(SCORE)), F.lit(-LONG - 1).cast(SCORE)).cast("long")
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))
