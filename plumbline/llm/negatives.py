"""Operator 12: hard-negative mining by a Voronoi-partition distributed nearest-neighbour join.

The largest inner product is the nearest neighbour once every row gets one more component, sqrt(M**2 - |x|**2) with M the
largest norm, and every anchor a zero: the squared distance is then |a|**2 + M**2 - 2 * score. Rows are assigned to the
nearest of a few pivots, and lie in blocks of one pivot, in order of their distance to it, so that a block is a ring.
Anchors form groups of neighbours that know their least and greatest distance to every pivot. The triangle inequality
bounds the distances between a group and a ring on both sides, and a ring goes only to groups that it may serve:

* Positives. For each label of a group, the few rows of that label nearest to each pivot bound how far the k-th best of
  any anchor can be; a ring serves the group if it holds the label, unless all of it is farther.
* Negatives. A positive's score gives the interval of scores that its negatives must have, which is an interval of
  distances; a ring serves the group unless all of it is outside the hull of the group's intervals.

What serves a group meets it in bounded chunks, one grouped task each, where the join is exact, over integer scores; the
chunks' best are ranked at the end. Rows of equal id, label and vector lie side by side in their ring and count once;
rows that share an id only count apart.

Cases: rows with a null id or label, a null vector, or a null or non-finite component take no part; neither do vectors
of another length than most (of equally frequent lengths, than the longest). Labels are whole numbers. A row is never a
partner of its own id; an anchor id with several rows is one anchor for each of them; ties go to the smaller id; an empty
table gives no rows; other columns are not read. Scores are compared exactly up to 38 digits, and read as the nearest
long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import share_package, written

#: Rows for each pivot, and most pivots: their distances to one another and to every group are small tables.
ROWS_A_PIVOT, MOST_PIVOTS = 4096, 256
ROWS_A_BLOCK, ANCHORS_A_GROUP, BLOCKS_A_CHUNK = 2048, 512, 16
HEADS = pa.list_(pa.struct({"label": pa.int64(), "id": pa.int64(), "far": pa.float64()}))
#: Distances are floating point numbers: what bounds rule out must be farther by this share of M.
SLACK = 1e-6
#: Scores travel as Spark's widest exact numbers.
SCORE, MOST = "decimal(38,0)", 10**38 - 1
LONG = 2**63 - 1


def packed_vector(v: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of three widths, told apart by their length."""
    most = np.abs(v).max(initial=0)
    return v.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64).tobytes()


def opened(raw: list[bytes], dims: int) -> np.ndarray:
    """Rows of packed vectors as one matrix of doubles."""
    kinds = {2 * dims: np.int16, 4 * dims: np.int32, 8 * dims: np.float64}
    if len({len(r) for r in raw}) <= 1:
        return np.frombuffer(b"".join(raw), kinds[len(raw[0])] if raw and dims else np.float64).reshape(len(raw), dims).astype(np.float64)
    return np.stack([np.frombuffer(r, kinds[len(r)]).astype(np.float64) for r in raw])


def scored(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as doubles or, where a hundredfold could pass 2**53, Python integers."""
    if 100.0 * float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * a.shape[1] >= 2.0**53:
        a, x = (np.array([int(c) for c in m.ravel()], object).reshape(m.shape) for m in (a, x))
    return a.dot(x.T)


def best(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best allowed entries of every row and of what ties with the k-th."""
    held = np.where(allowed, scores, -np.inf)
    if held.shape[1] > k:
        if held.dtype == object:
            kth = np.array([sorted(row, reverse=True)[k - 1] for row in held], object)
        else:
            kth = np.partition(held, held.shape[1] - k, axis=1)[:, -k]
        allowed = allowed & (held >= kth[:, None]).astype(bool)
    row, column = np.nonzero(allowed)
    return cut(row, scores[row, column], ids[column], column, k)


def cut(row: np.ndarray, score: np.ndarray, ids: np.ndarray, column: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k of each row by score, then id."""
    if score.dtype == object:
        order = np.array(sorted(range(len(row)), key=lambda i: (row[i], -score[i], ids[i])), np.int64)
    else:
        order = np.lexsort((ids, -score, row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


class Space:
    """The rows of an embedding table, in rings around pivots, and the anchors, in groups."""

    def __init__(self, rows: DataFrame, is_anchor: Column, dims: int, heads: int, pivots: int | None = None):
        """rows: id, label, vector array<double> of whole numbers; is_anchor: over id; heads: ids a ring names of each label."""
        self.dims, self.heads = dims, heads
        norms = rows.select(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x).alias("norm"))
        many, most = norms.agg(F.count(F.lit(1)), F.max("norm")).first()
        self.most = float(most or 0.0)
        self.lifted = lifting(self.most)
        count = pivots or max(1, min(MOST_PIVOTS, many // ROWS_A_PIVOT))
        drawn = rows.select(F.xxhash64("id", "vector").alias("key"), "vector").orderBy("key").limit(count).collect()
        self.pivots = self._chained(self.lifted(np.array([r["vector"] for r in drawn], float).reshape(len(drawn), dims)))
        placed = self._placed(rows)
        self.rings = written(self._rings(placed), "negatives-rings")
        # Anchors are few and spread over the table: each group of neighbours is a run of them in order of their pivot.
        self.anchors = written(self._groups(placed.where(is_anchor)), "negatives-anchors")

    @staticmethod
    def _chained(pivots: np.ndarray) -> np.ndarray:
        """Each pivot followed by the nearest of those left, so that neighbours in order are neighbours in space."""
        left, order = list(range(1, len(pivots))), [0][: len(pivots)]
        while left:
            d = ((pivots[left] - pivots[order[-1]]) ** 2).sum(axis=1)
            order.append(left.pop(int(d.argmin())))
        return pivots[order]

    def _placed(self, rows: DataFrame) -> DataFrame:
        """id, label, vector (packed), pivot (the nearest), far (its distance)."""
        pivots, dims, lifted = self.pivots, self.dims, self.lifted

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
                pivot, far = np.zeros(len(flat), np.int32), np.zeros(len(flat))
                for start in range(0, len(flat), 2048):
                    d = distances(lifted(flat[start : start + 2048]), pivots)
                    pivot[start : start + 2048] = d.argmin(axis=1)
                    far[start : start + 2048] = d.min(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([packed_vector(v) for v in flat], pa.binary()), pa.array(pivot), pa.array(far)], ["id", "label", "vector", "pivot", "far"])

        return written(rows.mapInArrow(run, "id long, label long, vector binary, pivot int, far double"), "negatives-placed")

    def _rings(self, placed: DataFrame) -> DataFrame:
        """ring, pivot, low, high (distances to the pivot), heads, ids, labels, vectors: rows of one pivot in order of distance.

        heads: of each label, the few ids nearest to the pivot.
        """
        most = self.heads
        order = ["pivot", "far", "id", "label", "vector"]
        sorted_rows = placed.repartitionByRange(*order).sortWithinPartitions(*order)

        def block(ring: int, own: pa.Table) -> pa.RecordBatch:
            ids, labels, far = (own.column(c).to_numpy() for c in ("id", "label", "far"))
            first = pd.DataFrame({"label": labels, "id": ids, "far": far}).drop_duplicates(["label", "id"]).groupby("label").head(most)
            data = {"ring": [ring], "pivot": pa.array([own.column("pivot")[0].as_py()], pa.int32()), "low": [far.min()], "high": [far.max()]}
            data |= {"heads": pa.array([first.to_dict("records")], HEADS), "ids": [ids.tobytes()], "labels": [labels.tobytes()]}
            return pa.RecordBatch.from_pydict(data | {"vectors": pa.array([own.column("vector").to_pylist()], pa.list_(pa.binary()))})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ring, last, held = TaskContext.get().partitionId() << 32, None, None
            for batch in batches:
                pdf = batch.to_pandas()
                key = list(zip(pdf["id"], pdf["label"], pdf["vector"], strict=True))
                fresh = np.array([k != before for k, before in zip(key, [last, *key[:-1]], strict=True)], bool)
                last = key[-1] if key else last
                table = pa.Table.from_batches([batch]).filter(pa.array(fresh))
                held = table if held is None else pa.concat_tables([held, table])
                pivot = held.column("pivot").to_numpy()
                # Blocks that can't grow any more go out: full ones, and those before the last pivot.
                edges = np.r_[np.flatnonzero(np.diff(pivot)) + 1, len(pivot)] if len(pivot) else np.zeros(0, int)
                start = 0
                for end in edges:
                    while end - start >= ROWS_A_BLOCK or (end < len(pivot) and end > start):
                        stop = min(end, start + ROWS_A_BLOCK)
                        yield block(ring, held.slice(start, stop - start))
                        ring, start = ring + 1, stop
                held = held.slice(start)
            if held is not None and held.num_rows:
                yield block(ring, held)

        return sorted_rows.mapInArrow(run, "ring long, pivot int, low double, high double, heads array<struct<label: long, id: long, far: double>>, ids binary, labels binary, vectors array<binary>")

    def _groups(self, anchors: DataFrame) -> DataFrame:
        """group, id, label, vector, norm, reach (distances to all pivots) of every anchor."""
        many = anchors.count()
        order = ["pivot", "far", "id", "label", "vector"]
        sorted_rows = anchors.repartitionByRange(1 + many // (8 * ANCHORS_A_GROUP), *order).sortWithinPartitions(*order)
        pivots, dims, limit = self.pivots, self.dims, ANCHORS_A_GROUP

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, seen, last = TaskContext.get().partitionId() << 32, 0, None
            for batch in batches:
                vectors = batch.column("vector").to_pylist()
                key = list(zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), vectors, strict=True))
                fresh = np.array([k != before for k, before in zip(key, [last, *key[:-1]], strict=True)], bool)
                last = key[-1] if key else last
                flat = opened(vectors, dims)
                reach = distances(np.c_[flat, np.zeros(len(flat))], pivots)
                group = first + (seen + np.cumsum(fresh) - 1) // limit
                seen += int(fresh.sum())
                columns = [pa.array(group, pa.int64()), batch.column("id"), batch.column("label"), batch.column("vector"), pa.array((flat * flat).sum(axis=1)), pa.array(list(reach), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["group", "id", "label", "vector", "norm", "reach"]).filter(pa.array(fresh))

        return sorted_rows.mapInArrow(run, "group long, id long, label long, vector binary, norm double, reach array<double>")

    def served(self, spans: DataFrame, anchors: DataFrame, join: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """What the exact join finds for every group in the rings that may serve it.

        spans: group, near, far: the distances from its anchors that matter, and maybe label: those to rows of that label;
        join: over a chunk's anchors and rings.
        """
        slack = SLACK * (1 + self.most**0.5)
        reach = self.anchors.select("group", F.posexplode("reach").alias("pivot", "d")).groupBy("group", "pivot").agg(F.min("d").alias("least"), F.max("d").alias("greatest"))
        heads = self.rings.select("ring", "pivot", "low", "high", F.col("heads.label").alias("labelled"))
        may = (F.col("least") - F.col("high") <= F.col("far") + slack) & (F.col("low") - F.col("greatest") <= F.col("far") + slack) & (F.col("greatest") + F.col("high") >= F.col("near") - slack)
        if "label" in spans.columns:
            heads = heads.withColumn("label", F.explode(F.array_distinct("labelled"))).drop("labelled")
            pairs = spans.join(heads, "label").join(reach, ["group", "pivot"]).where(may).select("group", "ring").distinct()
        else:
            pairs = reach.join(spans, "group").join(heads, "pivot").where(may).select("group", "ring")
        chunks = max(1, -(-self.rings.count() // BLOCKS_A_CHUNK))
        pairs = written(pairs.withColumn("chunk", F.pmod(F.xxhash64("ring"), F.lit(chunks)).cast("int")), "negatives-pairs")
        candidates = pairs.join(self.rings, "ring").select(F.col("group").alias("of_group"), F.col("chunk").alias("of_chunk"), "ids", "labels", "vectors")
        asked = anchors.join(pairs.select("group", "chunk").distinct(), "group")
        return asked.groupBy("group", "chunk").cogroup(candidates.groupBy("of_group", "of_chunk")).applyInArrow(join, schema)

    def positives(self, k: int) -> DataFrame:
        """id, label, vector, positive, score: the k best other rows of each anchor's own label, all if fewer."""
        # Of the k + 1 ids of a label nearest to each pivot, whatever anchor asks, one at most is its own.
        first = self.rings.select("pivot", F.explode("heads").alias("h")).select("pivot", "h.*")
        nearest = Window.partitionBy("pivot", "label").orderBy("far", "id")
        first = first.withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= k + 1).select("pivot", "label", F.col("id").alias("of"), "far")
        wide = self.anchors.select("group", "label", F.posexplode("reach").alias("pivot", "d")).groupBy("group", "label", "pivot").agg(F.max("d").alias("greatest"))
        bound = wide.join(first, ["pivot", "label"]).groupBy("group", "label", "of").agg(F.min(F.col("greatest") + F.col("far")).alias("bound"))
        nth = Window.partitionBy("group", "label").orderBy("bound")
        bound = bound.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") == k + 1).select("group", "label", "bound")
        # A label with fewer ids has no bound: every ring that holds it serves it.
        spans = self.anchors.select("group", "label").distinct().join(bound, ["group", "label"], "left")
        spans = spans.select("group", "label", F.lit(0.0).alias("near"), F.coalesce("bound", F.lit(float("inf"))).alias("far"))
        dims = self.dims

        def join(asked: pa.Table, rings: pa.Table) -> pa.Table:
            anchor, label = (asked.column(c).to_numpy() for c in ("id", "label"))
            a, found = opened(asked.column("vector").to_pylist(), dims), []
            for ids, labels, x in ring_rows(rings, dims):
                scores = scored(a, x)
                allowed = (label[:, None] == labels[None, :]) & (anchor[:, None] != ids[None, :])
                row, column = best(scores, allowed, ids, k)
                found.append((row, scores[row, column], ids[column]))
            row, score, ids = merged(found, k)
            return asked.select(["id", "label", "vector"]).take(pa.array(row)).append_column("positive", pa.array(ids)).append_column("score", as_decimals(score))

        found = self.served(written(spans, "negatives-spans"), self.anchors.select("group", "id", "label", "vector"), join, f"id long, label long, vector binary, positive long, score {SCORE}")
        rank = Window.partitionBy("id", "label", "vector").orderBy(F.desc("score"), "positive")
        found = found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
        return written(found.drop("rank"), "negatives-positives")

    def negatives(self, positives: DataFrame, k: int, low: int, high: int) -> DataFrame:
        """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
        listed = positives.groupBy("id", "label", "vector").agg(F.sort_array(F.collect_list(F.struct("score", "positive"))).alias("own"))
        anchors = self.anchors.join(listed, ["id", "label", "vector"])
        # Positives below 0 leave no score that is between low and high hundredths of theirs.
        useful = F.filter("own", lambda p: p["score"] >= 0)
        anchors = written(anchors.withColumn("own", useful).where(F.size("own") > 0).drop("reach"), "negatives-asked")

        def at(score: Column) -> Column:
            return F.sqrt(F.greatest(F.col("norm") + F.lit(self.most) - 2 * score, F.lit(0.0)))

        scores = [F.element_at("own", i)["score"].cast("double") / 100 for i in (-1, 1)]
        spans = anchors.groupBy("group").agg(F.min(at(scores[0] * high)).alias("near"), F.max(at(scores[1] * low)).alias("far"))
        dims = self.dims

        def join(asked: pa.Table, rings: pa.Table) -> pa.Table:
            anchor, label, own = asked.column("id").to_numpy(), asked.column("label").to_numpy(), [[(int(p["score"]), p["positive"]) for p in o] for o in asked.column("own").to_pylist()]
            a = opened(asked.column("vector").to_pylist(), dims)
            most = max(map(len, own), default=0)
            found: list[list] = [[] for _ in range(most)]
            for ids, labels, x in ring_rows(rings, dims):
                scores = scored(a, x)
                apart = (label[:, None] != labels[None, :]) & (anchor[:, None] != ids[None, :])
                hundred = 100 * scores
                for n in range(most):
                    having = np.array([i for i, o in enumerate(own) if len(o) > n])
                    positive = np.array([own[i][n][0] for i in having], object if scores.dtype == object else float)[:, None]
                    allowed = apart[having] & (hundred[having] >= low * positive).astype(bool) & (hundred[having] <= high * positive).astype(bool)
                    row, column = best(scores[having], allowed, ids, k)
                    found[n].append((having[row], scores[having[row], column], ids[column]))
            parts = []
            for n in range(most):
                row, score, ids = merged(found[n], k)
                chosen = [own[i][n] for i in row]
                part = asked.select(["id", "label", "vector"]).take(pa.array(row))
                more = {"positive_id": pa.array([c[1] for c in chosen], pa.int64()), "negative_id": pa.array(ids), "positive_score": as_decimals(np.array([c[0] for c in chosen], object)), "negative_score": as_decimals(score)}
                for name, column in more.items():
                    part = part.append_column(name, column)
                parts.append(part)
            return pa.concat_tables(parts)

        schema = f"id long, label long, vector binary, positive_id long, negative_id long, positive_score {SCORE}, negative_score {SCORE}"
        found = self.served(written(spans, "negatives-spans"), anchors.select("group", "id", "label", "vector", "own"), join, schema)
        rank = Window.partitionBy("id", "label", "vector", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
        ranked = found.withColumn("rank", F.row_number().over(rank).cast("int")).where(F.col("rank") <= k)

        def as_long(c: str) -> Column:
            return F.greatest(F.least(c, F.lit(LONG).cast(SCORE)), F.lit(-LONG - 1).cast(SCORE)).cast("long").alias(c)

        return ranked.select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", as_long("positive_score"), as_long("negative_score"))


def lifting(most: float) -> Callable[[np.ndarray], np.ndarray]:
    """Gives vectors the component that makes them all as long as the longest."""
    return lambda v: np.c_[v, np.sqrt(np.maximum(most - (v * v).sum(axis=1), 0))]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a.dot(b.T), 0))


def ring_rows(rings: pa.Table, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and vectors of one ring after the other."""
    for ids, labels, vectors in zip(*(rings.column(c) for c in ("ids", "labels", "vectors")), strict=True):
        yield np.frombuffer(ids.as_py(), np.int64), np.frombuffer(labels.as_py(), np.int64), opened(vectors.as_py(), dims)


def merged(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of every anchor over several rings."""
    if not found:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    row, score, ids = (np.concatenate([f[i] for f in found]) for i in range(3))
    row, at = cut(row, score, ids, np.arange(len(row)), k)
    return row, score[at], ids[at]


def as_decimals(score: np.ndarray) -> pa.Array:
    if score.dtype == object:
        return pa.array([Decimal(min(max(int(s), -MOST), MOST)) for s in score], pa.decimal128(38, 0))
    return pa.array(score.astype(np.int64)).cast(pa.decimal128(38, 0))


def whole_rows(embeddings: DataFrame, scale: float, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """id, label, vector array<double> of floor(scale * x), of the rows that take part."""
    v = F.col(vector_col)
    sound = v.isNotNull() & F.col(id_col).isNotNull() & label.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))

    def whole(x: Column) -> Column:
        y = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)

    return embeddings.where(sound).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(v, whole).alias("vector"))


def hard_negatives(
    embeddings: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor: over a column named id. label: over embeddings. Negatives score from low to high hundredths of their
    positive's score.
    """
    spark: SparkSession = embeddings.sparkSession
    share_package(spark)
    rows = written(whole_rows(embeddings, scale, id_col, vector_col, label), "negatives-vectors")
    length = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    if not length:
        none = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return spark.createDataFrame(pd.DataFrame([], columns=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]), none)
    dims = length[0]["dims"]
    space = Space(rows.where(F.size("vector") == dims), is_anchor, dims, positives + 1, pivots)
    return space.negatives(space.positives(positives), negatives, low, high)
