"""Operator 11: vector codes by product quantization, trained with Elkan's form of Lloyd's rounds.

Vectors become whole numbers and are cut into PARTS consecutive parts; each part position has a codebook of ENTRIES
entries. A round assigns every part to its nearest entry and replaces entries by the floor of their parts' mean.

The first assignment works out all distances and leaves, with every row, an upper bound for each part (the distance to
its entry) and a lower bound for each entry of each part. When entries move, upper bounds grow and lower bounds shrink by
the distance moved. A later assignment leaves a part alone where its upper bound is strictly below half the distance from
its entry to the nearest other; of the other parts, only entries are looked at whose lower bound, and half whose
distance from the part's entry, aren't strictly above the upper bound, which is first made exact. Those distances are
worked out as integers, so that ties go to the lower index, as they must. Pruning is strict on both tests, and bounds
are rounded to the safe side, so that codes equal those of a full search.

Rows and their bounds are written to the shared folder after each assignment; a lower bound takes one byte there, in
steps of a 255th of the part's largest, rounded down. Sums of a round are added up in each task and then by Spark; the
driver gets the codebooks, one number for each entry and dimension.

Cases: a vector that is null or holds a null or non-finite component is dropped; so is nothing else. A null id is coded,
but doesn't start a codebook; an id with several vectors starts one entry, with the smallest of them; with fewer ids than
ENTRIES, codebooks are smaller; ties go to the lower index; repeated rows get repeated results; an empty table gives
no rows. Parts are as equal as the length allows. A vector of another length than most (of equally frequent lengths,
than the longest) gets a null code and a null error. Components beyond 2**62 count as 2**62, and errors beyond 64 bits
read as the largest long. Columns other than the three named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import share_package, written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components below this have exact squared distances in 64 bits; larger ones are compared as Python integers, unpruned.
SMALL = 2**24
LONG = 2**63 - 1
#: Most labels whose sums are broadcast.
FEW_LABELS = 100_000
#: Bounds are widened by this share against rounding.
SLACK = 1e-9

STATE = "entry binary, upper binary, lower binary, top binary"


def finite(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def whole(x: Column, scale: float) -> Column:
    """floor(scale * x) as a long; beyond 2**62 it stays there."""
    y = F.lit(float(scale)) * x.cast("double")
    return F.floor(F.greatest(F.least(y, F.lit(2.0**62)), F.lit(-(2.0**62)))).cast("long")


def cuts(dims: int, parts: int) -> list[tuple[int, int]]:
    return [(p * dims // parts, (p + 1) * dims // parts) for p in range(parts)]


class Codebook:
    """The entries of all parts, and their distances from one another and from where they were a round before."""

    def __init__(self, entries: list[np.ndarray], before: Codebook | None = None):
        self.entries = entries
        self.small = all(e.size == 0 or np.abs(e).max() < SMALL for e in entries)
        self.moved = [np.zeros(len(e)) if before is None else np.sqrt(((e.astype(float) - b) ** 2).sum(axis=1)) * (1 + SLACK) for e, b in zip(entries, before.entries if before else entries, strict=True)]
        self.half, self.nearest = [], []
        for e in entries:
            d = np.sqrt(((e[:, None, :].astype(float) - e[None, :, :]) ** 2).sum(axis=2)) / 2 * (1 - SLACK)
            np.fill_diagonal(d, np.inf)
            self.half.append(d)
            self.nearest.append(d.min(axis=1, initial=np.inf))

    def text(self) -> str:
        return ",".join(str(int(x)) for e in self.entries for x in e.ravel())


def squared(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries, which may be one for each row or a table for all."""
    d = rows - entries
    return (d * d).sum(axis=-1)


class Bounds:
    """Entry, upper bound and lower bounds of every part of some rows, as the written table has them."""

    def __init__(self, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.entry, self.upper, self.lower = entry, upper, lower

    @classmethod
    def none(cls, n: int, parts: int, entries: int) -> Bounds:
        return cls(np.zeros((n, parts), np.uint8), np.full((n, parts), np.inf), np.zeros((n, parts, entries)))

    @classmethod
    def opened(cls, batch: pa.RecordBatch, parts: int, entries: int) -> Bounds:
        n = batch.num_rows
        entry, upper, lower, top = (np.frombuffer(b"".join(batch.column(c).to_pylist()), kind) for c, kind in (("entry", np.uint8), ("upper", float), ("lower", np.uint8), ("top", np.float32)))
        low = lower.reshape(n, parts, entries) * (top.reshape(n, parts, 1).astype(float) / 255) * (1 - SLACK)
        return cls(entry.reshape(n, parts).copy(), upper.reshape(n, parts).copy(), low)

    def columns(self) -> list[pa.Array]:
        top = self.lower.max(axis=2, initial=0).astype(np.float32)
        step = np.where(top > 0, top.astype(float), 1.0)[:, :, None] / 255
        low = np.minimum(np.floor(self.lower / step), 255).astype(np.uint8)
        return [pa.array([r.tobytes() for r in a], pa.binary()) for a in (self.entry, self.upper, low, top)]

    def shift(self, book: Codebook) -> None:
        """Follows the entries' last move."""
        for p, moved in enumerate(book.moved):
            self.upper[:, p] += moved[self.entry[:, p]]
            self.lower[:, p] = np.maximum(self.lower[:, p] - moved, 0)

    def assign(self, rows: np.ndarray, book: Codebook) -> int:
        """Nearest entries of all parts, ties to the lower index; returns how many distances were worked out."""
        exact = book.small and (rows.size == 0 or np.abs(rows).max() < SMALL)
        looked = 0
        for p, (a, b) in enumerate(cuts(rows.shape[1], self.entry.shape[1])):
            part, entries = rows[:, a:b], book.entries[p]
            if not exact:
                self._search_all(p, part.astype(object), entries.astype(object))
                looked += len(part) * len(entries)
                continue
            looked += self._search(p, part, entries, book.half[p], book.nearest[p])
        return looked

    def _search_all(self, p: int, part: np.ndarray, entries: np.ndarray) -> None:
        for i, row in enumerate(part):
            found = [sum((x - y) ** 2 for x, y in zip(row, e, strict=True)) for e in entries]
            self.entry[i, p] = min(range(len(found)), key=found.__getitem__)
        self.upper[:, p], self.lower[:, p] = np.inf, 0

    def _search(self, p: int, part: np.ndarray, entries: np.ndarray, half: np.ndarray, nearest: np.ndarray) -> int:
        entry, upper, lower = self.entry[:, p], self.upper[:, p], self.lower[:, p]
        unknown = np.flatnonzero(np.isinf(upper))
        for start in range(0, len(unknown), 1024):
            own = unknown[start : start + 1024]
            d = squared(part[own][:, None, :], entries[None])
            entry[own] = d.argmin(axis=1)
            root = np.sqrt(d.astype(float))
            lower[own] = root * (1 - SLACK)
            upper[own] = root[np.arange(len(own)), entry[own]] * (1 + SLACK)
        looked = len(unknown) * len(entries)
        open_ = np.flatnonzero(~(upper < nearest[entry]) & ~np.isin(np.arange(len(part)), unknown))
        if not len(open_):
            return looked
        own = squared(part[open_], entries[entry[open_]])
        upper[open_] = np.sqrt(own.astype(float)) * (1 + SLACK)
        maybe = (lower[open_] <= upper[open_, None]) & (half[entry[open_]] <= upper[open_, None])
        maybe[np.arange(len(open_)), entry[open_]] = False
        i, c = np.nonzero(maybe)
        found = squared(part[open_[i]], entries[c])
        lower[open_[i], c] = np.sqrt(found.astype(float)) * (1 - SLACK)
        # Smallest distance first, then lowest index, the entry held so far among them.
        i, c, found = np.r_[i, np.arange(len(open_))], np.r_[c, entry[open_]], np.r_[found, own]
        order = np.lexsort((c, found, i))
        first = order[np.r_[True, np.diff(i[order]) != 0]]
        lower[open_, entry[open_]] = upper[open_] * (1 - 3 * SLACK)
        entry[open_] = c[first]
        upper[open_] = np.sqrt(found[first].astype(float)) * (1 + SLACK)
        return looked + len(found)


def opened(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, dims)


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of so many at most: an open row has a bound for every entry."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


class Training:
    """One run over the rows of one length."""

    def __init__(self, rows: DataFrame, dims: int, parts: int, entries: int):
        """rows: id, label, vector array<long>."""
        self.dims, self.parts = dims, parts
        ids = [r["id"] for r in rows.select("id").where("id is not null").distinct().orderBy("id").limit(entries).collect()]
        started = rows.where(F.col("id").isin(ids)).groupBy("id").agg(F.min("vector").alias("vector")).orderBy("id")
        first = np.array([r["vector"] for r in started.collect()], np.int64).reshape(len(ids), dims)
        self.book = Codebook([first[:, a:b] for a, b in cuts(dims, parts)])
        self.entries = len(first)
        self.rows = rows

    def assigned(self, before: DataFrame | None) -> DataFrame:
        """Every row with its vector as bytes and its bounds; before: the same of the round before."""
        book, dims, parts, entries, fresh = self.book, self.dims, self.parts, self.entries, before is None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in few_rows(batches):
                if fresh:
                    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
                    state, vector = Bounds.none(len(flat), parts, entries), pa.array([r.tobytes() for r in flat], pa.binary())
                else:
                    vector = batch.column("vector")
                    flat, state = opened(vector, dims), Bounds.opened(batch, parts, entries)
                    state.shift(book)
                state.assign(flat, book)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), vector, *state.columns()], ["id", "label", "vector", "entry", "upper", "lower", "top"])

        source = self.rows if fresh else before
        kinds = {f.name: f.dataType.simpleString() for f in self.rows.schema}
        return written(source.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, vector binary, {STATE}"), "codes-rows")

    def update(self, rows: DataFrame) -> None:
        """Replaces each entry by the floor of its parts' mean; entries without parts stay."""
        dims, parts, entries = self.dims, self.parts, self.entries

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, many = np.zeros((entries, dims), object), np.zeros((entries, parts), np.int64)
            for batch in batches:
                flat, entry = opened(batch.column("vector"), dims), np.frombuffer(b"".join(batch.column("entry").to_pylist()), np.uint8).reshape(-1, parts)
                # Sums of one batch fit into 64 bits unless components are large.
                own = flat if flat.size == 0 or np.abs(flat).max() < SMALL else flat.astype(object)
                for p, (a, b) in enumerate(cuts(dims, parts)):
                    sums = np.zeros((entries, b - a), own.dtype)
                    np.add.at(sums, entry[:, p], own[:, a:b])
                    total[:, a:b] += sums.astype(object)
                    many[:, p] += np.bincount(entry[:, p], minlength=entries)
            of = np.repeat(np.arange(parts), [b - a for a, b in cuts(dims, parts)])
            e, d = np.nonzero(many[:, of])
            sums = pa.array([Decimal(int(total[x, y])) for x, y in zip(e, d, strict=True)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(e.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(many[e, of[d]]), sums], ["entry", "dim", "many", "total"])

        found = rows.select("vector", "entry").mapInArrow(run, "entry int, dim int, many long, total decimal(38,0)")
        new = np.concatenate(self.book.entries, axis=1).copy() if dims else np.zeros((entries, 0), np.int64)
        for r in found.groupBy("entry", "dim").agg(F.sum("many").alias("many"), F.sum("total").alias("total")).collect():
            new[r["entry"], r["dim"]] = int(r["total"]) // r["many"]
        self.book = Codebook([new[:, a:b] for a, b in cuts(dims, parts)], self.book)

    def coded(self, rows: DataFrame) -> DataFrame:
        """id, label, code, error of every row by the last assignment."""
        book, dims, parts = self.book, self.dims, self.parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat, entry = opened(batch.column("vector"), dims), np.frombuffer(b"".join(batch.column("entry").to_pylist()), np.uint8).reshape(-1, parts)
                near = np.concatenate([e[entry[:, p]] for p, e in enumerate(book.entries)], axis=1)
                kind = np.int64 if book.small and (flat.size == 0 or np.abs(flat).max() < SMALL) else object
                error = squared(flat.astype(kind), near.astype(kind))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([r.tobytes().hex() for r in entry], pa.string()), pa.array([min(int(x), LONG) for x in error], pa.int64())], ["id", "label", "code", "error"])

        kinds = {f.name: f.dataType.simpleString() for f in self.rows.schema}
        return rows.select("id", "label", "vector", "entry").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def quantize(embeddings: DataFrame, scale: float = 256.0, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id_col, label, code, error, label_error, codebooks_sha256 for every finite vector.

    code: two hex digits for each part's entry (256 at most); label_error: the errors' sum over rows of the same label.
    """
    if not 0 < entries <= 256:
        raise ValueError("codebooks have 1 to 256 entries")
    share_package(embeddings.sparkSession)
    v = F.col(vector_col)
    kept = embeddings.where(finite(v)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(v, lambda x: whole(x, scale)).alias("vector"))
    # The first pass is the only one over the input; what follows reads this table.
    kept = written(kept, "codes-vectors")
    length = kept.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    dims = length[0]["dims"] if length else 0
    run = Training(kept.where(F.size("vector") == dims), dims, parts, entries)
    state = None
    if run.entries:
        for _ in range(rounds):
            state = run.assigned(state)
            run.update(state)
        state = run.assigned(state)
        found = run.coded(state)
    else:
        found = kept.where("false").select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    # Rows without a codebook to go by: of other lengths, or all, where no row has an id.
    rest = kept if not run.entries else kept.where(F.size("vector") != dims)
    found = written(found.unionByName(rest.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))), "codes")
    sums = found.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"))
    sums = written(sums.select("of", F.least("sum", F.lit(LONG).cast("decimal(38,0)")).cast("long").alias("label_error")), "codes-labels")
    near = F.broadcast(sums) if sums.count() <= FEW_LABELS else sums
    digest = hashlib.sha256(run.book.text().encode()).hexdigest()
    joined = found.join(near, F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
