"""Beat and wave measurements as window functions over one row per sample or beat."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.order import running_before
from plumbline.sources.staging import share_package


def intervals(df: DataFrame, key: str, time: str, order: list[str]) -> DataFrame:
    """Adds rr: the time since the key's row before; null for the first."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rr", F.col(time) - F.lag(time).over(w))


def rate_summary(beats: DataFrame, key: str, least: int = 3) -> DataFrame:
    """n_beats, rr (median), rr_sd (sample) and rate = 60 / rr for keys with enough beats; others get nulls."""
    out = beats.groupBy(key).agg(F.count(F.lit(1)).alias("n_beats"), F.median("rr").alias("rr"), F.stddev_samp("rr").alias("rr_sd"))
    enough = F.col("n_beats") >= least
    return out.select(key, "n_beats", F.when(enough, F.col("rr")).alias("rr"), F.when(enough, F.coalesce("rr_sd", F.lit(0.0))).alias("rr_sd"), F.when(enough, F.try_divide(F.lit(60.0), F.col("rr"))).alias("rate"))


def preceding(beats: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds before: the interval before a beat; the first beat reuses the one after it."""
    w = Window.partitionBy(key).orderBy(*order)
    return beats.withColumn("before", F.coalesce(F.col("rr"), F.lead("rr").over(w)))


def moving_mean(df: DataFrame, key: str, value: str, order: list[str], half: int) -> DataFrame:
    """Adds smooth: the centred mean over 2 * half + 1 samples, fewer at the edges."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-half, half)
    return df.withColumn("smooth", F.avg(value).over(w))


def local_maxima(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Rows above both neighbours."""
    w = Window.partitionBy(key).orderBy(*order)
    d = df.withColumn("_b", F.lag(value).over(w)).withColumn("_a", F.lead(value).over(w))
    return d.where((F.col(value) > F.col("_b")) & (F.col(value) > F.col("_a"))).drop("_a", "_b")


def runs(df: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Gaps and islands: adds at (place from 0) and run, the same for neighbouring rows of equal state."""
    w = Window.partitionBy(key).orderBy(*order)
    own = Window.partitionBy(key, state).orderBy(*order)
    at = F.row_number().over(w) - 1
    return df.withColumn("at", at.cast("long")).withColumn("run", (at - F.row_number().over(own)).cast("long"))


def first_quiet(df: DataFrame, key: str, value: str, order: list[str], below: float, least: int) -> DataFrame:
    """key, at, length: where the first run of at least so many quiet samples begins."""
    r = runs(df.withColumn("quiet", F.col(value) < below), key, order, "quiet").where("quiet")
    islands = r.groupBy(key, "run").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("length")).where(F.col("length") >= least)
    return islands.groupBy(key).agg(F.min("at").alias("at"), F.min_by("length", "at").alias("length"))


def trailing_force(df: DataFrame, key: str, value: str, order: list[str], base: float, ms: float) -> DataFrame:
    """key, length, depth, force of the run below the base that ends a trace: -(length in ms * depth); 0 without one."""
    down = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_up", F.max((F.col(value) >= base).cast("int")).over(down))
    tail = F.col("_up") == 0
    out = d.groupBy(key).agg(F.count_if(tail).alias("length"), F.coalesce(F.max(F.when(tail, base - F.col(value))), F.lit(0.0)).alias("depth"))
    return out.withColumn("force", -(F.col("length") * F.lit(ms) * F.col("depth")) + F.lit(0.0))


def dispersion(df: DataFrame, key: str, value: str, least: int) -> DataFrame:
    """key, n, dispersion = max - min of keys with enough values."""
    return df.groupBy(key).agg(F.count(value).alias("n"), (F.max(value) - F.min(value)).alias("dispersion")).where(F.col("n") >= least)


def corrected(df: DataFrame, qt: str, rr: str) -> DataFrame:
    """Adds bazett and fridericia: qt over the square and cube root of rr; null where rr isn't positive."""
    r = F.when(F.col(rr) > 0, F.col(rr))
    return df.withColumn("bazett", F.col(qt) / F.sqrt(r)).withColumn("fridericia", F.col(qt) / F.pow(r, F.lit(1.0 / 3.0)))


def axis(df: DataFrame, vertical: str, horizontal: str) -> DataFrame:
    return df.withColumn("axis", F.degrees(F.atan2(vertical, horizontal)))


#: Tolerances that one bin of a record's time line is wide.
BIN = 256


def matched(references: list[float], detections: list[float], tolerance: float) -> list[float]:
    """Distances of matches: references in order take the nearest detection that is free, the earlier of two as near."""
    taken, first, out = [False] * len(detections), 0, []
    for r in references:
        while first < len(detections) and r - detections[first] > tolerance:
            first += 1
        best, at = first, None
        while best < len(detections) and detections[best] - r <= tolerance:
            if not taken[best] and (at is None or abs(detections[best] - r) < abs(detections[at] - r)):
                at = best
            best += 1
        if at is not None:
            taken[at] = True
            out.append(abs(detections[at] - r))
    return out


def scored(reference: DataFrame, detected: DataFrame, key: str, time: str, tolerance: float) -> DataFrame:
    """key, n_reference, n_detected, n_matched, sensitivity, ppv, f1, mean_error and max_error (absolute; null without a match).

    References in order of time take their nearest detection within the tolerance that none before has taken, the
    earlier of two as near. Where two neighbours on the time line, of either kind, are more than the tolerance apart,
    no match spans the gap: what lies between two gaps is matched on its own. Neighbours are found within bins of the
    time line, and between bins from the bins' ends, so that no task sorts a whole record.
    """
    share_package(reference.sparkSession)
    marks = reference.select(F.col(key).alias("k"), F.col(time).cast("double").alias("t"), F.lit(True).alias("is_reference")).unionByName(detected.select(F.col(key).alias("k"), F.col(time).cast("double").alias("t"), F.lit(False).alias("is_reference"))).where("t is not null")
    marks = marks.withColumn("bin", F.floor(F.col("t") / (BIN * tolerance) if tolerance > 0 else F.col("t")).cast("long"))
    inside = F.lag("t").over(Window.partitionBy("k", "bin").orderBy("t"))
    ends = marks.groupBy("k", "bin").agg(F.max("t").alias("end"))
    ends = ends.select(F.col("k").alias("_k"), F.col("bin").alias("_bin"), F.lag("end").over(Window.partitionBy("k").orderBy("bin")).alias("before_bin"))
    marks = marks.withColumn("before", inside).join(ends, F.col("k").eqNullSafe(F.col("_k")) & (F.col("bin") == F.col("_bin"))).drop("_k", "_bin")
    marks = marks.withColumn("apart", F.coalesce(F.col("t") - F.coalesce("before", "before_bin") > tolerance, F.lit(True)).cast("long"))
    # Gaps so far number the parts: those of earlier bins, and of the own bin.
    marks = running_before(marks, ["k"], "bin", [F.col("t"), F.col("apart").desc(), F.col("is_reference")], F.col("apart")).withColumn("island", F.col("before") + F.col("apart"))
    kind = marks.schema["k"].dataType.simpleString()
    rows = marks.select("k", "island", "t", "is_reference").repartition("k", "island").sortWithinPartitions("k", "island", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, references, detections, out = None, [], [], []

        def end() -> None:
            if own is not None:
                errors = matched(references, detections, tolerance)
                out.append((own[0], len(references), len(detections), len(errors), sum(errors), max(errors, default=None)))
            references.clear()
            detections.clear()

        def written() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = [key_type, *[pa.int64()] * 3, *[pa.float64()] * 2]
            rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["k", "r", "d", "m", "error", "most"])
            out.clear()
            return rows

        key_type = pa.null()
        for batch in batches:
            key_type = batch.column("k").type
            for k, island, t, is_reference in zip(*(batch.column(c).to_pylist() for c in ("k", "island", "t", "is_reference")), strict=True):
                if own != (k, island):
                    end()
                    own = (k, island)
                (references if is_reference else detections).append(t)
            yield written()
        end()
        if out:
            yield written()

    each = rows.mapInArrow(run, f"k {kind}, r long, d long, m long, error double, most double")
    out = each.groupBy("k").agg(F.sum("r").alias("n_reference"), F.sum("d").alias("n_detected"), F.sum("m").alias("n_matched"), F.sum("error").alias("error"), F.max("most").alias("max_error"))
    out = out.withColumn("sensitivity", F.try_divide("n_matched", "n_reference")).withColumn("ppv", F.try_divide("n_matched", "n_detected"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("n_matched"), F.col("n_reference") + F.col("n_detected")), F.lit(0.0))
    return out.select(F.col("k").alias(key), "n_reference", "n_detected", "n_matched", "sensitivity", "ppv", f1.alias("f1"), F.try_divide("error", F.col("n_matched")).alias("mean_error"), "max_error")


def circular_median(df: DataFrame, key: str, degrees: str, order: list[str]) -> DataFrame:
    """key and the median of angles in order, each led on from the one before by the shorter way; it may pass 180 degrees."""
    along = Window.partitionBy(key).orderBy(*order)
    turn = -F.floor((F.col(degrees) - F.lag(degrees).over(along) + 180.0) / 360.0)
    rows = df.where(F.col(degrees).isNotNull()).withColumn("_turn", F.coalesce(turn, F.lit(0)))
    rows = rows.withColumn("_on", F.col(degrees) + 360.0 * F.sum("_turn").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key).agg(F.median("_on").alias("median"))
