"""What SQL text can use after register_all: a table function, an aggregate and a data source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline.sources import records
from plumbline.sources.staging import share_package
from plumbline.streaming.peaks import Walk


class BeatPlaces:
    """beat_places(samples, fs): a row (beat, at) for each beat of one lead's samples, as signals.beat_places has them."""

    def eval(self, samples: list[float] | None, fs: int | None) -> Iterator[tuple[int, int]]:
        if samples and fs and all(v is not None and np.isfinite(v) for v in samples):
            yield from enumerate(Walk().feed(list(map(float, samples)), True, fs))


def led_on_median(degrees: pd.Series, order: pd.Series) -> float | None:
    """The median of angles in order, each led on from the one before by the shorter way, as waves.circular_median has it."""
    rows = pd.DataFrame({"d": degrees, "o": order}).sort_values("o", kind="stable")
    # A turn is counted from the angle before in order; without that angle there is none.
    turn = (-np.floor((rows["d"] - rows["d"].shift() + 180.0) / 360.0)).where(rows["d"].notna()).fillna(0)[rows["d"].notna()]
    own = rows["d"].dropna()
    return float((own + 360.0 * turn.cumsum()).median()) if len(own) else None


def register_all(spark: SparkSession) -> None:
    """Registers beat_places, circular_median(degrees, place) and the wfdb source with a session.

    circular_median sees one group at a time: the beats of a record.
    """
    share_package(spark)
    spark.udtf.register("beat_places", F.udtf(BeatPlaces, returnType="beat int, at int"))

    @F.pandas_udf("double")
    def circular_median(degrees: pd.Series, order: pd.Series) -> float:
        return led_on_median(degrees, order)

    spark.udf.register("circular_median", circular_median)
    records.register(spark)
