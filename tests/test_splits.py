"""Splits of few patients, and folds of groups that aren't numbers."""

import pytest

from plumbline.operators import splits


@pytest.mark.parametrize("n", [3, 4, 5, 8, 200])
def test_no_side_of_a_split_is_empty(spark, n):
    df = spark.createDataFrame([(f"p{i % n}", i) for i in range(2 * n)], "patient string, row int")
    for shares in ((0.7, 0.1), (0.1, 0.8), (0.05, 0.05)):
        got = splits.patient_split(df, "patient", *shares).collect()
        sides = {}
        for r in got:
            sides.setdefault(r["split"], set()).add(r["patient"])
        assert len(got) == 2 * n and set(sides) == {"train", "val", "test"} and sum(map(len, sides.values())) == n
        again = splits.patient_split(df.repartition(3), "patient", *shares).collect()
        assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_two_patients_are_an_error(spark):
    with pytest.raises(ValueError, match="three ways"):
        splits.patient_split(spark.createDataFrame([("a",), ("b",)], "patient string"), "patient")


def test_folds_keep_groups_whole_whatever_they_are(spark):
    df = spark.createDataFrame([(f"g{i // 3}", i // 3) for i in range(300)], "name string, number int")
    for group in ("name", "number"):
        got = splits.folds(df, group, 5).collect()
        by = {}
        for r in got:
            by.setdefault(r[group], set()).add(r["fold"])
        assert all(len(f) == 1 for f in by.values()) and {f for own in by.values() for f in own} == {0, 1, 2, 3, 4}
