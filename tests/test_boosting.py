"""Boosted models grown together against trees grown one by one, row by row."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plumbline.operators import boosting
from plumbline.operators.boosting import Settings, boosted, chance


@pytest.fixture(scope="module")
def table(spark):
    draw = np.random.default_rng(3)
    n = 600
    a, b, c = draw.normal(size=n), draw.integers(0, 5, n).astype(float), draw.random(n)
    y = np.where(a > 0.3, 2.0, -1.0) * (b >= 2) + 0.5 * c + draw.normal(size=n) * 0.3
    rows = [(i, i % 3, float(y[i]), float(a[i]), float(b[i]), float(c[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, fold int, y double, a double, b double, c double").repartition(4).cache()


def grown_alone(x, y, h, train, settings):
    """Trees of one model over binned features x: margins of all rows."""
    aside = (h & (2**20 - 1)) < int(settings.validation * 2**20)
    learn, held = train & ~aside, train & aside
    margin, losses = np.full(len(y), y[learn].mean()), []

    def grow(rows, depth):
        """Rows of the node and the function of its leaves."""
        best = (0.0, None, None)
        if depth < settings.depth:
            for f in range(x.shape[1]):
                for cut in range(settings.bins - 1):
                    left = x[rows, f] <= cut
                    if left.any() and not left.all():
                        u, v = r[rows[left]], r[rows[~left]]
                        gain = len(u) * len(v) / len(rows) * (u.mean() - v.mean()) ** 2
                        if gain > best[0] * (1 + 1e-9) + 1e-12:
                            best = (gain, f, cut)
        if best[1] is None:
            return lambda at, value=r[rows].mean(): np.full(len(at), value)
        left = x[rows, best[1]] <= best[2]
        below, above = grow(rows[left], depth + 1), grow(rows[~left], depth + 1)
        return lambda at: np.where(x[at, best[1]] <= best[2], below(at), above(at))

    trees = 0
    for t in range(settings.rounds):
        if t:
            loss = ((y[held] - margin[held]) ** 2).mean()
            if len(losses) >= boosting.PATIENCE and not any(loss + boosting.TOLERANCE < p for p in losses[-boosting.PATIENCE :]):
                break
            losses.append(loss)
        r = y - margin
        margin = margin + settings.rate * grow(np.flatnonzero(learn & (chance(h, t + 1) < settings.subsample)), 0)(np.arange(len(y)))
        trees += 1
    return margin, trees


def test_models_grown_together_are_those_grown_alone(table, monkeypatch):
    monkeypatch.setattr(boosting, "FRESH", 3)
    monkeypatch.setattr(boosting, "PATIENCE", 3)
    monkeypatch.setattr(boosting, "TOLERANCE", 2e-2)
    settings = Settings(rounds=14, depth=2, rate=0.3, bins=8)
    subsets = {"base": ["b"], "both": ["a", "b"], "all": ["c", "a", "b"], "none": []}
    run = boosted(table, "id", "y", "fold", subsets, settings, whole=("all",))
    got = run.predicted().toPandas().set_index("key").sort_index()
    pdf = table.withColumn("h", F.xxhash64("id")).toPandas().set_index("id").sort_index()
    binned = {c: sum((pdf[c].to_numpy() > e).astype(int) for e in run.edges[c]) for c in "abc"}
    assert all(1 <= len(run.edges[c]) <= 7 for c in "abc") and len(run.edges["b"]) == 4
    y, h, fold = pdf.y.to_numpy(), pdf.h.to_numpy(), pdf.fold.to_numpy()
    counts = set()
    for name, own in subsets.items():
        for k in range(3):
            aside = (h & (2**20 - 1)) < int(settings.validation * 2**20)
            if own:
                want, trees = grown_alone(np.column_stack([binned[c] for c in sorted(own)]), y, h, fold != k, settings)
                assert trees == len(next(m for m in run.models if m.subset == name and m.fold == k).trees)
                counts.add(trees)
            else:
                want = np.full(len(y), y[(fold != k) & ~aside].mean())
            assert np.allclose(got[name].to_numpy()[fold == k], want[fold == k])
    assert len(counts) > 1 and min(counts) < 14
    shares = run.importances("all")
    assert sum(shares.values()) == pytest.approx(1) and shares["a"] > 0.2 and shares["b"] > 0.2 and shares["c"] < 0.2


def test_boosting_finds_what_a_line_misses(table):
    run = boosted(table, "id", "y", "fold", {"full": ["a", "b", "c"]}, Settings(rounds=40, rate=0.2))
    pdf = table.toPandas().merge(run.predicted().toPandas(), left_on="id", right_on="key")
    share = 1 - ((pdf.y - pdf.full) ** 2).mean() / pdf.y.var()
    x = np.c_[np.ones(len(pdf)), pdf[["a", "b", "c"]]]
    line = x @ np.linalg.lstsq(x, pdf.y, rcond=None)[0]
    assert share > 0.8 > 1 - ((pdf.y - line) ** 2).mean() / pdf.y.var()


def test_rows_are_packed_and_few_margins_kept_by_row(table, monkeypatch):
    """Small models are tables, equal subsets share their models, and what a pass reads of a row is some bytes."""
    settings = Settings(rounds=4, rate=0.3, bins=8)
    subsets = {"one": ["a"], "two": ["a", "b"], "swapped": ["b", "a"], "all": ["a", "b", "c"]}
    monkeypatch.setattr(boosting, "CELLS", 64)
    run = boosted(table, "id", "y", "fold", subsets, settings)
    assert len(run.models) == 9 and len(run.large) == 3
    assert run.margins.count() < 20 and run.rows.count() < 20
    got = run.predicted().toPandas().set_index("key").sort_index()
    assert len(got) == 600 and (got.two == got.swapped).all()
    monkeypatch.setattr(boosting, "CELLS", 0)
    rows = boosted(table, "id", "y", "fold", subsets, settings)
    assert len(rows.large) == 9
    assert np.allclose(got, rows.predicted().toPandas().set_index("key").sort_index())


def test_a_row_group_holds_few_packed_rows(spark):
    """A task reads a row group of packed rows into memory at once, so none holds over 8 MB, or a single row that is larger."""
    columns = [F.rand(i).alias(f"c{i}") for i in range(6)]
    rows = spark.range(0, 30000, 1, 1).select("id", (F.col("id") % 2).cast("int").alias("fold"), F.col("id").cast("double").alias("y"), *columns)
    subsets = {str(s): [f"c{i}" for i in range(6) if s >> i & 1] for s in range(1, 64)}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(boosting, "CELLS", 0)
        run = boosted(rows, "id", "y", "fold", subsets, Settings(rounds=1, depth=1, bins=4))
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in run.margins.inputFiles()]
    groups = [f.row_group(i) for f in files for i in range(f.num_row_groups)]
    assert sum(g.num_rows for g in groups) == run.rows.count() >= 3
    assert sum(g.total_byte_size for g in groups) > 28e6 and all(g.num_rows == 1 or g.total_byte_size < 9e6 for g in groups)


def test_trees_walked_together_are_those_walked_alone():
    """Depth 5 has too many outcomes to be tabled; at depth 3 nine trees share a word, at depth 4 four."""
    draw, bins = np.random.default_rng(5), 8
    row = {"h": draw.integers(0, 9, 500).tobytes(), "fold": np.zeros(500, np.int32).tobytes(), "y": np.zeros(500).tobytes(), "x": draw.integers(0, bins, (6, 500)).astype(np.uint8).tobytes()}
    rows = boosting.Rows(boosting.Block(row, bins), np.flatnonzero(draw.random(500) < 0.7), bins)
    for depth in (1, 2, 3, 4, 5):
        features, n = [0, 2, 3, 5] if depth % 2 else [1, 2, 4], 2**depth - 1
        trees = [boosting.Tree(draw.choice([-1, *features], n), draw.integers(0, bins, n), draw.normal(size=n + 1)) for _ in range(11)]
        want = np.full(len(rows.at), 0.5)
        for tree in trees:
            want += tree.values(rows.x)
        walk = boosting.Walk(trees, features, bins)
        assert walk.few == (depth < 5) and (walk.add(np.full(len(rows.at), 0.5), rows) == want).all()
    assert (boosting.Walk([], [1], bins).add(np.full(len(rows.at), 0.5), rows) == 0.5).all()
