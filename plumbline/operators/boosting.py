"""Gradient-boosted trees of many models in one pass a level: all feature subsets and all folds together.

Features are binned at quantiles once. A pass over the rows finds, for every model, the node that each of its training
rows has reached, and adds up residuals by node, feature and bin; the sums of a model and feature meet in one group,
which has the best cut of each node. So the driver gets one row for each model, node and feature, and a tree of depth 3
takes three passes, whatever the number of models. Squared error; cuts by Friedman's improvement; each tree sees a share
of the rows, chosen by a hash of row and round; and a model stops once its loss on rows set aside for that, again by a
hash, has not been better than any of its last PATIENCE losses by TOLERANCE.

Rows lie packed, a block of some thousand to a row of the table, so that a pass moves a few arrays of bytes. A model whose
features have at most CELLS combinations of bins is a table of its margin in each, and rows look it up. The others'
margins are kept in a written table and brought up to date every FRESH rounds; in between, the few trees since are
applied in the pass itself. Subsets of the same features share their models.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.staging import BATCH_BYTES, share_package, staged

PATIENCE, TOLERANCE = 15, 1e-4
FRESH = 10
#: Most combinations of bins of a model's features that are tabled.
CELLS = 1 << 15
#: Most outcomes of a tree's comparisons whose leaves are tabled (trees of depth 4), and comparisons that a word holds.
OUTCOMES, WORD = 1 << 15, 63
#: The fold of models that are fitted to all rows.
WHOLE = -1


@dataclass(frozen=True)
class Settings:
    rounds: int = 300
    depth: int = 3
    rate: float = 0.05
    subsample: float = 0.9
    validation: float = 0.15
    bins: int = 32


@dataclass
class Tree:
    """Cuts of a full binary tree in level order (feature -1: no cut, all go left) and what each leaf adds."""

    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray

    def nodes(self, binned: np.ndarray, depth: int) -> np.ndarray:
        """The node, numbered within its level, that rows reach at a depth; binned: an array a feature."""
        at = np.zeros(binned.shape[1], np.uint8 if depth <= 8 else np.uint32)
        for level in range(depth):
            right = np.zeros(len(at), bool)
            for node in range(2**level):
                feature = self.features[2**level - 1 + node]
                if feature >= 0:
                    right |= (at == node) & (binned[feature] > int(self.cuts[2**level - 1 + node]))
            at = 2 * at + right
        return at

    def values(self, binned: np.ndarray) -> np.ndarray:
        return self.leaves[self.nodes(binned, int(np.log2(len(self.leaves))))]


@dataclass
class Model:
    """One subset of features, fitted to all rows outside one fold."""

    subset: str
    features: list[int]
    fold: int
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    gains: list[dict[int, float]] = field(default_factory=list)
    losses: deque = field(default_factory=lambda: deque(maxlen=PATIENCE))
    live: bool = True
    #: Margins by combination of bins, the last feature's bins next to each other; None: too many.
    table: np.ndarray | None = None

    def cells(self, binned: np.ndarray, bins: int) -> np.ndarray:
        """The combination of each row."""
        code = np.zeros(binned.shape[1], np.int64)
        for f in self.features:
            code = code * bins + binned[f]
        return code

    def grid(self, bins: int) -> np.ndarray:
        """The features' bins, an array a feature, of each combination."""
        out = np.zeros((max(self.features, default=-1) + 1, bins ** len(self.features)), _kind(bins))
        out[self.features] = np.indices((bins,) * len(self.features)).reshape(len(self.features), -1)
        return out


class Block:
    """Some rows: an array for each column and feature, and each model's margin."""

    def __init__(self, row: dict, bins: int):
        self.h, self.fold, self.y = np.frombuffer(row["h"], np.int64), np.frombuffer(row["fold"], np.int32), np.frombuffer(row["y"])
        self.x = np.frombuffer(row["x"], _kind(bins)).reshape(-1, len(self.h)) if row["x"] else np.zeros((0, len(self.h)), _kind(bins))
        self.margin = np.frombuffer(row["margin"]).reshape(-1, len(self.h)) if row.get("margin") else None


class Rows:
    """Some rows of a block: their places and features, and the combined bins of one or two features."""

    def __init__(self, block: Block, at: np.ndarray, bins: int):
        self.at, self.x, self.bins, self.codes = at, block.x.take(at, axis=1), bins, {}

    def code(self, pair: tuple[int, ...]) -> np.ndarray:
        if pair not in self.codes:
            first = self.x[pair[0]].astype(np.int64)
            self.codes[pair] = first * self.bins + self.x[pair[1]] if len(pair) == 2 else first
        return self.codes[pair]


class Walk:
    """Some trees of a model at once: for each combined bin of two features, a bit for each comparison that leads right."""

    def __init__(self, trees: list[Tree], features: list[int], bins: int):
        nodes = len(trees[0].cuts) if trees else 1
        self.trees, self.nodes, self.few = trees, nodes, nodes <= OUTCOMES.bit_length() - 1
        if not self.few:
            return
        self.pairs, each = _pairs(features), WORD // nodes
        self.words = [trees[j : j + each] for j in range(0, len(trees), each)]
        self.leaves = [[self._by_outcome(t) for t in word] for word in self.words]
        self.tables = [[self._table(word, p, bins) for p in self.pairs] for word in self.words]

    def _table(self, word: list[Tree], pair: tuple[int, ...], bins: int) -> np.ndarray:
        out, places = np.zeros(bins ** len(pair), np.uint64), np.indices((bins,) * len(pair)).reshape(len(pair), -1)
        for k, tree in enumerate(word):
            for node in np.flatnonzero(np.isin(tree.features, pair)):
                right = places[pair.index(tree.features[node])] > tree.cuts[node]
                out |= right.astype(np.uint64) << np.uint64(k * self.nodes + int(node))
        return out

    def _by_outcome(self, tree: Tree) -> np.ndarray:
        """The leaf's value for each outcome of a tree's comparisons."""
        bits, at = np.arange(1 << self.nodes), np.zeros(1 << self.nodes, np.int64)
        for level in range((self.nodes + 1).bit_length() - 1):
            at = 2 * at + (bits >> (2**level - 1 + at) & 1)
        return tree.leaves[at]

    def add(self, out: np.ndarray, rows: Rows) -> np.ndarray:
        """out with each tree's values added, one after another."""
        if not self.few:
            for tree in self.trees:
                out += tree.values(rows.x)
            return out
        mask = np.uint64((1 << self.nodes) - 1)
        for leaves, tables in zip(self.leaves, self.tables, strict=True):
            bits = tables[0].take(rows.code(self.pairs[0]))
            for pair, table in zip(self.pairs[1:], tables[1:], strict=True):
                bits |= table.take(rows.code(pair))
            for k, leaf in enumerate(leaves):
                out += leaf.take((bits >> np.uint64(k * self.nodes) & mask).view(np.int64))
        return out


def _pairs(features: list[int]) -> list[tuple[int, ...]]:
    return [tuple(features[j : j + 2]) for j in range(0, len(features), 2)]


def _kind(bins: int) -> type:
    return np.uint8 if bins <= 256 else np.uint32


def chance(key: np.ndarray, salt: int) -> np.ndarray:
    """A number from 0 to 1 for each row's hash and a salt."""
    with np.errstate(over="ignore"):
        z = key.astype(np.uint64) + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53


def best_cut(total: np.ndarray, count: np.ndarray) -> tuple[float, int]:
    """Friedman's improvement of the best cut of one node's sums by bin, and the last bin of its left side; 0.0 for none."""
    left, n_left = np.cumsum(total)[:-1], np.cumsum(count)[:-1]
    right, n_right = total.sum() - left, count.sum() - n_left
    ok = (n_left > 0) & (n_right > 0)
    if not ok.any():
        return 0.0, -1
    gain = np.full(len(left), -1.0)
    gain[ok] = n_left[ok] * n_right[ok] / count.sum() * (left[ok] / n_left[ok] - right[ok] / n_right[ok]) ** 2
    at = int(gain.argmax())
    return float(gain[at]), at


class Boosting:
    """One run. df: rows with a unique key, a whole-numbered fold, a target and columns without missing values."""

    def __init__(self, df: DataFrame, key: str, y: str, fold: str, subsets: dict[str, list[str]], settings: Settings | None = None, whole: tuple[str, ...] = ()):
        """whole: the subsets that also get a model of all rows, for its importances."""
        share_package(df.sparkSession)
        self.settings = settings or Settings()
        self.columns = sorted({c for s in subsets.values() for c in s})
        self.edges = self._edges(df)
        rows = df.select(F.col(key).alias("key"), F.xxhash64(key).alias("h"), F.col(fold).cast("int").alias("fold"), F.col(y).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(self.columns)])
        self.key_type = dict(rows.dtypes)["key"]
        self.rows = staged(self._packed(rows), "boosting-rows", packed=True)
        # Batches of a few packed rows, unless the job has set their size itself.
        if not df.sparkSession.sparkContext.getConf().contains(BATCH_BYTES[0]):
            df.sparkSession.conf.set(*BATCH_BYTES)
        self.sums = self._sums()
        self.folds = sorted(self.sums)
        self.subsets = subsets
        #: The subset whose models serve a subset: the first of the same features.
        self.served = {s: next(o for o, other in subsets.items() if set(other) == set(own)) for s, own in subsets.items()}
        full = {self.served[s] for s in whole}
        self.models = [Model(s, sorted({self.columns.index(c) for c in own}), f) for s, own in subsets.items() if self.served[s] == s for f in [*self.folds, *([WHOLE] if s in full else [])]]
        #: Models whose margins are kept by row.
        self.large = [i for i, m in enumerate(self.models) if self.settings.bins ** len(m.features) > CELLS]
        self.margins: DataFrame | None = None
        self.applied = 0

    def _edges(self, df: DataFrame) -> dict[str, list[float]]:
        """Inner bounds of the bins of each column, from one pass: a few numbers a column."""
        n = self.settings.bins
        if not self.columns:
            return {}
        shares = F.array(*[F.lit(i / n) for i in range(1, n)])
        found = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(f"c{i}") for i, c in enumerate(self.columns)], *[F.max(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(self.columns)]).first()
        return {c: [e for e in sorted(set(found[f"c{i}"] or [])) if e < found[f"m{i}"]] for i, c in enumerate(self.columns)}

    def _packed(self, rows: DataFrame) -> DataFrame:
        """keys, h, fold, y, x: a row for each batch of rows, its columns and features one after another."""
        kind, edges = _kind(self.settings.bins), [np.array(self.edges[c]) for c in self.columns]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                if n:
                    # A row's bin: how many bounds lie below its value.
                    x = b"".join(np.searchsorted(e, batch.column(f"c{i}").to_numpy(zero_copy_only=False)).astype(kind).tobytes() for i, e in enumerate(edges))
                    columns = [np.asarray(batch.column(c)).astype(k).tobytes() for c, k in (("h", np.int64), ("fold", np.int32), ("y", np.float64))]
                    keys = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column("key"))
                    yield pa.RecordBatch.from_arrays([keys, *[pa.array([c], pa.binary()) for c in (*columns, x)]], ["keys", "h", "fold", "y", "x"])

        return rows.mapInArrow(run, f"keys array<{self.key_type}>, h binary, fold binary, y binary, x binary")

    def _sums(self) -> dict[int, tuple[int, float]]:
        """Number and sum of the rows to learn from, by fold."""
        s = self.settings

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    b = Block(row, s.bins)
                    learn = ~_aside(b.h, s)
                    folds, at = np.unique(b.fold, return_inverse=True)
                    n, total = np.bincount(at[learn], minlength=len(folds)), np.bincount(at[learn], b.y[learn], len(folds))
                    yield pa.RecordBatch.from_arrays([pa.array(folds, pa.int32()), pa.array(n, pa.int64()), pa.array(total, pa.float64())], ["fold", "n", "s"])

        found = self.rows.select("h", "fold", "y", "x").mapInArrow(run, "fold int, n long, s double").groupBy("fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        return {r["fold"]: (r["n"], r["s"]) for r in found.collect()}

    def train(self) -> None:
        for m in self.models:
            n, s = (sum(v[i] for k, v in self.sums.items() if k != m.fold) for i in (0, 1))
            m.start = s / n if n else 0.0
        bins = self.settings.bins
        for i, m in enumerate(self.models):
            if i not in self.large:
                m.table = np.full(bins ** len(m.features), m.start)
        for t in range(self.settings.rounds):
            live = [m for m in self.models if m.live and m.features]
            if not live:
                break
            if t and t % FRESH == 0:
                self._refresh()
            self._grow(t)
        self._refresh(last=True)

    def _grow(self, t: int) -> None:
        """One more tree for every model that goes on."""
        depth = self.settings.depth
        size = 2**depth
        grown = {i: Tree(np.full(size - 1, -1), np.zeros(size - 1, np.int64), np.zeros(size)) for i, m in enumerate(self.models) if m.live and m.features}
        gains: dict[int, dict[int, float]] = {i: {} for i in grown}
        for level in range(depth):
            found = self._pass(t, level, grown)
            if level == 0:
                for r in found:
                    if r["feature"] < 0:
                        self._judge(self.models[r["model"]], r["gain"], r["left_n"])
                for i in [i for i in grown if not self.models[i].live]:
                    del grown[i]
            best: dict[tuple[int, int], dict] = {}
            for r in sorted((r for r in found if r["feature"] >= 0), key=lambda r: r["feature"]):
                if r["model"] in grown and r["gain"] > best.get((r["model"], r["node"]), {"gain": 0.0})["gain"]:
                    best[r["model"], r["node"]] = r
            # Every node's mean, cut or not: the next level's nodes below a node without a cut are its left ones.
            for r in found:
                if r["model"] in grown and r["feature"] >= 0 and level == depth - 1 and (r["model"], r["node"]) not in best:
                    n = r["left_n"] + r["right_n"]
                    grown[r["model"]].leaves[2 * r["node"]] = (r["left"] + r["right"]) / n if n else 0.0
            for (i, node), r in best.items():
                tree, place = grown[i], 2**level - 1 + node
                tree.features[place], tree.cuts[place] = r["feature"], r["cut"]
                gains[i][r["feature"]] = gains[i].get(r["feature"], 0.0) + r["gain"]
                if level == depth - 1:
                    tree.leaves[2 * node], tree.leaves[2 * node + 1] = r["left"] / r["left_n"], r["right"] / r["right_n"]
        for i, tree in grown.items():
            tree.leaves *= self.settings.rate
            m = self.models[i]
            m.trees.append(tree)
            m.gains.append(gains[i])
            if m.table is not None:
                m.table = m.table + tree.values(m.grid(self.settings.bins))

    @staticmethod
    def _judge(model: Model, loss: float, n: int) -> None:
        """Whether the model goes on, from its loss with all trees so far on the rows set aside."""
        if not model.trees or not n:
            return
        loss /= n
        if len(model.losses) == PATIENCE and not any(loss + TOLERANCE < before for before in model.losses):
            model.live = False
        model.losses.append(loss)

    def _source(self) -> DataFrame:
        return self.rows if self.margins is None else self.margins

    def _valued(self) -> Callable[[int, Block, Rows], np.ndarray]:
        """A model's margins, all trees so far applied, of some rows of a block."""
        models, applied, bins, place = self.models, self.applied, self.settings.bins, {i: j for j, i in enumerate(self.large)}
        walks: dict[int, Walk] = {}

        def value(i: int, block: Block, rows: Rows) -> np.ndarray:
            m = models[i]
            if m.table is not None:
                return m.table.take(m.cells(rows.x, bins))
            if i not in walks:
                walks[i] = Walk(m.trees[applied:], m.features, bins)
            return walks[i].add(np.full(len(rows.at), m.start) if block.margin is None else block.margin[place[i]].take(rows.at), rows)

        return value

    def _refresh(self, last: bool = False) -> None:
        """Writes the margins that are kept by row, with all trees so far. last: no pass follows, so only predictions use them."""
        if not self.large or (last and self.applied == max(len(self.models[i].trees) for i in self.large) and self.margins is not None):
            return
        large, value, bins = self.large, self._valued(), self.settings.bins

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for j, row in enumerate(batch.select([c for c in batch.schema.names if c != "keys"]).to_pylist()):
                    block = Block(row, bins)
                    every = Rows(block, np.arange(len(block.h)), bins)
                    margin = np.stack([value(i, block, every) for i in large])
                    own = batch.slice(j, 1)
                    yield pa.RecordBatch.from_arrays([*[own.column(c) for c in ("keys", "h", "fold", "y", "x")], pa.array([margin.tobytes()], pa.binary())], ["keys", "h", "fold", "y", "x", "margin"])

        self.margins = staged(self._source().mapInArrow(run, f"keys array<{self.key_type}>, h binary, fold binary, y binary, x binary, margin binary"), "boosting-margins", packed=True)
        self.applied = max(len(self.models[i].trees) for i in self.large)

    def _pass(self, t: int, level: int, grown: dict[int, Tree]) -> list:
        """Best cut by model, node and feature; at level 0 also each model's loss on the rows set aside (feature -1)."""
        models, bins, s, nodes, value, folds = self.models, self.settings.bins, self.settings, 2**level, self._valued(), np.array(self.folds)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Features are counted by twos: sums by node and both their bins.
            pairs = {i: _pairs(models[i].features) for i in grown if models[i].table is None}
            sums = {(i, j): np.zeros((2, nodes * bins ** len(p))) for i in pairs for j, p in enumerate(pairs[i])}
            # Margins that are tabled are the same for all rows of a combination: sums of the target by fold and combination do.
            tabled = {tuple(models[i].features): i for i in grown if models[i].table is not None}
            by_cell = {c: np.zeros((2, len(folds) * len(models[i].table))) for c, i in tabled.items()}
            loss = {i: np.zeros(2) for i in grown}
            some = False
            for batch in batches:
                for row in batch.to_pylist():
                    some = True
                    block = Block(row, bins)
                    aside = _aside(block.h, s)
                    drawn = ~aside & (chance(block.h, t + 1) < s.subsample)
                    every = Rows(block, np.flatnonzero(drawn), bins)
                    y, place = block.y.take(every.at), np.searchsorted(folds, block.fold.take(every.at))
                    for c, i in tabled.items():
                        code, out = place * len(models[i].table) + models[i].cells(every.x, bins), by_cell[c]
                        np.add.at(out[0], code, y)
                        np.add.at(out[1], code, 1.0)
                    for fold in sorted({models[i].fold for i in (grown if level == 0 else pairs)}):
                        inside = block.fold != fold
                        own, held = (Rows(block, np.flatnonzero(inside & side), bins) for side in (drawn, aside))
                        y, yh = block.y.take(own.at), block.y.take(held.at)
                        for i, tree in grown.items():
                            if models[i].fold != fold:
                                continue
                            if level == 0:
                                loss[i] += ((yh - value(i, block, held)) ** 2).sum(), len(yh)
                            if i not in pairs:
                                continue
                            residual, at = y - value(i, block, own), tree.nodes(own.x, level).astype(np.int64) if level else None
                            for j, pair in enumerate(pairs[i]):
                                place = own.code(pair) if at is None else at * bins ** len(pair) + own.code(pair)
                                out = sums[i, j]
                                out[0] += np.bincount(place, residual, out.shape[1])
                                out[1] += np.bincount(place, minlength=out.shape[1])
            if some:
                rows = []
                for (i, j), v in sums.items():
                    v = v.reshape(2, nodes, *[bins] * len(pairs[i][j]))
                    rows += [(i, f, np.ascontiguousarray(v if v.ndim == 3 else v.sum(axis=3 - k)).tobytes()) for k, f in enumerate(pairs[i][j])]
                for i in [i for i in grown if i not in pairs]:
                    m = models[i]
                    total, n = by_cell[tuple(m.features)].reshape(2, len(folds), -1)[:, folds != m.fold].sum(axis=1)
                    grid, total = m.grid(bins), total - m.table * n
                    at = grown[i].nodes(grid, level).astype(np.int64) * bins
                    rows += [(i, f, np.concatenate([np.bincount(at + grid[f], v, nodes * bins) for v in (total, n)]).tobytes()) for f in m.features]
                if level == 0:
                    rows += [(i, -1, v.tobytes()) for i, v in loss.items()]
                a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(c, pa.binary())], ["model", "feature", "sums"])

        def cut(group: pa.Table) -> pa.Table:
            feature = group.column("feature")[0].as_py()
            # In order of their bytes, so that sums don't depend on the order of arrival.
            total = sum(np.frombuffer(b) for b in sorted(group.column("sums").to_pylist()))
            out = []
            if feature < 0:
                out.append((0, total[0], -1, 0.0, total[1], 0.0, 0.0))
            else:
                total = total.reshape(2, nodes, bins)
                for node in range(nodes):
                    gain, at = best_cut(total[0, node], total[1, node])
                    left, n_left = total[0, node, : at + 1].sum(), total[1, node, : at + 1].sum()
                    out.append((node, gain, at, left, n_left, total[0, node].sum() - left, total[1, node].sum() - n_left))
            names = ["node", "gain", "cut", "left", "left_n", "right", "right_n"]
            own = dict(zip(names, zip(*out, strict=True), strict=True))
            own = {k: pa.array(v, pa.int32() if k in ("node", "cut") else pa.float64()) for k, v in own.items()}
            return pa.table({"model": pa.array([group.column("model")[0].as_py()] * len(out), pa.int32()), "feature": pa.array([feature] * len(out), pa.int32()), **own})

        source = self._source()
        found = source.select([c for c in source.columns if c != "keys"]).mapInArrow(run, "model int, feature int, sums binary")
        schema = "model int, feature int, node int, gain double, cut int, left double, left_n double, right double, right_n double"
        return found.groupBy("model", "feature").applyInArrow(cut, schema).collect()

    def predicted(self) -> DataFrame:
        """key and, for every subset, a column with each row's prediction by the model that hasn't seen its fold."""
        models, names, served, value, bins = self.models, list(self.subsets), self.served, self._valued(), self.settings.bins

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for j, row in enumerate(batch.select([c for c in batch.schema.names if c != "keys"]).to_pylist()):
                    block = Block(row, bins)
                    found = {s: np.zeros(len(block.h)) for s in served.values()}
                    for i, m in enumerate(models):
                        own = np.flatnonzero(block.fold == m.fold)
                        if len(own) and m.fold != WHOLE:
                            found[m.subset][own] = value(i, block, Rows(block, own, bins))
                    keys = batch.column("keys").slice(j, 1).flatten()
                    yield pa.RecordBatch.from_arrays([keys, *[pa.array(found[served[n]]) for n in names]], ["key", *[f"p{i}" for i in range(len(names))]])

        found = self._source().mapInArrow(run, f"key {self.key_type}, " + ", ".join(f"p{i} double" for i in range(len(names))))
        return found.select("key", *[F.col(f"p{i}").alias(n) for i, n in enumerate(names)])

    def importances(self, subset: str) -> dict[str, float]:
        """Each feature's share of the improvements of the model of all rows."""
        model = next(m for m in self.models if m.subset == self.served[subset] and m.fold == WHOLE)
        total = np.zeros(len(self.columns))
        for gains in model.gains:
            for f, g in gains.items():
                total[f] += g
        total = total / total.sum() if total.sum() > 0 else total
        return {c: float(total[self.columns.index(c)]) for c in self.subsets[subset]}


def _aside(h: np.ndarray, settings: Settings) -> np.ndarray:
    """Rows that only judge when to stop."""
    return (h & ((1 << 20) - 1)) < int(settings.validation * (1 << 20))


def boosted(df: DataFrame, key: str, y: str, fold: str, subsets: dict[str, list[str]], settings: Settings | None = None, whole: tuple[str, ...] = ()) -> Boosting:
    """A finished run over df's rows."""
    run = Boosting(df, key, y, fold, subsets, settings, whole)
    run.train()
    return run
