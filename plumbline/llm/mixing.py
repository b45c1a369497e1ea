"""Operator 2: mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents, in a hashed order, form one stream of words that is cut into blocks. Water-filling turns the
weights into word targets, and these into exact block quotas: whole passes over the source, and some blocks of one more
pass. A binary tree over the output shards splits the vector of quotas at every node by a multivariate hypergeometric
draw, so that every shard gets its number of blocks and a mix that random dealing would give. The blocks of a pass are
permuted; a shard owns a run of the permuted blocks, as long as its quota and its share of the blocks that nobody
takes, and draws its quota from it. Runs are disjoint, so are the drawn blocks. One block of the last pass is cut, so
that a source's words come out as targeted. Inside the shard all blocks are shuffled by a hash.

Sources may be any number. Groups of GROUP_SOURCES neighbours in code point order get their quotas from a tree over the
groups, their sources from a tree inside the group: drawing from groups first gives the same law. A document's place in
its source's stream is found without sorting a source in one task: rows fall into hashed chunks, words are summed over
chunks and then inside each. Rows of equal id, source and size are one row with a count until they are placed, so that
no key, null ids included, gathers in a task. Everything follows from ids and the seed: reruns agree.

Cases: null texts have size 0 and nothing to take; a null source is a source of its own, last; a null id is one more
id; repeated rows stand apart in the stream and are interchangeable; an empty table gives no rows; only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import floor, log, log1p, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import BLANKS, share_package, written

#: Words of a block at most, and blocks that a source is cut into at least, if it has the words.
BLOCK_WORDS, LEAST_BLOCKS = 256, 256
GROUP_SOURCES = 4096
#: Words of a stream that one task draws from at a time.
CHUNK_WORDS = 1 << 18
#: Shares of a shard's order that its documents are dealt out by.
BUCKETS = 256
#: Population from which numpy's hypergeometric draw is refused.
NUMPY_LIMIT = 1_000_000_000


def log_binomial(k: int, n: int, p: float) -> float:
    """The log of a binomial probability, by Stirling's series and deviances, so that large counts lose nothing."""
    if k == 0 or k == n:
        return n * (log1p(-p) if k == 0 else log(p))

    def error(m: int) -> float:
        """log(m!) less Stirling's formula."""
        if m < 16:
            return sum(log(i) for i in range(2, m + 1)) - (m + 0.5) * log(m) + m - 0.5 * log(2 * pi)
        return (1 / 12 - (1 / 360 - 1 / 1260 / m**2) / m**2) / m

    def deviance(x: int, mean: float) -> float:
        d = (x - mean) / mean
        return mean * ((1 + d) * log1p(d) - d)

    return error(n) - error(k) - error(n - k) - deviance(k, n * p) - deviance(n - k, n * (1 - p)) - 0.5 * log(2 * pi * k * (1 - k / n))


def hypergeometric(draw: np.random.Generator, good: int, bad: int, need: int) -> int:
    """How many of need draws without replacement are good. Past numpy's limit by ratio of uniforms from the same law."""
    total = good + bad
    if not need or not good:
        return 0
    if not bad or need == total:
        return min(good, need)
    if total < NUMPY_LIMIT:
        return int(draw.hypergeometric(good, bad, need))
    p = need / total

    def weight(k: int) -> float:
        return log_binomial(k, good, p) + log_binomial(need - k, bad, p)

    low, high = max(0, need - bad), min(good, need)
    mean, top = need * good / total, weight(min(max((need + 1) * (good + 1) // (total + 2), low), high))
    spread = 1.7155277699214135 * sqrt(mean * (bad / total) * ((total - need) / (total - 1)) + 0.5) + 0.8989161620588988
    while True:
        u = 1 - draw.random()
        k = floor(mean + 0.5 + spread * (draw.random() - 0.5) / u)
        if low <= k <= high and 2 * log(u) <= weight(k) - top:
            return k


def even_parts(total: int, parts: int) -> np.ndarray:
    """total as a sum of so many numbers that differ by 1 at most."""
    return np.diff(np.array([total * i // parts for i in range(parts + 1)], np.int64))


def split_quotas(quotas: np.ndarray, shards: int | Sequence[int], seed: int, tag: int = 0) -> np.ndarray:
    """Quotas of each shard, rows by shards: the splitting tree. shards: how many, or the blocks that each must get."""
    totals = even_parts(int(quotas.sum()), shards) if isinstance(shards, int) else np.asarray(shards, np.int64)
    out = np.zeros((len(quotas), len(totals)), np.int64)

    def node(part: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[:, low] = part
            return
        middle = (low + high) // 2
        draw = np.random.default_rng([seed, tag, low, high])
        left, pool, need = np.zeros_like(part), int(part.sum()), int(totals[low:middle].sum())
        for i, n in enumerate(part.tolist()):
            # A multivariate draw, one row at a time, given those before it.
            left[i] = hypergeometric(draw, n, pool - n, need)
            pool, need = pool - n, need - int(left[i])
        node(left, low, middle)
        node(part - left, middle, high)

    node(quotas, 0, len(totals))
    return out


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A bijection of range(size): four Feistel rounds over the next even power of two, walked until inside."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            h = (right + np.uint64((key * 4 + r) % (1 << 32))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h >> np.uint64(31)) & mask)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    while (outside := np.flatnonzero(out >= size)).size:
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def pass_key(seed: int, place: int, times: int) -> int:
    return seed * 1009 + place * 31 + times


def sized(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """id (as text), source, size of every row."""
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"[^{BLANKS}]+")).cast("long")
    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))


def numbered(sources: DataFrame) -> DataFrame:
    """sources with place: 0, 1, 2 in code point order, null last. Counted by ranges, so that no task sees all."""
    ranged = written(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()), "mix-ranges")
    before, counts = 0, []
    for r in sorted(ranged.groupBy("range").count().collect()):
        counts.append((r["range"], before))
        before += r["count"]
    offsets = sources.sparkSession.createDataFrame(counts, "of int, before long")
    inside = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last()))
    return ranged.withColumn("inside", inside).join(F.broadcast(offsets), F.col("range") == F.col("of")).withColumn("place", F.col("before") + F.col("inside") - 1).drop("range", "of", "before", "inside")


def weight_of(weights: Sequence[float] | dict[str | None, float]) -> Column:
    """The weight of a source: by name, or from a list in turn by place."""
    if not isinstance(weights, dict):
        return F.array(*[F.lit(float(w)) for w in weights])[F.pmod(F.col("place"), F.lit(len(weights))).cast("int")]
    out = F.when(F.col("source").isNull(), F.lit(float(weights[None]))) if None in weights else F
    for name, w in weights.items():
        if name is not None:
            out = out.when(F.col("source") == name, F.lit(float(w)))
    return out.otherwise(F.raise_error(F.concat(F.lit("no weight for source "), F.coalesce("source", F.lit("null")))).cast("double"))


def water_filled(sources: DataFrame, most: int) -> DataFrame:
    """Adds target: shares of all sizes in proportion to weight, none above most times its own size.

    sources: size and weight. Each round is one sum over the sources: those above their most give back what they can't
    take, which lifts the share of the others.
    """
    share, full = 0.0, -1
    while True:
        over = F.lit(share) * F.col("weight") > most * F.col("size") if full >= 0 else F.lit(False)
        r = sources.agg(F.sum("size").alias("total"), F.sum(F.when(over, most * F.col("size"))).alias("given"), F.sum(F.when(~over, F.col("weight"))).alias("open"), F.count_if(over).alias("full")).collect()[0]
        if r["full"] == full or not r["open"]:
            break
        share, full = ((r["total"] or 0) - (r["given"] or 0)) / r["open"], r["full"]
    return sources.withColumn("target", F.least(F.lit(share) * F.col("weight"), (most * F.col("size")).cast("double")))


def group_recipes(shards: int, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What a group's sources draw, from the blocks that each shard gets of the group."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        strata = [(i, r.blocks if t < r.passes else -(-r.rest // r.block_words)) for i, r in enumerate(pdf.itertuples()) for t in range(r.passes + (r.rest > 0))]
        parts = split_quotas(np.array([q for _, q in strata], np.int64), pdf["quotas"].iloc[0], seed, 1 + int(pdf["band"].iloc[0]))
        own: list[list[np.ndarray]] = [[] for _ in range(len(pdf))]
        for (i, _), part in zip(strata, parts, strict=True):
            own[i].append(part)
        rows = []
        for r, quotas in zip(pdf.itertuples(), own, strict=True):
            runs = [np.r_[0, np.cumsum(q + even_parts(int(r.blocks - q.sum()), shards))[:-1]] for q in quotas]
            special = cut(r, runs[-1], quotas[-1], pass_key(seed, r.place, r.passes)) if r.rest else (-1, 0)
            rows.append([q.tolist() for q in quotas] + [x.tolist() for x in runs] + [special])
        out = pdf[["source", "place", "size", "target", "blocks", "block_words"]].copy()
        out["quotas"] = [x[: (len(x) - 1) // 2] for x in rows]
        out["runs"] = [x[(len(x) - 1) // 2 : -1] for x in rows]
        out["special"], out["limit"] = [x[-1][0] for x in rows], [x[-1][1] for x in rows]
        return out

    return of


def cut(r, runs: np.ndarray, quotas: np.ndarray, key: int) -> tuple[int, int]:
    """(place among the permuted blocks, words): the block of the last pass of which only the first words are taken.

    Drawn blocks hold up to a block more than wanted, or less if the source's short last block is one of them.
    """
    last = r.size - (r.blocks - 1) * r.block_words
    at = int(permuted(np.array([r.blocks - 1]), r.blocks, key)[0])
    s = int(np.searchsorted(runs, at, side="right")) - 1
    has_last = at < runs[s] + quotas[s]
    words = int(quotas.sum()) * r.block_words - (r.block_words - last if has_last else 0)
    if words < r.rest:
        free = np.r_[runs[1:], r.blocks] - runs > quotas
        s = int(np.flatnonzero(free)[0])
        return int(runs[s] + quotas[s]), r.rest - words
    if words == r.rest:
        return -1, 0
    drawn = [int(x + i) for x, n in zip(runs, quotas, strict=True) for i in range(min(int(n), 2))]
    whole = next((d for d in drawn if d != at), at)
    return whole, (last if whole == at else r.block_words) - (words - r.rest)


RECIPE = "source string, place long, size long, target double, blocks long, block_words long, quotas array<array<long>>, runs array<array<long>>, special long, limit long"


def make_recipe(rows: DataFrame, weights: Sequence[float] | dict[str | None, float], most: int, block_words: int, shards: int, seed: int) -> DataFrame:
    """What to take of each source: by pass, the quota of every shard and where its run of permuted blocks begins."""
    sources = numbered(rows.groupBy("source").agg(F.sum("size").alias("size")))
    sources = water_filled(written(sources.withColumn("weight", weight_of(weights)), "mix-sources"), most)
    per = F.expr(f"greatest(least(bigint({block_words}), size div {LEAST_BLOCKS}), bigint(1))")
    sources = sources.withColumn("passes", F.when(F.col("size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.greatest("size", F.lit(1))))).otherwise(0).cast("int"))
    rest = F.when((F.col("size") > 0) & (F.col("passes") < most), F.round(F.col("target") - F.col("passes") * F.col("size"))).otherwise(0).cast("long")
    sources = sources.withColumn("rest", F.least(rest, F.col("size"))).withColumn("block_words", per).withColumn("blocks", F.ceil(F.col("size") / F.col("block_words")).cast("long"))
    sources = sources.withColumn("quota", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / F.col("block_words"))).withColumn("band", F.expr(f"place div {GROUP_SOURCES}"))
    sources = written(sources.where("quota > 0 or size >= 0"), "mix-quotas")
    bands = sorted(sources.groupBy("band").agg(F.sum("quota").alias("quota")).collect())
    parts = split_quotas(np.array([r["quota"] for r in bands], np.int64), shards, seed)
    of_band = rows.sparkSession.createDataFrame([(r["band"], p.tolist()) for r, p in zip(bands, parts, strict=True)], "of long, quotas array<long>")
    given = sources.join(of_band, F.col("band") == F.col("of")).drop("of")
    return written(given.groupBy("band").applyInPandas(group_recipes(shards, seed), RECIPE), "mix-recipe")


def placed(rows: DataFrame, seed: int) -> DataFrame:
    """The rows that have words, with start: the words of the same source that stand before the document."""
    own = rows.where("size > 0").groupBy("source", "id", "size").agg(F.count(F.lit(1)).alias("copies"))
    own = written(own.withColumn("key", F.xxhash64(F.lit(seed), "source", "id", "size")), "mix-distinct")
    chunks = max(1, int(own.count() ** 0.5))
    own = own.withColumn("chunk", F.pmod(F.shiftright("key", 20), F.lit(chunks)).cast("int")).withColumn("words", F.col("size") * F.col("copies"))
    of_chunk = own.groupBy("source", "chunk").agg(F.sum("words").alias("words"))
    before = of_chunk.select(F.col("source").alias("of"), F.col("chunk").alias("at"), (F.sum("words").over(Window.partitionBy("source").orderBy("chunk")) - F.col("words")).alias("before"))
    inside = Window.partitionBy("source", "chunk").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumn("inside", F.sum("words").over(inside) - F.col("words"))
    own = own.join(before, F.col("source").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("at")))
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    own = own.select("source", "id", "size", (F.col("before") + F.col("inside")).alias("first"), copy)
    return own.select("source", "id", "size", (F.col("first") + F.col("copy") * F.col("size")).alias("start"))


def pieces(rows: pd.DataFrame, recipe: pd.Series, seed: int) -> pd.DataFrame:
    """A row for each piece of these documents that lies in a drawn block: at (row), pass, shard, block, first, words, order."""
    size, blocks, width, place = (int(recipe[c]) for c in ("size", "blocks", "block_words", "place"))
    low = rows["start"].to_numpy(np.int64)
    high = low + rows["size"].to_numpy(np.int64)
    head, last = low // width, (high - 1) // width
    n = last - head + 1
    at = np.repeat(np.arange(len(n)), n)
    block = head[at] + np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
    begin, stop = np.maximum(low[at], block * width), np.minimum(high[at], (block + 1) * width)
    out = []
    for times, (runs, quotas) in enumerate(zip(recipe["runs"], recipe["quotas"], strict=True)):
        runs, quotas = np.asarray(runs, np.int64), np.asarray(quotas, np.int64)
        spot = permuted(block, blocks, pass_key(seed, place, times))
        shard = np.searchsorted(runs, spot, side="right") - 1
        end = stop
        drawn = spot < runs[shard] + quotas[shard]
        if times == len(recipe["runs"]) - 1 and recipe["special"] >= 0:
            special = spot == recipe["special"]
            drawn |= special
            end = np.where(special, np.minimum(stop, block * width + int(recipe["limit"])), stop)
        keep = drawn & (begin < end)
        mixed = (spot.astype(np.uint64) * np.uint64(8) + np.uint64(times) + np.uint64((seed * 1_000_003 + place * 7919) % (1 << 63))) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        order = ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(1)).astype(np.int64)
        out.append(pd.DataFrame({"at": at, "pass": times, "shard": shard, "block": block, "first": begin - low[at], "words": end - begin, "order": order})[keep])
    columns = ("at", "pass", "shard", "block", "first", "words", "order")
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in columns})


class Mix:
    """One run: rows (id, source, size), start (their places in the streams) and recipe (a row a source)."""

    def __init__(self, docs: DataFrame, weights: Sequence[float] | dict[str | None, float] = (1, 2, 3), most: int = 3, block_words: int = BLOCK_WORDS, shards: int = 64, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text"):
        share_package(docs.sparkSession)
        self.seed = seed
        self.rows = written(sized(docs, id_col, source_col, text_col), "mix-sizes")
        self.recipe = make_recipe(self.rows, weights, most, block_words, shards, seed)
        self.start = placed(self.rows, seed)

    def drawn(self, shape: Callable[[pd.DataFrame, pd.Series, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
        """shape(documents, their source's recipe, their drawn pieces) for every chunk of every source's stream."""
        seed = self.seed
        chunk = f"div {CHUNK_WORDS}"
        rows = self.start.withColumn("chunk", F.expr(f"start {chunk}"))
        recipes = self.recipe.where("size > 0").withColumn("chunk", F.explode(F.expr(f"sequence(bigint(0), (size - 1) {chunk})")))

        def of(pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.reset_index(drop=True)
            return shape(pdf, found.iloc[0], pieces(pdf, found.iloc[0], seed)) if len(pdf) else pd.DataFrame()

        return rows.groupBy("source", "chunk").cogroup(recipes.groupBy("source", "chunk")).applyInPandas(of, schema)

    def pieces(self) -> DataFrame:
        """id, source, start, pass, shard, block, first, words, order: rows of a shard, by order, are its stream.

        first, the piece's first word, counts from 0 in the document.
        """

        def shape(pdf: pd.DataFrame, recipe: pd.Series, found: pd.DataFrame) -> pd.DataFrame:
            own = pdf.loc[found["at"], ["id", "source", "start"]].reset_index(drop=True)
            return pd.concat([own, found.drop(columns="at")], axis=1)

        return self.drawn(shape, "id string, source string, start long, pass int, shard int, block long, first long, words long, order long")

    def totals(self) -> DataFrame:
        """id, size, source_size, target, taken of every row; taken: the words of its drawn pieces."""

        def shape(pdf: pd.DataFrame, recipe: pd.Series, found: pd.DataFrame) -> pd.DataFrame:
            taken = np.bincount(found["at"], found["words"], minlength=len(pdf)).astype(np.int64)
            return pd.DataFrame({"id": pdf["id"], "size": pdf["size"], "source_size": recipe["size"], "target": recipe["target"], "taken": taken})

        some = self.drawn(shape, "id string, size long, source_size long, target double, taken long")
        by = self.recipe.select(F.col("source").alias("of"), F.col("size").alias("source_size"), "target")
        none = self.rows.where("size = 0").join(by, F.col("source").eqNullSafe(F.col("of")))
        return some.union(none.select("id", "size", "source_size", "target", F.lit(0).cast("long")))


def mix_totals(docs: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """id_col, size, source_size, target, taken for every row."""
    kind = docs.schema[id_col].dataType
    return Mix(docs, id_col=id_col, **kw).totals().select(F.col("id").cast(kind).alias(id_col), "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **kw) -> DataFrame:
    """The rows of docs as the mix draws them, in the shards' order: a whole document for each pass that draws its first word.

    Texts without words are in no draw. Rows that share id and source are drawn alike.
    """
    run = Mix(docs, id_col=id_col, source_col=source_col, **kw)

    def shape(pdf: pd.DataFrame, recipe: pd.Series, found: pd.DataFrame) -> pd.DataFrame:
        found = found[found["first"] == 0]
        own = pdf.loc[found["at"], ["id", "source", "start"]].reset_index(drop=True)
        return pd.concat([own, found[["shard", "order"]].reset_index(drop=True)], axis=1)

    heads = run.drawn(shape, "id string, source string, start long, shard int, order long")
    one = run.start.groupBy(F.col("id").alias("of"), F.col("source").alias("from")).agg(F.min("start").alias("at"))
    picked = heads.join(one, F.col("id").eqNullSafe(F.col("of")) & F.col("source").eqNullSafe(F.col("from")) & (F.col("start") == F.col("at")))
    picked = picked.select(F.col("id").alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("shard").alias("_mix_shard"), F.col("order").alias("_mix_order"))
    joined = docs.join(picked, docs[id_col].cast("string").eqNullSafe(picked["_mix_id"]) & docs[source_col].cast("string").eqNullSafe(picked["_mix_source"]))
    # A bucket is a range of a shard's order: buckets spread over partitions, and each lies in order inside its own.
    joined = joined.withColumn("_mix_bucket", F.expr(f"_mix_order div {(1 << 63) // BUCKETS}"))
    return joined.repartition("_mix_shard", "_mix_bucket").sortWithinPartitions("_mix_shard", "_mix_order").select(*docs.columns)
