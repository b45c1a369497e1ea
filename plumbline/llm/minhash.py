"""Operator 5: near-duplicate groups by b-bit MinHash.

Every text becomes the set of its distinct word shingles (64-bit hashes). HASHES minima of the set are banded for
candidates, then only their BITS low bits are kept, packed as bit planes in longs, so that the share of agreeing
minima of two texts is a bit count and the similarity follows by correcting for chance agreements, 1 / 2**BITS.

1. Rows with equal sets are one class; its smallest id stands for it. Copies, however many, cost one row from here.
2. Candidates: in every band bucket each class meets the bucket's centre only, the class with the smallest share of
   shingles that no other candidate class has. Pairs go that are ruled out by their sizes, by those own shingles, or
   by a corrected estimate five standard errors below the threshold; the others are confirmed on full sets.
   What a pair's confirmation leaves is each set as its centre's set less some shingles and with some others.
3. Components of the confirmed links. In buckets whose classes are in several components, all pairs between different
   components are candidates. One side of such a pair is outside the centre's component, so only those outside meet
   the others, by squares of at most BLOCK on each side, which spreads a large bucket over tasks. Two sets that are
   known by their differences from one centre are compared by these short lists, inside the join, which gives links
   only; the other pairs, between sets unlike their centre, are confirmed on full sets. So every candidate pair is
   confirmed, ruled out, or already connected, and a group of near copies doesn't emit its pairs: those far from the
   centre have too many shingles of their own to be candidates.

Classes are told apart by 128 bits and the set's size, and numbered when they are written.

Cases: null, empty and blank texts have no set and link with nothing; a text of fewer words than a shingle is one
shingle; rows that share an id are one document with several texts, linked through that id; a null id takes part in
links of others under no id and gets a null component unless linked; ids may be of any type that has an order; an
empty table gives no rows; only the named columns are read. Candidates are found with a chance of 1 - (1 - s**5)**25 at similarity s, so one link in 2 million
of those at 0.85 is missed, and fewer above.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import in_pieces, likely_among, share_package, written
from plumbline.llm.components import components

ROWS, BANDS = 5, 25
HASHES, BITS = 128, 4
#: Members of a bucket on each side of one square of pairs.
BLOCK = 4096
#: What tells classes apart.
KEY = ["k1", "k2", "n"]
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; overwrites nothing."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Random values of the bytes, blank bytes, and the multipliers and offsets of the permutations."""
    draw = np.random.default_rng(20240817)
    blank = np.zeros(256, bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    value = draw.integers(1, 2**63, 256, dtype=np.uint64)
    value[ord("A") : ord("Z") + 1] = value[ord("a") : ord("z") + 1]
    return value, blank, draw.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1), draw.integers(0, 2**32, HASHES, dtype=np.uint32)


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    return np.cumprod(np.r_[np.uint64(1), np.full(max(n - 1, 0), base, np.uint64)], dtype=np.uint64)[:n]


#: An odd number and its inverse modulo 2**64, the base of the words' polynomial hashes.
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of UTF-8 bytes, A-Z as a-z."""
    value, blank, _, _ = tables()
    inside = ~blank[raw]
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.r_[np.uint64(0), np.cumsum(value[raw] * powers(len(raw), _BASE), dtype=np.uint64)]
    hashes = (total[ends] - total[starts]) * powers(len(raw) + 1, _INVERSE)[starts]
    return mixed(hashes + (ends - starts).astype(np.uint64) * _MIX[0]), starts


def shingle_sets(texts: list[str], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for start, end in in_pieces(texts, 500_000):
        parts = [t.encode("utf-8", "surrogatepass") for t in texts[start:end]]
        hashes, at = word_hashes(np.frombuffer(b"\n".join(parts), np.uint8))
        bounds = np.r_[0, np.cumsum([len(p) + 1 for p in parts])]
        cut = np.searchsorted(at, bounds)
        for low, high in zip(cut[:-1], cut[1:], strict=True):
            own = hashes[low:high]
            width = min(words, len(own))
            if not width:
                yield np.zeros(0, np.uint64)
                continue
            h = np.full(len(own) - width + 1, width, np.uint64)
            for i in range(width):
                h = mixed(h * _MIX[0] + own[i : len(own) - width + 1 + i])
            yield np.unique(h)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The set's minimum under each of the HASHES permutations."""
    _, _, factor, offset = tables()
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(x), 2048):
        h = x[start : start + 2048, None] * factor + (low[start : start + 2048, None] ^ offset)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        np.minimum(best, h.min(axis=0), out=best)
    return best


def sketch(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """id, n (size of the set), k1 and k2 (128 bits that stand for the set), bands, planes (low bits of the minima)."""
    share_package(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, key, bands, planes = [], [], [], []
            for s in shingle_sets(batch.column("text").to_pylist(), words):
                size.append(len(s))
                key.append((mixed(s + _MIX[1]).sum(dtype=np.uint64), mixed(s ^ _MIX[2]).sum(dtype=np.uint64)))
                if not len(s):
                    bands.append(None)
                    planes.append(None)
                    continue
                m = minima(s)
                h = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[0]
                for column in m[: ROWS * BANDS].reshape(BANDS, ROWS).astype(np.uint64).T:
                    h = mixed(h * _MIX[1] + column)
                bands.append(h.astype(np.int64))
                bits = [np.packbits((m >> np.uint32(b)) & np.uint32(1)).view(np.int64) for b in range(BITS)]
                planes.append(np.concatenate(bits))
            keys = np.array(key, np.uint64).reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(size, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(bands, pa.list_(pa.int64())), pa.array(planes, pa.list_(pa.int64()))],
                ["id", "n", "k1", "k2", "bands", "planes"],
            )

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n long, k1 long, k2 long, bands array<long>, planes array<long>")


def full_sets(docs: DataFrame, words: int, text_col: str) -> DataFrame:
    """n, k1, k2, shingles of every row."""
    source = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, key, sets = [], [], []
            for s in shingle_sets(batch.column("text").to_pylist(), words):
                size.append(len(s))
                key.append((mixed(s + _MIX[1]).sum(dtype=np.uint64), mixed(s ^ _MIX[2]).sum(dtype=np.uint64)))
                sets.append(s.view(np.int64))
            keys = np.array(key, np.uint64).reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(size, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(sets, pa.list_(pa.int64()))], ["n", "k1", "k2", "shingles"])

    return source.mapInArrow(run, "n long, k1 long, k2 long, shingles array<long>")


def estimate(a: str, b: str) -> Column:
    """Similarity of two packed signatures: the share of agreeing minima, corrected for agreement by chance."""
    longs = HASHES // 64
    differ = reduce(lambda x, y: x + y, [F.bit_count(reduce(lambda x, y: x.bitwiseOR(y), [F.col(a)[i + longs * p].bitwiseXOR(F.col(b)[i + longs * p]) for p in range(BITS)])) for i in range(longs)])
    agree = 1 - differ.cast("double") / HASHES
    return (agree - 2.0**-BITS) / (1 - 2.0**-BITS)


def plausible(percent: int, a: str, b: str) -> Column:
    """What pairs may reach the threshold.

    Two sets share at most what each has beside its own shingles, n - u; this bounds their similarity exactly, sizes
    included. And the estimate must not be five standard errors below the threshold.
    """
    s = percent / 100
    chance = s + (1 - s) / 2**BITS
    error = (chance * (1 - chance) / HASHES) ** 0.5 / (1 - 2.0**-BITS)
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    most = F.least(n - F.col(f"{a}u"), m - F.col(f"{b}u"))
    return (100 * most >= percent * (n + m - most)) & (estimate(f"{a}planes", f"{b}planes") >= s - 5 * error)


class Groups:
    """The steps of one run, over the classes of equal sets."""

    def __init__(self, docs: DataFrame, words: int, percent: int, id_col: str, text_col: str):
        self.docs, self.words, self.percent, self.id_col, self.text_col = docs, words, percent, id_col, text_col
        self.rows = written(sketch(docs, words, id_col, text_col), "minhash-rows")
        # Equal sets have equal sketches, so any of a class will do: min() takes one without a sort.
        classes = self.rows.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("id").alias("smallest"), F.min("bands").alias("bands"), F.min("planes").alias("planes"))
        self.classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")
        bands = self.classes.select("node", F.explode("bands").alias("band"))
        shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("band")
        self.shared = written(bands.join(shared, "band", "left_semi"), "minhash-shared")
        self.candidates = written(self.shared.select("node").distinct(), "minhash-candidates")

    def sets(self) -> DataFrame:
        """node, n, shingles of the classes that share a bucket with another: the only ones whose sets are needed."""
        chosen = written(self.classes.join(self.candidates, "node", "left_semi").select("node", "k1", "k2", "n", F.col("smallest").alias("of")), "minhash-chosen")
        # One text for each class: rows of its smallest id, by id first, so that only those rows' texts move.
        texts = self.docs.select(F.col(self.id_col).alias("mid"), F.col(self.text_col).alias("mtext"))
        of = written(chosen.select("of").distinct(), "minhash-of")
        texts = likely_among(texts, F.col("mid"), of).join(of, F.col("mid").eqNullSafe(F.col("of")), "left_semi")
        one = full_sets(texts, self.words, "mtext").join(chosen.select("node", *KEY), KEY).select("node", "n", "shingles")
        return written(one.dropDuplicates(["node"]), "minhash-sets")

    def members(self, sets: DataFrame) -> DataFrame:
        """band, node, n, u, planes of every place in a shared bucket; u: shingles that no other candidate class has."""
        once = sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("times"), F.min("node").alias("own")).where("times = 1")
        own = once.groupBy("own").agg(F.count(F.lit(1)).alias("u"))
        facts = self.classes.select("node", "n", "planes").join(self.candidates, "node", "left_semi").join(own, F.col("node") == F.col("own"), "left")
        facts = written(facts.select("node", "n", F.coalesce("u", F.lit(0)).cast("long").alias("u"), "planes"), "minhash-facts")
        return written(self.shared.join(facts, "node"), "minhash-members")

    def centres(self, members: DataFrame) -> DataFrame:
        """cband and the facts of its centre: cnode, cn, cu, cplanes."""
        order = F.struct((F.col("u") / F.col("n")).alias("share"), F.col("node").alias("cnode"), F.col("n").alias("cn"), F.col("u").alias("cu"), F.col("planes").alias("cplanes"))
        return members.groupBy("band").agg(F.min(order).alias("c")).select(F.col("band").alias("cband"), "c.*").drop("share")

    def star(self, members: DataFrame, centres: DataFrame) -> DataFrame:
        """Plausible pairs of each member with its bucket's centre."""
        pairs = members.join(centres, (F.col("band") == F.col("cband")) & (F.col("node") != F.col("cnode")) & plausible(self.percent, "", "c"))
        return pairs.select(F.col("node").alias("a"), F.col("cnode").alias("b")).distinct()

    def compared(self, pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        """a, b, less and more (a's set is b's less the one and with the other), link (the full sets reach the threshold)."""
        left = sets.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("shingles").alias("as"))
        right = sets.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("shingles").alias("bs"))
        both = pairs.join(left, "a").join(right, "b").withColumn("less", F.array_except("bs", "as")).withColumn("more", F.array_except("as", "bs"))
        same = (F.col("bn") - F.size("less")).cast("long")
        return written(both.select("a", "b", "less", "more", (100 * same >= self.percent * (F.col("an") + F.col("bn") - same)).alias("link")), name)

    def between(self, members: DataFrame) -> DataFrame:
        """a, b, exact: pairs of members of a bucket in different components. Exact ones are links, others plausible.

        members: with main (the label of the bucket's centre), many (of the bucket) and outside (not labelled main).
        """
        place = lambda of: F.pmod(F.xxhash64("node"), F.ceil(F.col(of) / BLOCK)).cast("int")
        every = lambda of: F.explode(F.sequence(F.lit(0), F.ceil(F.col(of) / BLOCK).cast("int") - 1))
        other = members.withColumn("row", place("many")).withColumn("column", every("outside"))
        other = other.select(*[F.col(c).alias(f"c{c}") for c in ("band", "row", "column", "node", "n", "u", "planes", "label", "less", "more")])
        members = members.where("label <> main").withColumn("row", every("many")).withColumn("column", place("outside"))
        apart = (F.col("band") == F.col("cband")) & (F.col("row") == F.col("crow")) & (F.col("column") == F.col("ccolumn"))
        apart &= (F.col("label") != F.col("clabel")) & ((F.col("clabel") == F.col("main")) | (F.col("label") < F.col("clabel")))
        exact = F.col("less").isNotNull() & F.col("cless").isNotNull()
        same = F.col("centre_n") - F.size(F.array_union("less", "cless")) + F.size(F.array_intersect("more", "cmore"))
        reach = 100 * same >= self.percent * (F.col("n") + F.col("cn") - same)
        pairs = members.join(other, apart & plausible(self.percent, "", "c") & F.when(exact, reach).otherwise(True))
        return pairs.select(F.col("node").alias("a"), F.col("cnode").alias("b"), exact.alias("exact")).distinct()

    def links(self) -> DataFrame:
        """Confirmed links between classes that connect all that candidates can connect."""
        sets = self.sets()
        members = self.members(sets)
        centres = written(self.centres(members), "minhash-centres")
        near = self.compared(self.star(members, centres), sets, "minhash-near")
        links = near.where("link").select("a", "b")
        labels = components(links).select(F.col("node").alias("lnode"), F.col("label").alias("llabel"))
        named = members.join(labels, F.col("node") == F.col("lnode"), "left").withColumn("label", F.coalesce("llabel", "node")).drop("lnode", "llabel")
        named = written(named, "minhash-named")
        main = centres.join(labels, F.col("cnode") == F.col("lnode"), "left")
        main = main.select(F.col("cband").alias("band"), "cnode", F.col("cn").alias("centre_n"), F.coalesce("llabel", "cnode").alias("main"))
        named = named.join(main, "band")
        sizes = named.groupBy("band").agg(F.count(F.lit(1)).alias("many"), F.count_if(F.col("label") != F.col("main")).alias("outside")).where("outside > 0")
        mixed = named.join(sizes, "band")
        known = near.select(F.col("a").alias("node"), F.col("b").alias("cnode"), "less", "more")
        mixed = mixed.join(known, ["node", "cnode"], "left")
        none = F.array().cast("array<bigint>")
        for c in ("less", "more"):
            mixed = mixed.withColumn(c, F.when(F.col("node") == F.col("cnode"), none).otherwise(F.col(c)))
        pairs = written(self.between(written(mixed.drop("cnode"), "minhash-mixed")), "minhash-between")
        far = self.compared(pairs.groupBy("a", "b").agg(F.bool_or("exact").alias("exact")).where("not exact").select("a", "b"), sets, "minhash-far")
        return links.union(pairs.where("exact").select("a", "b")).union(far.where("link").select("a", "b"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id, kept for every row: groups of texts whose sets share percent or more."""
    run = Groups(docs, words, percent, id_col, text_col)
    links = run.links()
    # Rows that share an id tie their classes, too.
    several = run.rows.where("n > 0 and id is not null").groupBy("id").agg(F.min(F.xxhash64(*KEY)).alias("low"), F.max(F.xxhash64(*KEY)).alias("high")).where("low <> high").select("id")
    own = run.rows.where("n > 0").join(several, "id", "left_semi").select("id", *KEY).distinct()
    own = written(own.join(run.classes.select("node", *KEY), KEY).select("id", "node"), "minhash-ids")
    ties = own.join(own.groupBy("id").agg(F.min("node").alias("a")), "id").select("a", F.col("node").alias("b"))
    labels = components(links.union(ties)).select(F.col("node").alias("lnode"), "label")
    named = run.classes.select("node", *KEY, "smallest").join(labels, F.col("node") == F.col("lnode"), "left").select(*KEY, "smallest", F.coalesce("label", "node").alias("label"))
    lowest = named.groupBy("label").agg(F.min("smallest").alias("component")).withColumnRenamed("label", "to")
    ids = written(named.join(lowest, F.col("label") == F.col("to")).select(*KEY, "component"), "minhash-components")
    joined = run.rows.select("id", *KEY).join(ids, KEY, "left").withColumn("component_id", F.coalesce("component", "id"))
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, of the document that stays of each group: its smallest id."""
    kept = near_duplicates(docs, words, percent, id_col, text_col).where("kept").select(F.col(id_col).alias("_kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept_id"]), "left_semi")
