"""Operator 8: document fingerprints by SpotSigs, in DataFrame functions only.

A signature is a common-word anchor with the chain of the next CHAIN content words after it. A document's fingerprint is
its set of distinct signatures, hashed, in order. Two fingerprints compare by a pruned Jaccard similarity: sets are
partitioned by length, so that sets two partitions apart can't reach the least likeness and aren't looked at; nor are
those whose beginnings, which two sets of that likeness share something of in any common order, have nothing in common.
What is below the least likeness counts as 0.

Cases: null counts as empty; an empty text, or one without letters, has the empty fingerprint; a text with words but
no signature has one made of all its words; two empty sets are alike (1.0), an empty and another are not (0.0); rows
that share an id follow each other by a hash of their text, and a null id comes after all others; ids may be of any type
that has an order; repeated rows give repeated results; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import written

#: Common words of English, German, French and Spanish.
ANCHORS = """
a an and are as at be but by for from had has have he in is it its not of on or she that the they this to was were
which will with you aber als auch auf aus bei bin das dass dem den der des die du ein eine einem einen einer er es
für hat ich ihr im ist mit nach nicht noch oder sein sich sie sind so über um und uns von vor war wie wir zu zum zur
au aux avec ce ces comme dans de du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour
qui que sa se ses son sur un une vous y al como con del el ella ellos era esta este ha lo los las más mi muy no para
pero por porque que se si sin sobre su sus también una uno ya yo
""".split()  # fmt: skip
CHAIN = 2
#: Likeness below which two fingerprints count as unlike.
LEAST = 0.05
#: Documents in one window of neighbours; more where there would be over MOST_WINDOWS windows.
WINDOW_ROWS, MOST_WINDOWS = 512, 16_384
#: Keys that are looked at for each window's bound.
SAMPLED = 8


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once: inside higher-order functions, a named column would be repeated."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def signatures(text: Column, anchors: list[str] | None = None, chain: int = CHAIN) -> Column:
    """The sorted distinct hashes of a text's signatures, array<int>."""
    common = sorted(set(anchors or ANCHORS))

    def of(words: Column) -> Column:
        content = F.filter(words, lambda x: ~x.isin(common))
        at = F.filter(F.transform(words, lambda x, i: F.struct(x.alias("word"), i.alias("i"))), lambda a: a["word"].isin(common))

        def chains(content: Column) -> Column:
            # i - j content words stand before the j-th anchor, which is word i: there its chain begins.
            starts = F.transform(at, lambda a, j: F.struct(a["word"].alias("word"), (a["i"] - j).alias("k")))
            full = F.filter(starts, lambda a: a["k"] + chain <= F.size(content))
            return F.transform(full, lambda a: F.hash(a["word"], *[F.get(content, a["k"] + c) for c in range(chain)]))

        found = let(content, chains)
        whole = F.when(F.size(words) == 0, F.array().cast("array<int>")).otherwise(F.array(F.hash(F.array_join(words, " "))))
        return let(found, lambda f: F.when(F.size(f) > 0, F.array_sort(F.array_distinct(f))).otherwise(whole))

    return let(F.filter(F.split(F.lower(text), "[^\\p{L}]+"), lambda x: x != ""), of)


def written_out(sigs: Column) -> Column:
    """A fingerprint as text: eight hex digits for each signature."""
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), "")


def length_part(n: Column, least: float) -> Column:
    """The partition of a set's length: each is as long as the next times least."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / math.log(1 / least)).cast("int")


def likeness(a: Column, b: Column, least: float = LEAST) -> Column:
    """Jaccard similarity of two ordered sets of signatures if it is least or more, else 0."""
    n, m = F.size(a), F.size(b)
    head = lambda x, size: F.slice(x, F.lit(1), size - F.ceil(size * F.lit(least)).cast("int") + 1)
    same = F.size(F.array_intersect(a, b))
    jaccard = same / F.greatest(n + m - same, F.lit(1))
    return (
        F.when((n == 0) & (m == 0), F.lit(1.0)).when((n == 0) | (m == 0), F.lit(0.0))
        .when(F.abs(length_part(n, least) - length_part(m, least)) > 1, F.lit(0.0))
        .when(~F.arrays_overlap(head(a, n), head(b, m)), F.lit(0.0))
        .otherwise(F.when(jaccard >= least, jaccard).otherwise(F.lit(0.0)))
    )


def in_windows(rows: DataFrame) -> DataFrame:
    """rows (id, tie and more) with window: neighbours by id, then tie, share one, and later windows have larger ones.

    Bounds come from a sample of the keys by their hash, of about SAMPLED keys a window, whatever the table's size. They
    are looked up by two steps of about the root of their number.
    """
    n = rows.select("id").count()
    windows = min(MOST_WINDOWS, -(-n // WINDOW_ROWS))
    if windows < 2:
        return rows.withColumn("window", F.lit(0))
    some = F.pmod(F.xxhash64("id", "tie"), F.lit(max(1, n // (SAMPLED * windows)))) == 0
    keys = [r[0] for r in rows.where(some).select("id", "tie").distinct().orderBy("id", "tie").select(F.to_json(F.struct("id", "tie"))).collect()]
    bounds = keys[:: max(1, len(keys) // windows)][1:]
    if not bounds:
        return rows.withColumn("window", F.lit(0))
    width = math.isqrt(len(bounds)) + 1
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    kind = rows.schema["id"].dataType.simpleString()
    text = "[" + ",".join("[" + ",".join(g) + "]" for g in groups) + "]"
    of = F.from_json(F.lit(text), f"array<array<struct<id:{kind},tie:bigint>>>")
    heads = F.from_json(F.lit("[" + ",".join(g[0] for g in groups) + "]"), f"array<struct<id:{kind},tie:bigint>>")
    key = F.struct("id", "tie")
    reached = lambda among: F.size(F.filter(among, lambda bound: bound <= key))
    rows = rows.withColumn("group", reached(heads))
    return rows.withColumn("window", F.when(F.col("group") == 0, 0).otherwise((F.col("group") - 1) * width + reached(F.get(of, F.col("group") - 1)))).drop("group")


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, sigs and those of the next document in descending id: next_text, next_sigs. The last's is the first.

    A window's last document finds its next in a copy of the next window's first, so that texts are shuffled once.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = in_windows(rows.withColumn("tie", F.xxhash64("text")))
    # First of each window: by key first, so that only these rows' texts move.
    key = F.struct("id", "tie")
    top = rows.groupBy("window").agg(F.max(key).alias("high")).select(F.col("window").alias("w"), "high")
    heads = rows.join(F.broadcast(top), (F.col("window") == F.col("w")) & key.eqNullSafe(F.col("high")))
    heads = written(heads.groupBy("window").agg(F.first("id").alias("id"), F.first("tie").alias("tie"), F.first("text").alias("text")), "spot-heads")
    order = Window.orderBy(F.desc("window"))
    to = heads.select("window").withColumn("to", F.lag("window").over(order))
    last = heads.agg(F.min("window").alias("low"), F.max("window").alias("high"))
    to = to.join(F.broadcast(last), F.col("window") == F.col("high"), "left").select(F.col("window").alias("own"), F.coalesce("to", "low").alias("to"))
    extra = heads.join(to, F.col("window") == F.col("own")).select("id", "text", "tie", F.col("to").alias("window"), F.lit(1).alias("copy"))
    # Dealt out before signatures are made: these needn't move.
    all_rows = rows.withColumn("copy", F.lit(0)).unionByName(extra).repartition("window").withColumn("sigs", signatures(F.col("text")))
    down = Window.partitionBy("window").orderBy("copy", F.col("id").desc_nulls_last(), F.desc("tie"))
    near = all_rows.withColumn("next", F.lead(F.struct("text", "sigs")).over(down)).where("copy = 0")
    return near.select("id", "text", "sigs", F.col("next.text").alias("next_text"), F.col("next.sigs").alias("next_sigs"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row."""
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_sigs", signatures(F.col("edited")))
    return rows.select(
        F.col("id").alias(id_col), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written_out(F.col("sigs")).alias("fingerprint"), written_out(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def similar(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members are id_col and class (rows of equal fingerprints), pairs are classes a < b, likeness.

    Sets are partitioned by length, each partition threshold times as long as the next: a set can only reach the
    threshold with sets of its own partition and the next. There, two sets that reach it share one of the rarest
    signatures of each, len - ceil(threshold * len) + 1 of them, rarity counted over the corpus.
    """
    rows = docs.select(F.col(id_col).alias("id"), signatures(F.coalesce(F.col(text_col), F.lit(""))).alias("sigs"))
    rows = written(rows.withColumn("class", F.sha2(F.array_join("sigs", ","), 256)), "spot-rows")
    classes = written(rows.where(F.size("sigs") > 0).groupBy("class").agg(F.min("sigs").alias("sigs")).withColumn("n", F.size("sigs")), "spot-classes")
    each = classes.select("class", "n", F.explode("sigs").alias("sig"))
    often = each.groupBy("sig").agg(F.count(F.lit(1)).alias("often")).withColumnRenamed("sig", "s")
    ranked = each.join(often, F.col("sig") == F.col("s")).groupBy("class", "n").agg(F.sort_array(F.collect_list(F.struct("often", "sig"))).alias("by"))
    keys = ranked.withColumn("part", length_part(F.col("n"), threshold))
    keys = keys.select("class", "n", "part", F.explode(F.slice("by", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int"))).alias("x")).select("class", "n", "part", F.col("x.sig").alias("sig"))
    left = keys.select(F.col("class").alias("a"), F.col("n").alias("an"), F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("meet"), F.col("part").alias("ap"), "sig")
    right = keys.select(F.col("class").alias("b"), F.col("n").alias("bn"), F.col("part").alias("meet"), F.col("sig").alias("bsig"))
    fits = (F.col("sig") == F.col("bsig")) & (left["meet"] == right["meet"]) & (F.least("an", "bn") >= threshold * F.greatest("an", "bn")) & ((F.col("ap") < right["meet"]) | (F.col("a") < F.col("b")))
    pairs = left.join(right, fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sets = classes.select("class", "sigs")
    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("sigs").alias("as")), "a").join(sets.select(F.col("class").alias("b"), F.col("sigs").alias("bs")), "b")
    both = both.select("a", "b", likeness(F.col("as"), F.col("bs"), threshold).alias("likeness")).where("likeness > 0")
    return rows.select(F.col("id").alias(id_col), "class"), both
