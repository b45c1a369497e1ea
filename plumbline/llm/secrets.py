"""Operator 4: secret scans by corpus-wide ownership frequency, in DataFrame functions only.

Patterns find candidates with their places in every whole text. Each candidate's value is hashed, and over the whole
corpus the distinct repositories and owners of every hash are counted: a value that SHARED_OWNERS or more owners have
is a widely copied example, one that fewer have and that looks random is a live-looking credential of its owner. Every
span is told apart by that. Counts go back to the spans by a join; the values that are found most often, HEAVY_VALUES
at most, are broadcast instead, so that no value gathers its spans in one task.

A kind's matches are leftmost and don't overlap. Splitting a text by a pattern gives what stands between the matches,
so that places follow from running sums of lengths, in code points.

Cases: null and empty texts have no spans; a null owner or repository is one of its own; repeated rows give repeated
results and count once as repository; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written

SHARED_OWNERS = 3
#: Values that are broadcast at most: those with more than this share of all spans.
HEAVY_VALUES = 20_000
#: Distinct characters that a value needs to look random.
RANDOM_LOOK = 8


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: What a text must contain to have a match; None: the pattern itself is tried.
    needs: str | None = None
    #: The group that holds the value, and the least length of the value.
    group: int = 0
    least: int = 1


#: Base kinds, in the order in which equal starts are listed.
BASE = [
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", None, 2, 12),
    Kind("access", r"AKIA[A-Z0-9]+", "AKIA", 0, 18),
    Kind("hex", r"[0-9a-f]{16,}", None, 0, 16),
]
#: Kinds that the operator adds to them.
MORE = [
    Kind("bearer", r"(?i:bearer)\x20+([A-Za-z0-9._~+/=-]{20,})", None, 1, 20),
    Kind("github", r"gh[opsur]_[A-Za-z0-9]{20,}", "gh", 0, 24),
    Kind("google", r"AIza[0-9A-Za-z_-]{35}", "AIza", 0, 39),
    Kind("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]*", "eyJ", 0, 20),
    Kind("pem", r"-----BEGIN[A-Z\x20]*PRIVATE\x20KEY-----", "PRIVATE KEY", 0, 1),
    Kind("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}", "xox", 0, 15),
    Kind("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}", "k_live_", 0, 24),
    Kind("userinfo", r"(?<![a-z0-9+])[a-z][a-z0-9+]*+://[^\s/:@]++:([^\s/:@]{8,}+)@", "://", 1, 8),
]


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once: inside higher-order functions, a named column would be repeated."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def running(lengths: Column) -> Column:
    """Running sums of an array, by blocks of about its size's root, so that long arrays don't cost their square."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y.cast("long"))

    def blocks(every: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(every).cast("double"))).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / width).cast("int")), lambda b: F.slice(every, b * width + 1, width))

    def sums(parts: Column) -> Column:
        def own_sums(part: Column, b: Column, totals: Column) -> Column:
            before = total(F.slice(totals, F.lit(1), b))
            return let(before, lambda base: F.transform(part, lambda _, i: base + total(F.slice(part, F.lit(1), i + 1))))

        return let(F.transform(parts, total), lambda totals: F.flatten(F.transform(parts, lambda part, b: own_sums(part, b, totals))))

    return let(lengths, lambda every: let(blocks(every), sums))


def spans_of_kind(text: Column, kind: Kind, place: int) -> Column:
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
    every = lambda group: F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(group))

    def shaped(x: Column) -> Column:
        start = (x["end"] - F.length(x["whole"])).cast("long")
        return F.struct(start.alias("start"), F.lit(place).alias("kind"), x["end"].cast("long").alias("end"), x["value"].alias("value"))

    def placed(found: Column) -> Column:
        between = F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(found))
        steps = F.zip_with(between, found, lambda a, b: F.length(a) + F.length(b))
        rows = F.arrays_zip(running(steps).alias("end"), found.alias("whole"), (every(kind.group) if kind.group else found).alias("value"))
        return F.filter(F.transform(rows, shaped), lambda x: F.length(x["value"]) >= kind.least)

    has = text.rlike(kind.pattern) if kind.needs is None else text.contains(kind.needs) & text.rlike(kind.pattern)
    return F.when(has, let(every(0), placed)).otherwise(none)


def spans_of(text: Column, kinds: list[Kind]) -> Column:
    """Array of (start, place of the kind, end, value) of all kinds' matches, by start and kind."""
    return F.array_sort(F.flatten(F.array(*[spans_of_kind(text, kind, i) for i, kind in enumerate(kinds)])))


def listed(spans: Column, kinds: list[Kind]) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in kinds])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def ownership(found: DataFrame) -> DataFrame:
    """value, n_repositories, n_owners, times over the whole corpus. found: value (a hash), repository, owner."""
    each = found.groupBy("value", "repository", "owner").agg(F.count(F.lit(1)).alias("times"))
    repositories = each.groupBy("value", "repository").agg(F.sum("times").alias("times")).groupBy("value").agg(F.count(F.lit(1)).alias("n_repositories"), F.sum("times").alias("times"))
    owners = each.select(F.col("value").alias("of"), "owner").distinct().groupBy("of").agg(F.count(F.lit(1)).alias("n_owners"))
    return repositories.join(owners, F.col("value") == F.col("of")).select("value", "n_repositories", "n_owners", "times")


def judged(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """found with its value's counts over the corpus."""
    least = (corpus.agg(F.sum("times")).collect()[0][0] or 0) // HEAVY_VALUES
    known = corpus.withColumnRenamed("value", "known")
    heavy = F.broadcast(known.where(F.col("times") > least + 1000))
    here = F.col("value") == F.col("known")
    often = found.join(heavy, here)
    rest = found.join(heavy.select("known"), here, "left_anti").join(known.where(F.col("times") <= least + 1000), here)
    return often.unionByName(rest)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source", shared_owners: int = SHARED_OWNERS) -> DataFrame:
    """id_col, n_assign, n_access, n_hex, base_sha256, spans, live_spans, shared_spans, n_live, n_shared, most_owners, most_repositories.

    live_spans: of live-looking credentials; shared_spans: of widely copied examples; both in the form of spans, and
    counted by n_live and n_shared. most_owners and most_repositories: of any span's value, over the whole corpus.
    """
    kinds = BASE + MORE
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(repository_col).cast("string").alias("repository"), F.col(owner_col).cast("string").alias("owner"), spans_of(text, kinds).alias("found"))
    # Values stay hashed from here on.
    looks = lambda v: F.size(F.array_distinct(F.split(v, ""))) >= RANDOM_LOOK
    hashed = F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.xxhash64(x["value"]).alias("value"), looks(x["value"]).alias("random")))
    rows = written(rows.withColumn("found", hashed).withColumn("row", F.monotonically_increasing_id()), "secret-spans")
    found = rows.select("row", "repository", "owner", F.posexplode("found").alias("at", "x")).select("row", "at", "repository", "owner", "x.value", "x.random")
    corpus = written(ownership(found.select("value", "repository", "owner")), "secret-values")
    shared = F.col("n_owners") >= shared_owners
    mark = F.when(shared, "shared").when(F.col("random"), "live")
    each = judged(found.select("row", "at", "value", "random"), corpus).select("row", "at", mark.alias("mark"), "n_owners", "n_repositories")
    marks = each.groupBy(F.col("row").alias("of")).agg(F.sort_array(F.collect_list(F.struct("at", "mark"))).alias("marks"), F.max("n_owners").alias("most_owners"), F.max("n_repositories").alias("most_repositories"))
    joined = rows.join(marks, F.col("row") == F.col("of"), "left")
    marked = F.zip_with("found", F.coalesce("marks", F.array().cast("array<struct<at:int,mark:string>>")), lambda x, m: x.withField("mark", m["mark"]))
    joined = joined.withColumn("found", marked)
    of_mark = lambda name: F.filter("found", lambda x: x["mark"] == name)
    count = lambda i: F.size(F.filter("found", lambda x: x["kind"] == i)).cast("long")
    base = F.filter("found", lambda x: x["kind"] < len(BASE))
    none = F.lit(0).cast("long")
    return joined.select(
        F.col("id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(base, kinds).cast("binary"), 256).alias("base_sha256"), listed(F.col("found"), kinds).alias("spans"),
        listed(of_mark("live"), kinds).alias("live_spans"), listed(of_mark("shared"), kinds).alias("shared_spans"),
        F.size(of_mark("live")).cast("long").alias("n_live"), F.size(of_mark("shared")).cast("long").alias("n_shared"),
        F.coalesce("most_owners", none).alias("most_owners"), F.coalesce("most_repositories", none).alias("most_repositories"),
    )
