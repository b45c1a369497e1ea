"""Operator 13: language identification by interpolated Kneser-Ney character models.

A text's characters are its letters and marks in lower case, with one blank for whatever lies between them. Spark counts
every ORDER-gram of all texts that may be learned from. From all of these, interpolated Kneser-Ney estimates follow by joins:
lower orders count in how many contexts a gram continues, and an order's discount is n1 / (n1 + 2 * n2). A model is two
tables, grams with their log probabilities and contexts with their backoff weights.

Tasks look grams up in sorted arrays of hashes. Where the tables are small these hold all of them; else what the
languages' commonest ORDER-grams need, and the other ORDER-grams of a text get their values by joins with the tables.
Values are whole numbers of 1 / UNIT bits, so that both ways give the same sums in any order.

The language of the lowest cross-entropy, bits over the number of characters, is predicted. Two numbers are calibrated
on all texts that the models don't count, those of CALIBRATION: how sharply the languages' cross-entropies tell them
apart, which gives the score, a probability; and for each language the cross-entropy that only one in 200 of its own
texts exceeds. A text beyond it is marked as rejected, and its score is halved for every bit beyond: it's likely in none
of the languages.

Cases: null texts and texts without a letter are `und`, with a score of 0; rows with a null id are predicted, not learned
from; languages are what lang holds, but for null; without any to learn from, every text is `und`; ties go to the first
language in order; repeated rows get repeated results; an empty table gives no rows; only the named columns are read.
Long texts are walked in pieces.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm.common import share_package, written

ORDER = 4
#: Grams of the highest order that tasks hold of a language, and of all; and rows of all tables that they hold.
GRAMS, ALL_GRAMS, ROWS = 100_000, 2_000_000, 4_000_000
#: Of 16 hash classes of documents, the one that calibrates and isn't counted.
CALIBRATION = 3
#: Share of a language's own texts that its rejection threshold lets pass.
PASS = 0.995
#: Characters of one piece of texts.
PIECE = 1_000_000
#: Numbers that are worked out at once, over texts or grams and languages.
CELLS = 8_000_000
#: Parts of a bit.
UNIT = 1 << 20
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """For every code point: 2 for a letter, 1 for a mark, else 0."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for start, end in ((0, 0x40000), (0xE0100, 0xE01F0)):
        for c in range(start, end):
            kind = unicodedata.category(chr(c))[0]
            out[c] = 2 if kind == "L" else 1 if kind == "M" else 0
    return out


def pieces(texts: list[str], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of many texts, the number of the text each belongs to, and whether a gram ends there.

    A text begins with ORDER - 1 blanks, which only give context, and ends with a blank. Pieces have about so many
    characters; where a text goes on in the next, its last characters come again as context.
    """
    codes, owners, ends, size = [], [], [], 0

    def put(code: np.ndarray, owner: int, context: int) -> None:
        nonlocal size
        codes.append(code)
        owners.append(np.full(len(code), owner, np.int32))
        end = np.ones(len(code), bool)
        end[:context] = False
        ends.append(end)
        size += len(code)

    def taken() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nonlocal size
        out = np.concatenate(codes), np.concatenate(owners), np.concatenate(ends)
        for part in (codes, owners, ends):
            part.clear()
        size = 0
        return out

    start = np.full(ORDER - 1, 32, np.uint32)
    for i, text in enumerate(texts):
        last = start
        for at in range(0, len(text), most):
            code = np.frombuffer(text[at : at + most].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            inside = kinds()[code] > 0
            code = np.where(inside, code, np.uint32(32))
            # A blank stays only after something else, in this piece or the one before.
            code = code[inside | np.r_[last[-1] != 32, inside[:-1]]]
            if at + most >= len(text) and len(code) + (last[-1] != 32) and (code[-1] if len(code) else last[-1]) != 32:
                code = np.r_[code, np.uint32(32)]
            if len(code):
                put(np.r_[last, code], i, len(last))
                last = np.r_[last, code][1 - ORDER :]
            if size >= most:
                yield taken()
    if size:
        yield taken()


def run_hash(columns: list[np.ndarray], n: int) -> np.ndarray:
    """Hashes of n runs of characters, given as one array for each place in the run; of no places, of the empty run."""
    h = np.full(n, len(columns), np.uint64)
    for c in columns:
        h ^= c.astype(np.uint64)
        h *= _STEP
        h ^= h >> np.uint64(29)
    return h * _MIX


def distinct(code: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the piece's distinct ORDER-grams, which of them each place with an end has, and those places."""
    at = np.flatnonzero(ends)
    own = run_hash([code[at - back] for back in range(ORDER - 1, -1, -1)], len(at))
    order = np.argsort(own)
    fresh = np.r_[True, np.diff(own[order]) != 0] if len(own) else np.zeros(0, bool)
    which = np.zeros(len(own), np.int64)
    which[order] = np.cumsum(fresh) - 1
    return at[order[fresh]], which, at


def spelled(code: np.ndarray, last: np.ndarray) -> list[str]:
    """The ORDER-grams that end at some places."""
    rows = code[last[:, None] + np.arange(1 - ORDER, 1)]
    text = rows.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [text[i : i + ORDER] for i in range(0, len(text), ORDER)]


def counted(docs: DataFrame) -> DataFrame:
    """lang, gram, times over all texts of docs (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Counts of a task are added up before they are shuffled, a bounded number of grams at a time.
        held: dict[tuple[str, str], int] = {}

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in held], pa.string()), "gram": pa.array([k[1] for k in held], pa.string()), "times": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return rows

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                for code, _, ends in pieces([texts[i] for i in np.flatnonzero(langs == lang)], PIECE):
                    last, which, _ = distinct(code, ends)
                    for gram, n in zip(spelled(code, last), np.bincount(which, minlength=len(last)).tolist(), strict=True):
                        held[lang, gram] = held.get((lang, gram), 0) + n
                    if len(held) > 500_000:
                        yield out()
        if held:
            yield out()

    found = docs.select("text", "lang").mapInArrow(run, "lang string, gram string, times long")
    return found.groupBy("lang", "gram").agg(F.sum("times").alias("times"))


def kept(grams: DataFrame, most: int) -> DataFrame:
    """Each language's commonest grams, about most at the most: a count's grams stay if all of them have room.

    Where not even those of the highest count have, as many as fit are chosen of them, by a hash. This is what tasks hold;
    other grams count as well.
    """
    times = grams.groupBy("lang", "times").agg(F.count(F.lit(1)).alias("n"))
    upward = Window.partitionBy("lang").orderBy(F.desc("times"))
    fitting = times.withColumn("sofar", F.sum("n").over(upward)).where(F.col("sofar") <= most).groupBy("lang").agg(F.min("times").alias("fits"))
    top = times.groupBy("lang").agg(F.max("times").alias("top"), F.max_by("n", "times").alias("many"))
    bound = top.join(fitting, "lang", "left").select("lang", F.coalesce("fits", "top").alias("least"), F.when(F.col("fits").isNull(), F.lit(most) / F.col("many")).otherwise(1.0).alias("share"))
    chosen = (F.col("times") >= F.col("least")) & (F.pmod(F.xxhash64("gram"), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    return grams.join(F.broadcast(bound), "lang").where(chosen).drop("least", "share")


def kneser_ney(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lang, gram, p of all orders, and lang, context, weight: interpolated estimates from lang, gram, times."""
    levels = [grams.select("lang", "gram", F.col("times").cast("double").alias("c"))]
    for order in range(ORDER - 1, 0, -1):
        # Distinct grams one longer that end with this one: the contexts that it continues.
        levels.append(levels[-1].groupBy("lang", F.substring("gram", 2, order).alias("gram")).agg(F.count(F.lit(1)).cast("double").alias("c")))
    # All languages share one alphabet, so that their models spread what is left over the same characters.
    alphabet = levels[-1].select("gram").distinct().count() + 1
    lower, weights = None, []
    for order, level in enumerate(reversed(levels), 1):
        by_count = level.groupBy("lang").agg(F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"))
        ratio = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
        discounts = by_count.select("lang", F.greatest(F.lit(0.1), F.least(F.lit(0.95), F.coalesce(ratio, F.lit(0.5)))).alias("d"))
        context = F.substring("gram", 1, order - 1)
        level = level.withColumn("context", context).join(F.broadcast(discounts), "lang")
        sums = level.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum(F.least("c", "d")).alias("cut"))
        weight = written(sums.select("lang", "context", "total", (F.col("cut") / F.col("total")).alias("weight")), "language-weights")
        level = level.join(weight, ["lang", "context"])
        own = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")
        if lower is None:
            level = level.withColumn("below", F.lit(1.0 / alphabet))
        else:
            level = level.join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below")), (F.substring("gram", 2, order - 1) == F.col("suffix")) & (level["lang"] == lower["lang"])).drop(lower["lang"])
        lower = written(level.select("lang", "gram", (own + F.col("weight") * F.col("below")).alias("p")), "language-grams")
        weights.append(weight.select("lang", "context", "weight"))
        levels[ORDER - order] = lower
    grams, contexts = levels[0], weights[0]
    for more in levels[1:]:
        grams = grams.union(more)
    for more in weights[1:]:
        contexts = contexts.union(more)
    # The empty gram: what a character that no text had comes to.
    nothing = weights[0].select("lang", F.lit("").alias("gram"), F.lit(1.0 / alphabet).alias("p"))
    return grams.union(nothing), contexts


def hashed(texts: list[str]) -> np.ndarray:
    """Hashes of short strings, as hashes() has them for runs of the same characters."""
    out = np.zeros(len(texts), np.uint64)
    sizes = np.array([len(t) for t in texts], np.int64)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        code = np.frombuffer("".join(texts[i] for i in at).encode("utf-32-le", "surrogatepass"), np.uint32)
        out[at] = run_hash(list(code.reshape(len(at), n).T), len(at))
    return out


@dataclass
class Table:
    """Hashes in order, and a number for each."""

    keys: np.ndarray
    values: np.ndarray

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values and whether there is one; 0 where there is none."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int32), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        there = self.keys[at] == keys
        return np.where(there, self.values[at], np.int32(0)), there


@dataclass
class Models:
    """Every language's grams and contexts, and what was calibrated.

    hot: hashes of the ORDER-grams for which these are enough; none: for all. rest: otherwise, the whole model as tables
    (no, gram, cost) and (no, context, cost), no being a language's place; tasks don't get them.
    """

    langs: list[str]
    grams: list[Table]
    contexts: list[Table]
    hot: np.ndarray | None = None
    rest: tuple[DataFrame, DataFrame] | None = None
    sharpness: float = 1.0
    limits: np.ndarray | None = None

    def at_once(self) -> int:
        """Texts or characters that are looked at together."""
        return max(1000, CELLS // max(1, len(self.langs)))

    def costs(self, forms: list[np.ndarray]) -> np.ndarray:
        """-log2 of the probability of a character after its context, by language; forms: hashes of the runs that end with it, of 0 to
        ORDER characters, then of their contexts, the runs without it."""
        out = np.zeros((len(self.langs), len(forms[0])), np.int64)
        for i, (table, contexts) in enumerate(zip(self.grams, self.contexts, strict=True)):
            left = np.arange(len(forms[0]))
            for order in range(ORDER, -1, -1):
                value, there = table.get(forms[order][left])
                out[i, left[there]] += value[there]
                left = left[~there]
                if not len(left):
                    break
                # The context of this order is the run before the last character: it keeps what it gives to others.
                weight, _ = contexts.get(forms[ORDER + order][left])
                out[i, left] += weight
        return out

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, list[str], np.ndarray]]]:
        """Costs of each text by language, its number of characters and whether it has a letter; then the grams that these
        costs leave out: the texts' places, the grams, how often."""
        total, many, letters = np.zeros((len(texts), len(self.langs)), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        rest = []
        for code, owner, ends in pieces(texts, min(PIECE, self.at_once())):
            last, which, at = distinct(code, ends)
            own = owner[at]
            starts = np.flatnonzero(np.r_[True, np.diff(own) != 0])
            who = own[starts]
            many[who] += np.diff(np.r_[starts, len(own)])
            letters[who] |= np.maximum.reduceat(kinds()[code[at]], starts) == 2
            rows = code[last[:, None] + np.arange(1 - ORDER, 1)]
            # Hashes of each order's gram, then of each order's context.
            forms = [run_hash(list(rows[:, ORDER - n :].T), len(rows)) for n in range(ORDER + 1)]
            forms += [run_hash(list(rows[:, ORDER - n : ORDER - 1].T), len(rows)) for n in range(1, ORDER + 1)]
            if self.hot is None:
                table = self.costs(forms)
            else:
                here = np.isin(forms[ORDER], self.hot)
                table = np.zeros((len(self.langs), len(last)), np.int64)
                table[:, here] = self.costs([f[here] for f in forms])
                away = np.flatnonzero(~here[which])
                pairs, times = np.unique(own[away].astype(np.int64) * len(last) + which[away], return_counts=True)
                rest.append((pairs // len(last), spelled(code, last[pairs % len(last)]), times))
            for i in range(len(self.langs)):
                total[who, i] += np.add.reduceat(table[i][which], starts)
        return total, many, letters, rest

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy of each text by language, bits a character, and whether it has a letter; of models that hold all."""
        assert self.hot is None
        total, many, letters, _ = self.sums(texts)
        return total / (np.maximum(many, 1) * UNIT)[:, None], letters

    def decided(self, entropy: np.ndarray, letters: np.ndarray) -> pa.StructArray:
        """Language, score, cross-entropy, whether rejected."""
        n = len(letters)
        if self.langs:
            best = entropy.argmin(axis=1)
            least = entropy[np.arange(n), best]
            over = np.maximum(least - self.limits[best], 0)
            score = np.where(letters, 0.5**over / np.exp(-self.sharpness * (entropy - least[:, None])).sum(axis=1), 0.0)
            lang, none, rejected = [self.langs[b] if y else "und" for b, y in zip(best, letters, strict=True)], ~letters, (over > 0) | ~letters
        else:
            lang, score, least, none, rejected = ["und"] * n, np.zeros(n), np.zeros(n), np.ones(n, bool), np.ones(n, bool)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(least, mask=none), pa.array(rejected)], ["lang_pred", "score", "cross_entropy", "rejected"])


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 4 == 2


def calibrates(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 16 == CALIBRATION


def endings(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All that looking up some ORDER-grams may need: their ends (gram), and these without the last character (context)."""
    ends = [F.substring("gram", ORDER + 1 - n, n) for n in range(ORDER + 1)]
    heads = [F.substring("gram", ORDER + 1 - n, n - 1) for n in range(1, ORDER + 1)]
    return grams.select(F.explode(F.array(*ends)).alias("gram")).distinct(), grams.select(F.explode(F.array(*heads)).alias("context")).distinct()


def arrays(rows: DataFrame, text: str, langs: int) -> list[Table]:
    """A table of each language, from no, text and cost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashed(batch.column(1).to_pylist()).view(np.int64)), batch.column(2)], ["no", "key", "cost"])

    found = rows.select("no", text, "cost").mapInArrow(run, "no int, key long, cost int").toArrow()
    no, keys, costs = (found.column(c).to_numpy() for c in ("no", "key", "cost"))
    keys = keys.view(np.uint64)
    order = np.lexsort((keys, no))
    cuts = np.searchsorted(no[order], np.arange(1, langs))
    return [Table(k, v) for k, v in zip(np.split(keys[order], cuts), np.split(costs[order], cuts), strict=True)]


def learned(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Models:
    """Models of all languages in docs. learn_from: which rows may be learned from, over a column named id."""
    share_package(docs.sparkSession)
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & learn_from)
    grams = written(counted(known.where(~calibrates(F.col("id")))), "language-counts")
    langs = sorted(r["lang"] for r in grams.select("lang").distinct().collect())
    if not langs:
        return Models([], [], [])
    numbers = F.broadcast(docs.sparkSession.createDataFrame([(x, i) for i, x in enumerate(langs)], "lang string, no int"))
    found, contexts = kneser_ney(grams)
    found = found.join(numbers, "lang").select("no", "gram", F.round(-F.log2("p") * UNIT).cast("int").alias("cost"))
    contexts = contexts.join(numbers, "lang").select("no", "context", F.round(-F.log2("weight") * UNIT).cast("int").alias("cost"))

    most = min(GRAMS, max(1, ALL_GRAMS // len(langs)))
    if grams.groupBy("lang").count().agg(F.max("count")).first()[0] <= most and found.count() + contexts.count() <= ROWS:
        models = Models(langs, arrays(found, "gram", len(langs)), arrays(contexts, "context", len(langs)))
    else:
        # Fewer grams until what they need has room; in the end, none.
        while True:
            hot = written(kept(grams, most).select("gram").distinct(), "language-hot")
            ends, heads = endings(hot)
            some = written(found.join(ends, "gram", "left_semi"), "language-held"), written(contexts.join(heads, "context", "left_semi"), "language-held")
            if not most or some[0].count() + some[1].count() <= ROWS:
                break
            most //= 4
        keys = arrays(hot.select(F.lit(0).alias("no"), "gram", F.lit(0).alias("cost")), "gram", 1)[0].keys
        models = Models(langs, arrays(some[0], "gram", len(langs)), arrays(some[1], "context", len(langs)), keys, (found, contexts))
    calibrate(models, known.where(calibrates(F.col("id"))))
    return models


def looked_up(grams: DataFrame, models: Models) -> DataFrame:
    """_gram, _no, _cost of distinct ORDER-grams (_gram) in every language, from the whole model."""
    found, contexts = models.rest
    lower = found.where(F.col("gram") == "").select(F.col("no").alias("_no"), F.col("gram").alias("_end"), F.col("cost").cast("long").alias("_cost"))
    for order in range(1, ORDER + 1):
        ends = grams.select(F.substring("_gram", ORDER + 1 - order, order).alias("_end")).distinct()
        ends = ends.withColumns({"_below": F.substring("_end", 2, order - 1), "_context": F.substring("_end", 1, order - 1)})
        below = lower.select("_no", F.col("_end").alias("_below"), F.col("_cost").alias("_under"))
        own = found.where(F.length("gram") == order).select(F.col("no").alias("_no"), F.col("gram").alias("_end"), F.col("cost").alias("_own"))
        weights = contexts.where(F.length("context") == order - 1).select(F.col("no").alias("_no"), F.col("context").alias("_context"), F.col("cost").alias("_weight"))
        level = ends.join(below, "_below").join(own, ["_no", "_end"], "left").join(weights, ["_no", "_context"], "left")
        cost = F.coalesce(F.col("_own").cast("long"), F.coalesce("_weight", F.lit(0)) + F.col("_under"))
        lower = written(level.select("_no", "_end", cost.alias("_cost")), "language-ends")
    return lower.select(F.col("_end").alias("_gram"), "_no", "_cost")


def measured(docs: DataFrame, models: Models, text_col: str) -> DataFrame:
    """The rows of docs without their texts, with _entropy, of each language, and _letters."""
    shared = docs.sparkSession.sparkContext.broadcast(replace(models, rest=None))
    others = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, step = TaskContext.get().partitionId() << 33, shared.value.at_once()
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                total, many, letters, rest = shared.value.sums([t or "" for t in part.column(text_col).to_pylist()])
                grams, times = [[] for _ in many], [[] for _ in many]
                for own, new, n in rest:
                    for i, gram, k in zip(own.tolist(), new, n.tolist(), strict=True):
                        grams[i].append(gram)
                        times[i].append(k)
                fresh = {"_row": np.arange(row, row + len(many)), "_sums": pa.array(list(total), pa.list_(pa.int64())), "_many": many, "_letters": letters, "_grams": pa.array(grams, pa.list_(pa.string())), "_times": pa.array(times, pa.list_(pa.int64()))}
                row += len(many)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), *(pa.array(c) if isinstance(c, np.ndarray) else c for c in fresh.values())], [*others, *fresh])

    fresh = StructType.fromDDL("_row long, _sums array<long>, _many long, _letters boolean, _grams array<string>, _times array<long>")
    rows = docs.select(*others, text_col).mapInArrow(run, StructType([*docs.select(*others).schema, *fresh]))
    if models.hot is not None:
        rows = written(rows, "language-sums")
        # A gram of a text comes once, or once a piece.
        rest = rows.select("_row", F.explode(F.arrays_zip("_grams", "_times")).alias("_z")).select("_row", F.col("_z._grams").alias("_gram"), F.col("_z._times").alias("_n"))
        costs = looked_up(written(rest.select("_gram").distinct(), "language-rest"), models)
        more = rest.join(costs, "_gram").groupBy("_row", "_no").agg(F.sum(F.col("_cost") * F.col("_n")).alias("_more"))
        more = more.groupBy("_row").agg(F.transform(F.sort_array(F.collect_list(F.struct("_no", "_more"))), lambda x: x["_more"]).alias("_more"))
        rows = rows.join(more, "_row", "left").withColumn("_sums", F.when(F.col("_more").isNull(), F.col("_sums")).otherwise(F.zip_with("_sums", "_more", lambda x, y: x + y)))
    entropy = F.transform("_sums", lambda x: x / (F.greatest("_many", F.lit(1)) * UNIT))
    return rows.select(*others, entropy.alias("_entropy"), "_letters")


def calibrate(models: Models, known: DataFrame) -> None:
    """Sharpness and rejection limits from all texts of known; sums and counts of them come back."""
    steps = 1.25 ** np.arange(-10, 31)
    place = {x: i for i, x in enumerate(models.langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([place.get(x, -1) for x in batch.column("lang").to_pylist()], np.int64)
            rows = np.flatnonzero((own >= 0) & np.array(batch.column("_letters").to_pylist(), bool))
            if not len(rows):
                continue
            own, entropy = own[rows], np.array(batch.column("_entropy").take(pa.array(rows)).to_pylist())
            least = entropy[np.arange(len(own)), own]
            margins = entropy - least[:, None]
            # Whole numbers: their sums are the same in any order.
            losses = [int(np.rint(np.log(np.exp(np.clip(-s * margins, -60, 60)).sum(axis=1)) * UNIT).sum()) for s in steps]
            # Numbers of 0 and above have the order of their bits. A batch's first row has its losses.
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.abs(least).view(np.int64)), pa.array([losses] + [None] * (len(own) - 1), pa.list_(pa.int64()))], ["no", "bits", "losses"])

    found = measured(known.select("lang", "text"), models, "text").mapInArrow(run, "no long, bits long, losses array<long>")
    found = written(found, "language-calibrated")
    models.limits = np.full(len(models.langs), np.inf)
    for no, limit in quantiles(found.select("no", "bits"), PASS).items():
        models.limits[no] = limit
    # The sharpness under which the texts' own languages are likeliest, of steps by a quarter.
    loss = found.agg(*[F.sum(F.col("losses")[i]).alias(f"l{i}") for i in range(len(steps))]).first()
    if loss[0] is not None:
        models.sharpness = float(steps[int(np.argmin(list(loss)))])


def quantiles(rows: DataFrame, share: float) -> dict[int, float]:
    """By no, the exact quantile of numbers of 0 and above, of which rows (no, bits) has the bits; between two, in proportion.

    Both numbers' places are found 21 bits at a time, from counts: no group is sorted whole.
    """
    sizes = {r["no"]: r["count"] for r in rows.groupBy("no").count().collect()}
    if not sizes:
        return {}
    # By no and whether it's the upper number: the bits found so far, and its place among the numbers that begin so.
    at = {(no, up): (0, min(int((n - 1) * share) + up, n - 1)) for no, n in sizes.items() for up in (0, 1)}
    for shift in (42, 21, 0):
        sought = rows.sparkSession.createDataFrame([(no, up, *x) for (no, up), x in at.items()], "no long, up int, head long, place long")
        digits = rows.select("no", F.shiftright("bits", shift + 21).alias("head"), F.shiftright("bits", shift).bitwiseAND(F.lit((1 << 21) - 1)).alias("digit"))
        counts = digits.join(F.broadcast(sought), ["no", "head"]).groupBy("no", "up", "head", "place", "digit").agg(F.count(F.lit(1)).alias("n"))
        counts = counts.withColumn("sofar", F.sum("n").over(Window.partitionBy("no", "up").orderBy("digit")))
        hits = counts.where((F.col("sofar") > F.col("place")) & (F.col("sofar") - F.col("n") <= F.col("place")))
        at = {(r["no"], r["up"]): ((r["head"] << 21) + r["digit"], r["place"] - (r["sofar"] - r["n"])) for r in hits.collect()}
    out = {}
    for no, n in sizes.items():
        low, high = np.array([at[no, 0][0], at[no, 1][0]], np.int64).view(np.float64)
        out[no] = float(low + (high - low) * ((n - 1) * share % 1))
    return out


def predicted(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """The rows of docs without their texts, with lang_pred, score, cross_entropy (null: no letter) and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(replace(models, rest=None))
    kind = "struct<lang_pred: string, score: double, cross_entropy: double, rejected: boolean>"
    others = [c for c in docs.columns if c != text_col]
    if models.hot is not None:

        @F.arrow_udf(kind)
        def decide(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for entropy, letters in parts:
                yield shared.value.decided(np.array(entropy.to_pylist(), float).reshape(len(letters), -1), np.array(letters.to_pylist(), bool))

        return measured(docs, models, text_col).withColumn("_judged", decide("_entropy", "_letters")).select(*others, "_judged.*")

    @F.arrow_udf(kind)
    def judge(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        step = shared.value.at_once()
        for texts in parts:
            done = [shared.value.decided(*shared.value.entropies([t or "" for t in texts.slice(at, step).to_pylist()])) for at in range(0, len(texts), step)]
            yield pa.concat_arrays(done) if done else shared.value.decided(*shared.value.entropies([]))

    return docs.withColumn("_judged", judge(F.col(text_col))).select(*others, "_judged.*")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id_col, held_out, lang_pred, score, cross_entropy, rejected for every row; rows held out are never learned from."""
    models = learned(docs, ~held_out(F.col("id")), id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).alias("_text"))
    return predicted(rows, models, "_text")
