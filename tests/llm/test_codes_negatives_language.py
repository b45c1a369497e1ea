"""Operators 11 to 13 against brute force, over nulls, ties, repeated rows, other lengths, empty tables, clashing columns."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.llm import language, negatives, quantizer, queries

FOLDER = "/root/testdata/sf0.01"
CLASHES = "id n key rank part entry upper lower top code error dims pivot far ring group chunk own score gram lang_pred held_out of many total".split()


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(3)
    out = [(i, [float(x) for x in draw.normal(size=8) / 3], int(draw.integers(0, 4))) for i in range(300)]
    out += [(i, [0.25] * 8, 1) for i in range(300, 360)] + [out[5], out[100]]
    out += [(400, None, 1), (401, [float("nan")] + [0.0] * 7, 1), (402, [None] + [0.5] * 7, 1), (403, [float("inf")] + [0.0] * 7, 2), (404, [0.1] * 8, None)]
    out += [(None, [0.3] * 8, 2), (405, [0.2] * 3, 2), (406, [], 2), (-1, [0.4] * 8, 3)]
    return out


@pytest.fixture(scope="module")
def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


def whole(v, scale=256.0):
    return [math.floor(scale * x) for x in np.asarray(v, np.float32).astype(float).tolist()]


def finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def lloyd(vectors, ids, parts, entries, rounds):
    """Full search over Python integers: codes, errors, codebooks."""
    dims = len(vectors[0])
    cut = [(p * dims // parts, (p + 1) * dims // parts) for p in range(parts)]
    first = {}
    for i, v in zip(ids, vectors, strict=True):
        if i is not None:
            first[i] = min(first.get(i, v), v)
    books = [[list(first[i][a:b]) for i in sorted(first)[:entries]] for a, b in cut]

    def nearest(book, part):
        return min(range(len(book)), key=lambda e: (sum((x - y) ** 2 for x, y in zip(part, book[e], strict=True)), e))

    for _ in range(rounds):
        for (a, b), book in zip(cut, books, strict=True):
            held = defaultdict(list)
            for v in vectors:
                held[nearest(book, v[a:b])].append(v[a:b])
            for e, own in held.items():
                book[e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    codes = [[nearest(book, v[a:b]) for (a, b), book in zip(cut, books, strict=True)] for v in vectors]
    errors = [sum((x - y) ** 2 for (a, b), book, e in zip(cut, books, c, strict=True) for x, y in zip(v[a:b], book[e], strict=True)) for v, c in zip(vectors, codes, strict=True)]
    return codes, errors, hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(4, 16, 2), (3, 5, 4), (8, 64, 0)])
def test_codes_equal_a_full_search(vectors, rows, parts, entries, rounds):
    kept = [r for r in rows if finite(r[1])]
    own = [r for r in kept if len(r[1]) == 8]
    codes, errors, digest = lloyd([whole(r[1]) for r in own], [r[0] for r in own], parts, entries, rounds)
    sums = Counter()
    for r, e in zip(own, errors, strict=True):
        sums[r[2]] += e
    want = [(r[0], r[2], bytes(c).hex(), e, sums[r[2]], digest) for r, c, e in zip(own, codes, errors, strict=True)]
    want += [(r[0], r[2], None, None, sums[r[2]], digest) for r in kept if len(r[1]) != 8]
    got = [tuple(r) for r in quantizer.quantize(vectors, parts=parts, entries=entries, rounds=rounds).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_codes_of_large_components_few_ids_and_none(spark, vectors):
    draw = random.Random(1)
    data = [(i, [draw.choice([1e30, -1e30, 3e5, 1.0, 2.0**52]) * draw.random() for _ in range(4)], None) for i in range(40)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label string")
    limit = 2**62
    ints = [[max(-limit, min(limit, math.floor(256.0 * x))) for x in v] for _, v, _ in data]
    codes, errors, digest = lloyd(ints, range(40), 2, 64, 2)
    got = sorted(map(tuple, quantizer.quantize(df, parts=2).collect()))
    most = 2**63 - 1
    assert [g[2] for g in got] == [bytes(c).hex() for c in codes] and [g[3] for g in got] == [min(e, most) for e in errors] and got[0][5] == digest
    assert quantizer.quantize(vectors.where("false")).count() == 0 and quantizer.quantize(vectors.where("vec_id is null")).collect()[0]["code"] is None
    with pytest.raises(ValueError, match="entries"):
        quantizer.quantize(vectors, entries=300)


def test_bounds_prune_and_stay_right():
    draw = np.random.default_rng(8)
    centres = draw.integers(-900, 900, (24, 4))
    rows = centres[draw.integers(0, 24, 3000)] + draw.integers(-25, 25, (3000, 4))
    book = quantizer.Codebook([rows[:24].copy()])
    state = quantizer.Bounds.none(len(rows), 1, 24)
    assert state.assign(rows, book) == 3000 * 24
    looked = []
    for _ in range(6):
        entries = book.entries[0].copy()
        for e in range(24):
            if (own := rows[state.entry[:, 0] == e]).size:
                entries[e] = own.sum(axis=0) // len(own)
        book = quantizer.Codebook([entries], book)
        # As the written table has them: a byte for each lower bound.
        columns = state.columns()
        batch = quantizer.pa.RecordBatch.from_arrays(columns, ["entry", "upper", "lower", "top"])
        state = quantizer.Bounds.opened(batch, 1, 24)
        state.shift(book)
        looked.append(state.assign(rows, book))
        d = ((rows[:, None] - book.entries[0][None]) ** 2).sum(axis=2)
        assert (state.entry[:, 0] == d.argmin(axis=1)).all()
        root = np.sqrt(d)
        assert (state.lower[:, 0] <= root + 1e-9).all() and (state.upper[:, 0] >= root.min(axis=1) - 1e-9).all()
    assert max(looked) < 3000 * 8 and looked[-1] < 3000 * 3


def mined(rows, is_anchor, label_of, positives=5, most=10, low=30, high=90):
    seen, own = set(), []
    for i, v, y in rows:
        y = label_of(i, y)
        if i is not None and y is not None and finite(v) and (i, y, tuple(v)) not in seen:
            seen.add((i, y, tuple(v)))
            own.append((i, y, np.array(whole(v), object)))
    out = []
    for i, y, v in own:
        if is_anchor(i):
            scores = sorted((-int(v.dot(w)), j, z) for j, z, w in own if j != i and len(w) == len(v))
            for s, p, _ in [x for x in scores if x[2] == y][:positives]:
                found = [(j, -t) for t, j, z in scores if z != y and low * -s <= 100 * -t <= high * -s][:most]
                out += [(i, p, n + 1, j, -s, t) for n, (j, t) in enumerate(found)]
    return sorted(out)


def query_label(i, y):
    return y if y is None or i is None or i % 7 else (y + 1) % 10


def label_column():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


@pytest.mark.parametrize("pivots", [None, 7])
def test_hard_negatives(vectors, rows, pivots):
    own = [r for r in rows if not finite(r[1]) or len(r[1]) == 8]
    want = mined(own, lambda i: i % 20 == 0, query_label)
    got = negatives.hard_negatives(vectors, F.col("id") % 20 == 0, label_column(), pivots=pivots).collect()
    assert sorted(map(tuple, got)) == want and len(want) > 300
    assert negatives.hard_negatives(vectors.where("false"), F.col("id") % 20 == 0, label_column()).count() == 0
    assert negatives.hard_negatives(vectors, F.lit(False), label_column()).count() == 0
    # Fewer rows of the label than positives asked for, and one label only.
    few = [r for r in own if r[0] in range(0, 12)]
    df = vectors.where("vec_id between 0 and 11")
    assert sorted(map(tuple, negatives.hard_negatives(df, F.col("id") % 2 == 0, label_column()).collect())) == mined(few, lambda i: i % 2 == 0, query_label)
    assert negatives.hard_negatives(df, F.col("id") % 2 == 0, F.lit(1)).count() == 0


def test_rings_go_only_to_groups_that_they_may_serve(spark, monkeypatch):
    draw = np.random.default_rng(0)
    centres, n = draw.normal(size=(30, 8)) * 3, 4000
    k = draw.integers(0, 30, n)
    x = (centres[k] + draw.normal(size=(n, 8)) * 0.2).astype(np.float32)
    data = [(i, x[i].tolist(), int(k[i] % 7)) for i in range(n)]
    monkeypatch.setattr(negatives, "ROWS_A_BLOCK", 128)
    monkeypatch.setattr(negatives, "ANCHORS_A_GROUP", 10)
    tables = defaultdict(list)
    keep = negatives.written
    monkeypatch.setattr(negatives, "written", lambda df, name: tables[name].append(keep(df, name)) or tables[name][-1])
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    got = negatives.hard_negatives(df, F.col("id") % 20 == 0, F.col("label"), pivots=30).collect()
    assert sorted(map(tuple, got)) == mined(data, lambda i: i % 20 == 0, lambda i, y: y)
    every = tables["negatives-rings"][0].count() * tables["negatives-anchors"][0].select("group").distinct().count()
    first, second = (t.count() for t in tables["negatives-pairs"])
    assert first < 0.3 * every and second < 0.9 * every


def test_hard_negatives_of_large_components(spark):
    draw = random.Random(4)
    data = [(i, [draw.choice([1e6, 3e7, 2.0**40]) * draw.random() for _ in range(3)], i % 3) for i in range(60)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = negatives.hard_negatives(df, F.col("id") % 10 == 0, F.col("label"), pivots=3).collect()
    ints = [(i, y, [math.floor(256.0 * x) for x in v]) for i, v, y in data]
    want, most = [], 2**63 - 1
    for i, y, v in ints:
        if i % 10 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, z, w in ints if j != i)
            for s, p, _ in [t for t in scores if t[2] == y][:5]:
                found = [(j, -t) for t, j, z in scores if z != y and 30 * -s <= 100 * -t <= 90 * -s][:10]
                want += [(i, p, n + 1, j, min(-s, most), min(t, most)) for n, (j, t) in enumerate(found)]
    assert sorted(map(tuple, got)) == sorted(want) and want


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_hard_negatives"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{FOLDER}/embeddings.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, FOLDER).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    pd.testing.assert_frame_equal(*(t[columns].sort_values(columns).reset_index(drop=True) for t in (got, want)), check_dtype=False)


WORDS = {"aa": "bana nabo lani obal nobi", "bb": "sheth ethes tosh hest shot", "cc": "漢字 字漢 文字 漢文 字字"}


@pytest.fixture(scope="module")
def notes(spark):
    draw = random.Random(6)
    out = [(i, " ".join(draw.choice(WORDS[y].split()) for _ in range(draw.randint(1, 30))) + draw.choice(["", ".", " 12", "\n!"]), y) for i in range(900) for y in [draw.choice(sorted(WORDS))]]
    out += [(1000, None, "aa"), (1001, "", "bb"), (1002, " 12 !?\n", "aa"), (1003, "BANA", None), (None, "shot shot", "bb"), (1004, "zzzz qqqq", None), (1005, "bana " * 3000, None), out[0], out[0]]
    return out


@pytest.fixture(scope="module")
def noted(spark, notes):
    return spark.createDataFrame(notes, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in CLASHES})


def plain(text):
    import unicodedata

    kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    return " ".join(kept.split())


def padded(text):
    # A text that begins with other things than letters begins with no blank of its own: its context is blank already.
    own = plain(text)
    return "   " + own + " " if own else ""


def brute_models(notes):
    """Kneser-Ney by dictionaries, over the rows that are counted."""
    from zlib import crc32

    counts = defaultdict(Counter)
    for i, t, y in notes:
        if i is not None and t and y and crc32(str(i).encode()) % 4 != 2 and crc32(str(i).encode()) % 16 != language.CALIBRATION:
            s = padded(t)
            counts[y].update(s[j - 4 : j] for j in range(4, len(s) + 1))
    tables = {}
    for y, top in counts.items():
        levels = [top]
        for _ in range(3):
            levels.append(Counter(g[1:] for g in levels[-1]))
        tables[y] = levels[::-1]
    alphabet = len({g for levels in tables.values() for g in levels[0]}) + 1

    def p(levels, context, c, order):
        if order == 0:
            return 1 / alphabet
        level = levels[order - 1]
        h = context[len(context) - order + 1 :] if order > 1 else ""
        lower = p(levels, context, c, order - 1)
        n1, n2 = (sum(v == k for v in level.values()) for k in (1, 2))
        d = max(0.1, min(0.95, n1 / (n1 + 2 * n2) if n1 + n2 else 0.5))
        own = {g: v for g, v in level.items() if g[:-1] == h}
        total = sum(own.values())
        if not total:
            return lower
        return max(own.get(h + c, 0) - d, 0) / total + sum(min(v, d) for v in own.values()) / total * lower

    def entropy(y, text):
        s = padded(text)
        return -sum(math.log2(p(tables[y], s[j - 3 : j], s[j], 4)) for j in range(3, len(s))) / (len(s) - 3)

    return sorted(tables), entropy


@pytest.mark.parametrize("piece", [1_000_000, 50])
def test_cross_entropies_are_kneser_neys(noted, notes, monkeypatch, piece):
    langs, entropy = brute_models(notes)
    models = language.learned(noted, ~language.held_out(F.col("id")))
    assert models.langs == langs == sorted(WORDS)
    monkeypatch.setattr(language, "PIECE", piece)
    texts = [t for _, t, _ in notes[:25] if t] + ["zz", "bana shot 字", "  Bana\tNABO-lani ", "x", "é 漢"]
    got, letters = models.entropies(texts)
    assert letters.all()
    for row, text in zip(got, texts, strict=True):
        assert np.allclose(row, [entropy(y, text) for y in langs], atol=1e-4)


def test_language(noted, notes):
    got = language.identify(noted)
    rows = got.collect()
    assert len(rows) == len(notes) and got.columns == ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"]
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["rejected"] for i in (1000, 1001, 1002))
    assert all(by[i]["lang_pred"] == y for i, _, y in notes[:900]) and by[1003]["lang_pred"] == "aa" and by[1005]["lang_pred"] == "aa" and by[None]["lang_pred"] == "bb"
    assert by[1004]["rejected"] and by[1004]["score"] < 0.5 and not by[1005]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in rows) and sum(r["rejected"] for r in rows) < 80
    # Held-out rows' languages change nothing.
    other = noted.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    assert sorted(map(str, language.identify(other).collect())) == sorted(map(str, rows))
    assert language.identify(noted.where("false")).count() == 0
    assert {r["lang_pred"] for r in language.identify(noted.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_models_are_bounded(noted, monkeypatch):
    monkeypatch.setattr(language, "GRAMS", 20)
    models = language.learned(noted, ~language.held_out(F.col("id")))
    assert all(0 < len(t.keys) <= 81 for t in models.grams)
    once = noted.sparkSession.createDataFrame([("x", f"{i:04}", 1) for i in range(3000)], "lang string, gram string, times long")
    assert 200 < language.kept(once, 300).count() < 400


def test_grams_beyond_what_tasks_hold_count_alike(noted, monkeypatch):
    rows = noted.select("doc_id", "text")
    whole = sorted(map(str, language.predicted(rows, language.learned(noted, ~language.held_out(F.col("id")))).collect()))
    for name, most, held in (("GRAMS", 3, 9), ("ROWS", 5, 0)):
        with monkeypatch.context() as m:
            m.setattr(language, name, most)
            models = language.learned(noted, ~language.held_out(F.col("id")))
            assert len(models.hot) <= held
            assert sorted(map(str, language.predicted(rows, models).collect())) == whole


def test_all_languages_are_learned(spark):
    letters = [chr(0x4E00 + i) for i in range(1600)]
    docs = spark.createDataFrame([(i, f"{c}a{c} {c}{c}", f"{i:04}") for i, c in enumerate(letters)], "doc_id long, text string, lang string")
    learned = {r["lang"] for r in docs.where(~language.held_out(F.col("doc_id")) & ~language.calibrates(F.col("doc_id"))).collect()}
    models = language.learned(docs.union(docs.withColumn("doc_id", F.col("doc_id") + 10_000)), ~language.held_out(F.col("id")))
    assert len(models.langs) > 1000 and learned <= set(models.langs)


def test_limits_are_of_all_calibrating_texts(spark):
    draw = random.Random(9)
    docs = [(i, " ".join(draw.choice(WORDS["aa"].split()) for _ in range(draw.randint(1, 9))), "aa") for i in range(24_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    models = language.learned(frame, ~language.held_out(F.col("id")))
    own = [r["text"] for r in frame.where(language.calibrates(F.col("doc_id")) & ~language.held_out(F.col("doc_id"))).collect()]
    assert len(own) > 2 * 500
    assert np.isclose(models.limits[0], np.quantile(models.entropies(own)[0][:, 0], language.PASS), rtol=1e-12)


def test_quantiles(spark):
    draw = np.random.default_rng(4)
    sets = {0: draw.exponential(size=500), 1: np.array([2.5]), 2: np.r_[np.zeros(3), 1e-300, 7.0], 3: np.full(40, 1.1), 4: 1 + draw.random(300) * 1e-13}
    rows = spark.createDataFrame([(no, int(b)) for no, x in sets.items() for b in x.view(np.int64)], "no long, bits long")
    for share in (0.0, 0.3, 0.995, 1.0):
        assert language.quantiles(rows, share) == pytest.approx({no: np.quantile(x, share) for no, x in sets.items()}, rel=1e-14)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    own = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert len(own) > 200 and (own["lang"] == own["lang_pred"]).mean() > 0.98
