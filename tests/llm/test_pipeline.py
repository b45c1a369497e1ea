"""The pipeline's stages on the smallest tables, each against brute force over its own input."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers as P

import __spark_entry__
import corpus_pipeline
from plumbline.llm.line_dedup import DOCUMENT_RATIO
from plumbline.llm import toxicity
from plumbline.llm.common import table
from tests.llm.test_operators_llm import water_fill

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def check_toxicity(spark, before, after):
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(before, table(spark, FOLDER, "labels")).collect()}
    assert {r["doc_id"] for r in after.collect()} == {i for i, p in scores.items() if p == 0}


def check_line_dedup(spark, before, after):
    rows = [(r["doc_id"], r["source"], [x.strip(" ") for x in r["text"].split("\n")], r["text"]) for r in before.collect()]
    pages, on = {}, Counter()
    for _, source, lines, _ in rows:
        pages.setdefault(source, set()).add(tuple(lines))
    for source, own in pages.items():
        on.update((source, line) for page in own for line in set(page) - {""})
    want = {}
    for i, source, lines, text in rows:
        kept = [x for x in lines if not (on[source, x] >= 3 and on[source, x] > DOCUMENT_RATIO * len(pages[source]))]
        want[i] = "\n".join(kept) if len(kept) < len(lines) else text
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in after.collect()} == {i: (t, len(t)) for i, t in want.items()}


def check_minhash_near_dedup(spark, before, after):
    sets = {}
    for r in before.collect():
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    changed = True
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    assert Counter(r["doc_id"] for r in after.collect()) == Counter(i for i in sets if label[i] == i)


def check_source_mix(spark, before, after):
    size, own, times = Counter(), {}, Counter(r["doc_id"] for r in after.collect())
    for r in before.collect():
        own[r["doc_id"]] = (r["source"], len(WORD.findall(r["text"])))
        size[r["source"]] += own[r["doc_id"]][1]
    names = sorted(size)
    want = dict(zip(names, water_fill([size[n] for n in names], [(1, 2, 3)[i % 3] for i in range(len(names))], 3), strict=True))
    taken = Counter()
    for i, n in times.items():
        assert n <= 3
        taken[own[i][0]] += n * own[i][1]
    longest = {s: max(n for t, n in own.values() if t == s) for s in names}
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in names)


def check_bpe_encode(spark, before, after):
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r["doc_id"], hashlib.sha256(np.array(e.encode_ordinary(r["text"]), "<u4").tobytes()).hexdigest()) for r in before.collect())
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in after.collect()) == want


def test_stages(spark, tmp_path):
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        globals()[f"check_{name}"](spark, before, docs)


def test_run_is_registered(spark):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in __spark_entry__.oracle_sql()
