"""Character classes of the token operators against the libraries', over every code point, and what their workers keep."""

import base64
import random
import unicodedata

import numpy as np
import public_tokenizers as P
import pytest
import regex

from plumbline.llm import bpe_tree, token_counts, toxicity
from plumbline.llm.common import shared_path
from plumbline.llm.tokens import pieces, units

VOCABULARY, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
#: A letter, a digit or a mark of ten scripts.
BESIDE = "aé1!字ק٣क۵ก뛛Ж́"


def points():
    return [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not 0x40000 <= c < 0xE0000 and c < 0xF0100]


def test_every_code_point_has_the_class_that_the_library_gives_it():
    from tokenizers import pre_tokenizers

    library, pattern = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True), regex.compile(token_counts.PATTERN)
    every = points()
    for start in range(0, len(every), 5000):
        text = " ".join(f"a{chr(c)}1{chr(c)}!{chr(c)}" for c in every[start : start + 5000])
        want = [b - a for _, (a, b) in library.pre_tokenize_str(text)]
        assert [len(p) for u in units(text) for p in pieces(pattern, u)] == want


@pytest.fixture(scope="module")
def unusual():
    """Code points that are letters or numbers for the regex module or in the next blocks, and a tenth of a percent of all."""
    known = regex.compile(r"[\p{L}\p{N}]")
    late = [c for c in points() if known.match(chr(c)) and unicodedata.category(chr(c)) == "Cn"]
    return late[::7] + points()[::1009]


def test_counts_and_ids_of_unusual_letters_equal_the_libraries(unusual):
    import tiktoken
    from tokenizers import Tokenizer

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    library = Tokenizer.from_file(VOCABULARY)
    draw = random.Random(5)
    texts = [chr(c) + b for c in unusual for b in draw.sample(BESIDE, 2)] + [draw.choice(BESIDE) + chr(c) for c in unusual]
    texts += ["\U00018e54뚛", "\U00011db6漢", "".join(map(chr, unusual[:500]))]
    merges, tree = token_counts.merges(VOCABULARY), bpe_tree.codec(RANKS, P.PATTERN)
    assert merges.count_all(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    for text in texts:
        assert b"".join(p for p, _ in tree.parts(text)) == np.array(other.encode_ordinary(text), "<u4").tobytes()


def test_remembered_units_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe_tree, "KEPT_BYTES", 400_000)
    tree, draw = bpe_tree.TreeCodec(RANKS, P.PATTERN), random.Random(1)
    most = 0
    for _ in range(300):
        text = "".join(chr(0x4E00 + draw.randrange(20000)) for _ in range(400))
        assert b"".join(raw for _, raw in tree.parts(text)) == text.encode()
        most = max(most, sum(bpe_tree.OVERHEAD + 4 * len(t) + sum(map(len, f)) for kept in (tree.known, tree.older) for t, f in kept.items()))
    assert most < 420_000


def test_rows_of_the_fit_are_bounded_at_any_length():
    draw = np.random.default_rng(2)
    for n in (0, 5, 8191, 8192, 50_000, toxicity.BUCKETS):
        grams = draw.permutation(toxicity.BUCKETS)[:n].astype(np.int32)
        row = toxicity.packed(grams)
        assert len(row) <= toxicity.BUCKETS // 8 and (toxicity.unpacked(row) == np.sort(grams)).all()
    # Long rows and short ones of one law get one fit: opened anew each round or once, weights are the same.
    rows = [draw.permutation(3000)[:900] + (20_000 if i % 2 else 0) for i in range(40)]
    labels = np.arange(40) % 2
    short, bias = toxicity.fit([toxicity.packed(r) for r in rows], labels)
    filler = np.arange(100_000, 110_000)
    long, long_bias = toxicity.fit([toxicity.packed(np.r_[r, filler]) for r in rows], labels)
    assert np.allclose(short, long, atol=1e-6) and abs(bias - long_bias) < 1e-6 and (short[20_000:23_000] >= 0).all()


def test_a_worker_keeps_no_texts_after_its_task(spark):
    import pyarrow as pa

    docs = spark.createDataFrame([(i, f"word{i} and again{i}") for i in range(400)], "doc_id long, text string").repartition(4)
    assert bpe_tree.encode(docs, RANKS, P.PATTERN).where("matches").count() == 400
    name = RANKS.rsplit("/", 1)[-1]

    def left(batches):
        for _ in batches:
            pass
        tree = bpe_tree.codec(shared_path(name), P.PATTERN)
        yield pa.RecordBatch.from_pydict({"n": [len(tree.known) + len(tree.older)]})

    assert {r["n"] for r in spark.range(64).repartition(4).mapInArrow(left, "n long").collect()} == {0}
