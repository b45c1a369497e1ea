"""The pipeline's line stage on passages planted in a hot source."""

import corpus_pipeline

PASSAGES = {f"p{n} " + " ".join(f"word{n}x{i}" for i in range(24)): n for n in (60, 30, 15, 5)}


def test_passages_on_a_few_percent_of_a_hot_source_go(spark):
    texts = []
    for i in range(1000):
        planted = [p for p, n in PASSAGES.items() if (i * 37) % 1000 < n]
        texts.append("\n".join([f"own opening {i}", *planted, f"own ending {i}"]))
    rows = [(i, t, "en", "hot", len(t)) for i, t in enumerate(texts)] + [(1000 + i, f"small {i}\nshared here", "en", "small", 20) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in corpus_pipeline.drop_boilerplate_lines(spark, docs, "").collect()}
    gone = {p for p, n in PASSAGES.items() if n > 10}
    for i, text, _, source, _ in rows:
        want = "\n".join(x for x in text.split("\n") if source != "hot" or x not in gone)
        assert (got[i]["text"], got[i]["n_chars"]) == (want, len(want) if source == "hot" else got[i]["n_chars"])
