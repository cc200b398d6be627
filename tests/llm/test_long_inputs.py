"""Texts, hosts and paths far beyond the usual length cost in proportion and change no answer."""

import random
import time

import numpy as np

from corpuslake.llm import near_dedup, quality_classifier, url_filter
from corpuslake.llm.shingles import Permutations


def test_minima_of_long_unrelated_texts_differ():
    rng, maps = np.random.default_rng(1), Permutations(120)
    one, two = (near_dedup._sixteen(maps.signature(np.unique(rng.integers(0, 1 << 63, 300_000).astype(np.uint64)))) for _ in range(2))
    assert (one == two).mean() < 0.01


def test_near_copies_among_long_texts(spark):
    rnd = random.Random(3)
    texts = [[str(rnd.randrange(1 << 40)) for _ in range(20_000)] for _ in range(12)]
    texts.append(texts[4][:19_000] + [str(rnd.randrange(1 << 40)) for _ in range(900)])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in near_dedup.keep_one(docs).select("doc_id").collect())
    assert kept == list(range(12))


def test_long_hosts_are_segmented_in_little_time(spark):
    def pages(n):
        word = "".join(random.Random(1).choice("abcdefghij") for _ in range(n))
        rows = [(1, f"http://{word}.com/{word}/x", "<title>a b c abc hij good words</title>"), (2, "http://example.com/en/a", ""), (3, f"http://{'a' * n}.org/{'a' * n}", ""), (4, f"http://goodwords{word}.net/hello/", "")]
        return spark.createDataFrame(rows, "page_id long, url string, html string")

    took = []
    for n in (10, 10, 5000):
        began = time.perf_counter()
        url_filter.judged(pages(n)).collect()
        took.append(time.perf_counter() - began)
    assert took[2] < took[1] + 8
    word = "".join(random.Random(1).choice("abcdefghij") for _ in range(5000))
    runs = spark.createDataFrame([("goodwords" + word,), ("goodwords",), ("a" * 900,)], "run string")
    counts = url_filter.word_counts(pages(5000))
    got = {r["run"]: r["words"] for r in url_filter.segmented(runs, counts).collect()}
    assert got["goodwords"] == ["good", "words"] and got["goodwords" + word] == ["good", "words", word]


def test_filter_loses_no_word(spark):
    words = ["a", "ab", "über", "straße", "\U0001d4d0bc", "x" * 300]
    counts = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    bits, table = url_filter._word_filter(counts, len(words))
    runs = spark.createDataFrame([(i, f"zz{w}qq{w}") for i, w in enumerate(words)], "no long, run string")
    found = {(r["no"], r["word"]) for r in runs.mapInArrow(url_filter._pieces(sorted({len(w) for w in words}), bits, table), "no long, word string").collect()}
    assert {(i, w) for i, w in enumerate(words)} <= found


def test_every_teaching_text_is_used_whole(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * (20_000 if i % 9 == 0 else 5)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    for dictionary, value in ((model.good, 1), (model.bad, 0)):
        own = [r["text"].encode() for r in docs.collect() if r["doc_id"] % 2 == value and r["text"].encode() in dictionary]
        assert len(dictionary) == sum(len(t) + 1 for t in own) and len(own) > 5


def test_leaky_long_text_loses_its_hit_words_in_time(spark):
    """Spans all over a long text: each window of the text is one of the benchmark's."""
    import time

    from corpuslake.llm import decontamination

    item = [f"w{i}" for i in range(40)]
    words = [w for i in range(1000) for w in (*item, f"own{i}")]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "a, b; c"), (3, None), (4, ", ".join(item[:13]) + "!")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "c"), (3, None)], "item_id long, text string")
    begun = time.time()
    got = {r.doc_id: r.text for r in decontamination.remove_spans(docs, bench).collect()}
    assert got[1].split() == [f"own{i}" for i in range(1000)] and got[2] == "a, b; " and got[3] is None and got[4] == ", " * 12 + "!"
    assert time.time() - begun < 60


def test_window_hashes_alone_are_probed_and_broadcast(spark, small):
    """No window's words are built before its hash is met, and the forced broadcast holds hashes only."""
    from corpuslake.llm import decontamination

    plan = decontamination.op3_benchmark_decontamination(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    forced = [line for line in plan.splitlines() if "rightHint=(strategy=broadcast)" in line or "strategy=broadcast" in line]
    assert len(forced) == 1 and "(probe#" in forced[0] and "= hash#" in forced[0] and "array_join" not in forced[0], forced
