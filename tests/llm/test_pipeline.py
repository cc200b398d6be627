import re

import sentencepiece
from test_operators import brute_classes, brute_dedup

import corpus_pipeline
from corpuslake.llm import quality_rules, sentence_pieces


def _fails(text):
    m = dict(zip(quality_rules.MEASURES.fieldNames(), quality_rules._measure(text)))
    return any(eval(rule, {}, m) for _, rule in quality_rules.RULES)


def _cut(text, counts):
    """The text without the bytes of 200-byte strings that start elsewhere; torn characters go."""
    body = text.encode()
    gone, end = bytearray(len(body)), 0
    for i in range(len(body) - 199):
        if counts[body[i : i + 200]] > 1:
            gone[max(i, end) : i + 200] = b"\1" * (i + 200 - max(i, end))
            end = i + 200
    return bytes(x for x, y in zip(body, gone) if not y).decode("utf-8", "ignore") if any(gone) else text


def _leaks(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    hit = set()
    for size in {len(w) for w in items}:
        hit |= {j for i in range(len(words) - size + 1) if tuple(words[i : i + size]) in items for j in range(i, i + size)}
    return bool(hit) and 20 * len(hit) >= len(words)


def test_run_equals_brute_force(spark, small):
    """Every stage on what its predecessor kept, each computed the plain way."""
    from collections import Counter

    docs = sorted(spark.read.parquet(f"{small}/documents.parquet").collect(), key=lambda r: r.doc_id)
    good = [r for r in docs if not _fails(r.text)]
    roots, _ = brute_classes([r.text for r in good], 5)
    single = [r for i, r in enumerate(good) if roots[i] == i]
    removed = brute_dedup([r.text for r in single])
    counts = Counter()
    for r in single:
        body = r.text.encode()
        counts.update(body[i : i + 200] for i in range(len(body) - 199))
    cut = {r.doc_id: _cut(r.text, counts) for r in single}
    assert any(x[1] for x in removed) and all((len(r.text.encode()) > len(cut[r.doc_id].encode())) == bool(x[1]) for r, x in zip(single, removed))
    windows = set()
    for r in spark.read.parquet(f"{small}/benchmark.parquet").collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        size = min(13, len(words))
        windows |= {tuple(words[i : i + size]) for i in range(len(words) - size + 1) if size}
    clean = {i: t for i, t in cut.items() if not _leaks(t, windows)}
    model = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    run = corpus_pipeline.run(spark, small).collect()
    assert {(r.doc_id, r.text) for r in run} == set(clean.items()) and len(run) == len(clean) and all(r.round_trip for r in run)
    assert all(r.ids == model.encode(r.text) for r in run if "▁" not in r.text)
    assert len(good) < len(docs) and len(single) < len(good)


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, small)
        assert frame.columns == docs.columns


def test_odd_and_empty_tables(spark, odd_docs, no_docs, small):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, small).cache()
            docs.count()
