"""Toxic passages: segments against their recursive definition, the score against labels that were held out."""

import random

import pytest

from corpuslake.llm import toxicity as tx


def by_definition(values, first=0):
    """All maximal segments: the heaviest stretch (of equals the shortest), and those of what lies left and right of it."""
    best = (0.0, 0, None)
    for i in range(len(values)):
        total = 0.0
        for j in range(i, len(values)):
            total += values[j]
            if (total, i - j) > best[:2]:
                best = (total, i - j, (i, j + 1))
    if best[2] is None:
        return []
    a, b = best[2]
    return by_definition(values[:a], first) + [(first + a, first + b, best[0])] + by_definition(values[b:], first + b)


def test_segments_follow_their_definition():
    rnd = random.Random(3)
    for _ in range(500):
        n = rnd.randint(0, 30)
        hits = [(i, rnd.uniform(-3, 3)) for i in range(n) if rnd.random() < 0.5]
        values = [-0.37] * n
        for i, s in hits:
            values[i] = s
        got, want = tx.segments(hits, drift=0.37), by_definition(values)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert [x[2] for x in got] == pytest.approx([x[2] for x in want])


def test_rate_is_the_root():
    import numpy as np

    scores, shares = np.array([3.0, 1.0, -1.0]), np.array([0.001, 0.01, 0.1])
    rate = tx._rate(scores, shares)
    assert (1 - shares.sum()) * np.exp(-rate * tx.DRIFT) + shares @ np.exp(rate * scores) == pytest.approx(1, abs=1e-6)


def test_units_and_lexicon():
    assert tx.units("über".encode()) == ["über$".encode()]
    assert tx.units(b"abcdefghij") == [b"abcdefghij$", b"abcd", b"abcde", b"abcdef", b"abcdefg", b"abcdefgh"]
    known = tx.Lexicon({b"abcd": 1.0, b"abcdx$": -2.0})
    assert (known[b"abcdx"], known[b"abcdy"], known[b"abc"]) == (-2.0, 1.0, 0.0)


@pytest.fixture(scope="module")
def labelled(spark):
    """Clean texts, and toxic ones with a passage of insults at any place; some repeat, some are long."""
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(700):
        text = rnd.choices(words, k=rnd.randint(20, 3000 if i % 50 == 0 else 200))
        toxic = i % 5 == 0
        if toxic:
            at = rnd.randrange(len(text))
            text[at:at] = [rnd.choice(["Vile", "foul", "nasty", "rotten"]) for _ in range(4)]
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_planted_passages_are_found(labelled):
    docs, labels = labelled
    model = tx.fit(docs, labels)
    rows = tx.passages(docs, model).join(labels, "doc_id").collect()
    wrong = [r for r in rows if (r["score"] >= tx.CUTOFF) != (r["toxic"] == 1)]
    assert len(wrong) <= 3
    for r in rows:
        places = [i for i, w in enumerate(tx.words_of(r["text"])) if w in (b"vile", b"foul", b"nasty", b"rotten")]
        if places and r["passages"]:
            first = r["passages"][0]
            assert first["start"] <= places[0] + 2 and first["expected"] <= tx.EXPECTED


def test_held_out_rows_are_told_apart(spark):
    rows = tx.op11_toxicity(spark, "/root/testdata/sf0.1").filter("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").select("score", "toxic", "predicted").collect()
    bad, good = ([r["score"] for r in rows if r["toxic"] == v] for v in (1, 0))
    auc = sum((a > b) + 0.5 * (a == b) for a in bad for b in good) / (len(bad) * len(good))
    print(f"AUC {auc:.4f}, accuracy {sum(r['predicted'] == r['toxic'] for r in rows) / len(rows):.4f} on {len(rows)} held-out rows")
    assert auc > 0.95


def test_odd_rows(spark, odd_docs, no_docs, labelled):
    model = tx.fit(*labelled)
    rows = {r["doc_id"]: r for r in tx.passages(odd_docs.withColumn("score", odd_docs["doc_id"]), model).collect()}
    assert "score_input" in rows[1].asDict() and all(0 <= r["score"] <= 1 for r in rows.values())
    assert rows[3]["score"] == rows[4]["score"] == rows[5]["score"]  # null, empty and blank texts have no evidence
    assert tx.passages(no_docs, model).collect() == []
    labels = spark.createDataFrame([(1, 1), (None, 0), (3, 7), (6, None)], "doc_id long, toxic int")
    assert {r["score"] for r in tx.passages(odd_docs, tx.fit(odd_docs, labels)).collect()} == {0.5}  # one class only
    assert {r["score"] for r in tx.passages(odd_docs, tx.fit(no_docs, labels.limit(0))).collect()} == {0.5}
