import random

from corpuslake.operators import similarity


def test_similarity_equals_all_pairs(spark):
    """Copies, near copies, empty and null texts, a word that every text has, groups of one."""
    rng = random.Random(6)
    rows = []
    for i in range(160):
        words = ["common"] + [f"w{rng.randrange(9)}" for _ in range(rng.randint(0, 7))]
        rows.append((i, rng.choice("aab"), None if i % 40 == 3 else "" if i % 40 == 5 else " ".join(words)))
    df = spark.createDataFrame(rows, "id int, box string, text string")
    sets = {i: frozenset((t or "").lower().split()) for i, _, t in rows}
    box = {i: b for i, b, _ in rows}
    for least in (0.5, 0.7, 1.0):
        alike = lambda i, j: box[i] == box[j] and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least
        got = {r.key: (r.within, r.kind, r.n_links) for r in similarity.linked(df, "id", "text", "box", least).collect()}
        for i in sets:
            same = [j for j in sets if box[j] == box[i] and sets[j] == sets[i]] if sets[i] else [i]
            assert got[i] == (box[i], min(same), sum(j != i and bool(alike(i, j)) for j in sets)), (least, i)
        pairs = similarity.links(similarity.kinds(df, "id", "text", "box"), least).collect()
        assert len({(r.within, r.a, r.b) for r in pairs}) == len(pairs)
    assert similarity.linked(df.limit(0), "id", "text", "box", 0.7).count() == 0


def test_hot_word_is_dealt_in_cells_and_no_pair_is_lost(spark):
    """Every set has the same two words, so they are all that some prefixes hold; cells of 8 give what one block gives."""
    rng = random.Random(3)
    rows = [(i, "a", " ".join(["x", "y"] + [f"w{rng.randrange(14)}" for _ in range(rng.randint(0, 6))])) for i in range(150)]
    sets = similarity.kinds(spark.createDataFrame(rows, "id int, box string, text string"), "id", "text", "box")
    words = {r.kind: set(r.words) for r in sets.collect()}
    for least in (0.3, 0.6, 0.8):
        true = {(a, b) for a in words for b in words if a < b and len(words[a] & words[b]) / len(words[a] | words[b]) >= least}
        for block in (8, 4096):
            got = [(r.a, r.b) for r in similarity.links(sets, least, block=block).collect()]
            assert len(got) == len(set(got)) and set(got) == true, (least, block)


def test_filters_leave_few_pairs_of_a_common_word(spark):
    """1,500 different sets of six words that share four: their two rare words differ, so nearly none is compared in full."""
    rows = [(i, "a", f"p q r s u{i} v{i}") for i in range(1500)] + [(2000 + i, "a", f"p q r s u{i} z{i}") for i in range(40)]
    sets = similarity.kinds(spark.createDataFrame(rows, "id int, box string, text string"), "id", "text", "box")
    assert similarity.candidates(similarity.prefix_index(sets, 0.7), 0.7).count() == 40
    assert similarity.links(sets, 0.7).count() == 40
    assert similarity.links(sets, 0.7, lambda a, b: b < 2010).count() == 10


def test_cells_of_a_planted_common_word_are_even(spark):
    """A word that everyone uses is dealt in cells: the largest holds less than five times the median on either side."""
    rows = [(i, "a", f"all n{i % 40} m{i // 40}") for i in range(4000)]
    sets = similarity.kinds(spark.createDataFrame(rows, "id int, box string, text string"), "id", "text", "box")
    for side in similarity._sides(similarity.prefix_index(sets, 0.3), 0.3, 64):
        held = sorted(r["count"] for r in side.filter("word = 'all'").groupBy("i", "j", "band").count().collect())
        assert len(held) > 1000 and held[-1] < 5 * held[len(held) // 2]
