"""Conversation repair and periodic runs against plain computations of the same rules."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from corpuslake.llm import conversation_repair as repair
from corpuslake.llm import periodic_runs as periodic

SPACE = " \t\n\x0b\x0c\r"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Conversation repair


def faulty(rows):
    """The damage rule on (conv, turn, role, text) tuples."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def expected(rows):
    """{conv: values} by a plain programme over whole audits."""
    made = faulty(rows)
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in made if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        turns = {r[1] for r in own if r[1] is not None}
        seen, faults = set(), []
        for _, _, role, text in own:
            body = text.rstrip(SPACE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        first = [r[2][:1] for r in own]
        best = {0: (0, "", ())}

        def put(table, state, value):
            if state not in table or value < table[state]:
                table[state] = value

        moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

        def inserted(table):
            table = dict(table)
            for _ in range(3):
                for (x, c), y in moves.items():
                    if c != "s" and x in table:
                        cost, audit, said = table[x]
                        put(table, y, (cost + 3, audit + "I", (*said, ({"u": "user", "a": "assistant"}[c], ""))))
            return table

        for (_, _, role, text), fault, c0 in zip(own, faults, first):
            new = {}
            for x, (cost, audit, said) in inserted(best).items():
                put(new, x, (cost + 4, audit + "D", said))
                for (x2, c), y in moves.items():
                    if x2 == x and fault in ("", "truncated"):
                        more = cost + 3 * bool(fault)
                        if c == c0:
                            put(new, y, (more, audit + "K", (*said, (role, text))))
                        if c != "s":
                            put(new, y, (more + 3, audit + "R", (*said, ({"u": "user", "a": "assistant"}[c], text))))
            best = new
        cost, audit, said = min(v for x, v in inserted(best).items() if x in (0, 3))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        out[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in said)))
    return out


def values(rows):
    return {r[0]: tuple(r)[1:] for r in rows}


def test_repair_of_all_conversations(spark, small):
    rows = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert values(repair.op12_conversation_repair(spark, small).collect()) == expected([tuple(r) for r in rows.collect()])


@pytest.fixture(scope="module")
def odd_conversations(spark):
    """Nulls in each column, ties, repeated rows, unknown roles, gaps, a long conversation, and clashing names."""
    rnd = random.Random(5)
    rows = [(None, 1, "user", "a."), (None, None, None, None), (3, None, "assistant", "b!"), (3, None, "user", ""), (4, 7, "tool", "x."), (4, 7, "user", "y."), (4, 7, "user", "y."), (4, 900, "user", "  \n"), (5, -4, "", "z?")]
    rows += [(c, t, rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice(["Yes.", "No!", "so", "", "a b?", "é"])) for c in range(10, 60) for t in range(rnd.randint(1, 14))]
    rows += [(99, t, rnd.choice(["user", "assistant"]), f"say {t % 700}.") for t in range(9000)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS cost", "'x' AS conv", "2 AS kind", "'y' AS symbols", "0 AS gaps")


def test_repair_of_odd_rows(odd_conversations):
    rows = odd_conversations.select("conv_id", "turn", "role", "text")
    got = values(repair.Repair(repair.damaged(odd_conversations), rows.select("conv_id")).digests().collect())
    assert got == expected([tuple(r) for r in rows.collect()])
    assert repair.Repair(repair.damaged(odd_conversations.limit(0)), rows.limit(0)).digests().collect() == []


def test_repaired_messages_have_the_wanted_order(odd_conversations):
    told = repair.Repair(repair.plain(odd_conversations)).messages().filter("edit <> 'D'").orderBy("conv", "step").collect()
    lines: dict = {}
    for r in told:
        lines.setdefault(r["conv"], []).append(r["role"][:1])
    assert lines and all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in lines.values())


def test_rules_do_not_change_the_answer():
    rnd = random.Random(7)
    strings = ["".join(rnd.choice(list(repair.ALPHABET)) for _ in range(rnd.randint(0, 40))) for _ in range(60)]
    terminals = repair.matrices([])
    rules = []
    for i in range(40):
        rules.append("".join(rnd.sample([*terminals, *[chr(0x100 + k) for k in range(i)]], 2)))
    of = repair.matrices(rules)
    assert [repair.cheapest(s, rules, of) for s in strings] == [repair.cheapest(s, [], terminals) for s in strings]


def test_ropes_compare_as_their_letters():
    rnd = random.Random(8)
    pool = [(c, x) for c, x in repair.LETTERS.items()]
    for _ in range(300):
        (a, x), (b, y) = rnd.choice(pool), rnd.choice(pool)
        pool.append((a + b, repair.joined(x, y)))
        assert repair.before(x, y) == (a < b) and repair.spelled(x) == a


# Periodic runs


def plain_runs(x):
    found = {}
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            start = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q):
                found.setdefault((start, i + q), q)
            i += 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def runs_expected(doc_id, text):
    words = [w for w in re.split(f"[{SPACE}]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n and doc_id is not None:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(kept)))


def test_runs_of_all_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").filter("length(text) < 12000").select("doc_id", "text")
    got = sorted(map(tuple, periodic.runs(docs, rule=periodic.damage, full=False).collect()))
    assert got == sorted(runs_expected(*r) for r in docs.collect())
    assert sum(r[1] for r in got) > 5


def test_runs_of_odd_texts(spark, odd_docs, no_docs):
    more = spark.createDataFrame([(20 + i, t) for i, t in enumerate(["a " * 5, "a " * 6, " \x0ba\x0ca\ra\ta\na a", "a b " * 4 + "a", "A a A a A a A a", "x\x1cy\x85 " * 9, "u v w " * 40_000])], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").union(more)
    got = sorted(map(repr, map(tuple, periodic.runs(docs, rule=periodic.damage, full=False).collect())))
    plain = [runs_expected(*r) for r in docs.filter("length(text) < 15000 OR text IS NULL").collect()]
    assert set(map(repr, plain)) <= set(got) and len(got) == docs.count()
    assert periodic.runs(no_docs).collect() == []
    long = periodic.runs(more.filter("doc_id = 26")).collect()[0]
    assert (long["n_runs"], long["length"], long["period"], long["collapsed"]) == (1, 120_000, 3, "u v w")


def test_matcher_equals_the_plain_search():
    rnd = random.Random(11)
    for _ in range(400):
        docs = []
        for _ in range(rnd.randint(0, 5)):
            n, k = rnd.randint(0, 70), rnd.randint(1, 3)
            x = [rnd.randint(0, k) for _ in range(n)]
            if n > 4 and rnd.random() < 0.7:
                a = rnd.randrange(n)
                p = 1 + (n - a) // rnd.randint(3, 10)
                x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
            docs.append(x)
        ends = np.cumsum([0, *map(len, docs)])
        got = [[] for _ in docs]
        for d, s, e, q in periodic.Matcher(np.array([w for x in docs for w in x], np.int64), ends).runs().tolist():
            got[d].append((s - int(ends[d]), e - s, q))
        assert got == [plain_runs(x) for x in docs]
