"""Repair of conversation structure by a dynamic programme over a grammar of role and fault sequences.

A row is one symbol: the class of its role's initial (system, user, assistant, other) and its first fault (none, truncated,
blank, duplicate). A conversation is the string of its symbols. Re-Pair rounds over the table of distinct strings name their
most frequent neighbours by rules; a symbol of the programme is a terminal or a rule. Each has one min-plus matrix: from a
state of `(s?(ua)+)?` to another, the least cost of its rows' edits and, among equal costs, the ASCII-least audit. A rule's matrix is
the product of its two sides' matrices, so it is evaluated once, bottom-up, and shared by all conversations. Audits are
ropes: two children, a length and a hash, so a product joins them in constant time and compares them by descent.
Costs decide before audits, and audits of one matrix entry with equal costs are never prefixes of each other (they hold the
same rows, and each further insertion costs), so the order is kept by products from both sides.

Scale. Rows are judged by SQL functions; duplicates are found by pre-aggregated first places, joined on (conversation,
turn, role, text), never by the conversation alone. Symbols are put in order by a range partitioning over (conversation, turn, role, text),
so a long conversation is dealt over many tasks in blocks; what comes together in one row is one byte a message, as the
audit has anyway. Rules are learned in bounded rounds over all distinct strings; RULES bounds the grammar, not the
strings: what no rule covers is multiplied symbol by symbol. The last pass streams each conversation's rows in order
through one task, held one batch at a time (a SHA-256 over them in order can't be split).

Defined results. A null role or text counts as one space, also a null id or turn in the damage key; rows of a null id are one
conversation; null turns come first. Rows with equal turns are ordered by role, then by the MD5 of the text; equal rows stand together and
all but the first are duplicates. Initials other than s, u and a can't be kept. Conversations without rows after damage give zeros,
an empty audit and the hash of nothing. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpuslake.llm.shared import written

KEEP, REROLE, DELETE, INSERT, OPEN = 0, 3, 4, 3, 3
STATES = 4  # nothing yet, after s, after u, after a
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
CLASSES, FAULTS = "suao", ("", "truncated", "blank", "duplicate")
BLANKS = " \t\n\x0b\x0c\r"
BLOCK = 4096
ROUNDS, RULES = 10, 256


# Ropes: (length, hash, base to the length, left, right); a leaf has its letter for left and no right.
PRIME, BASE = (1 << 127) - 1, 0x9E3779B97F4A7C15F39CC0605CEDC835 >> 2
EMPTY = (0, 0, 1, None, None)
LETTERS = {c: (1, ord(c), BASE, c, None) for c in "KRDI"}


def joined(a: tuple, b: tuple) -> tuple:
    if not a[0]:
        return b
    if not b[0]:
        return a
    return a[0] + b[0], (a[1] * b[2] + b[1]) % PRIME, a[2] * b[2] % PRIME, a, b


def before(a: tuple, b: tuple) -> bool:
    """Is rope a less than rope b? Equal parts are skipped by length and hash."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x[:2] == y[:2]:
            continue
        if x[0] == y[0] == 1:
            return x[3] < y[3]
        if x[0] >= y[0]:
            left += [x[4], x[3]] if x[0] > 1 else [x]
            right.append(y)
        else:
            right += [y[4], y[3]]
            left.append(x)
    return bool(right)


def spelled(rope: tuple) -> str:
    out, todo = [], [rope]
    while todo:
        x = todo.pop()
        if x[4] is None:
            out.append(x[3] or "")
        else:
            todo += [x[4], x[3]]
    return "".join(out)


def less(a, b) -> bool:
    return b is None or (a is not None and (a[0] < b[0] or (a[0] == b[0] and before(a[1], b[1]))))


def times(v: list, m: list) -> list:
    """Min-plus product of a row of (cost, audit) or None with a matrix."""
    out = [None] * STATES
    for x, row in zip(v, m):
        if x is not None:
            for z, y in enumerate(row):
                if y is not None and (out[z] is None or x[0] + y[0] <= out[z][0]):
                    new = (x[0] + y[0], joined(x[1], y[1]))
                    if less(new, out[z]):
                        out[z] = new
    return out


def product(a: list, b: list) -> list:
    return [times(row, b) for row in a]


def _identity() -> list:
    return [[(0, EMPTY) if x == y else None for y in range(STATES)] for x in range(STATES)]


def insertions() -> list:
    """Any number of inserted rows."""
    one = _identity()
    for (x, role), y in STEPS.items():
        if role != "s":
            one[x][y] = (INSERT, LETTERS["I"])
    return product(product(one, one), one)


def terminal(kind: str, fault: str) -> list:
    """Insertions, then what may be done with a row of this class and fault."""
    row = [[None] * STATES for _ in range(STATES)]
    for x in range(STATES):
        row[x][x] = (DELETE, LETTERS["D"])
    if fault in ("", "truncated"):
        more = OPEN if fault else 0
        for (x, role), y in STEPS.items():
            for cost, letter, can in ((KEEP, "K", role == kind), (REROLE, "R", role != "s")):
                new = (cost + more, LETTERS[letter])
                if can and less(new, row[x][y]):
                    row[x][y] = new
    return product(insertions(), row)


def letter(kind: str, fault: str) -> str:
    return chr(65 + 4 * CLASSES.index(kind) + FAULTS.index(fault))


ALPHABET = {letter(k, f): (k, f) for k in CLASSES for f in FAULTS}
#: Blank and duplicate rows are one symbol of the programme, whatever their role.
TO_PROGRAMME = str.maketrans({c: "X" if f in ("blank", "duplicate") else c for c, (_, f) in ALPHABET.items()})


def compressed(symbols: str, rules: list[str]) -> str:
    for i, pair in enumerate(rules):
        symbols = symbols.replace(pair, chr(0x100 + i))
    return symbols


def matrices(rules: list[str]) -> dict[str, list]:
    """Of every terminal and, bottom-up, of every rule."""
    out = {c.translate(TO_PROGRAMME): terminal(*x) for c, x in ALPHABET.items()}
    for i, (a, b) in enumerate(rules):
        out[chr(0x100 + i)] = product(out[a], out[b])
    return out


def cheapest(symbols: str, rules: list[str], of: dict[str, list]) -> tuple[int, str]:
    """(cost, audit) of a string of terminals."""
    v = [(0, EMPTY), *[None] * (STATES - 1)]
    for c in compressed(symbols.translate(TO_PROGRAMME), rules):
        v = times(v, of[c])
    v, best = times(v, insertions()), None
    for state in ENDS:
        if less(v[state], best):
            best = v[state]
    return best[0], spelled(best[1])


def learned(strings: DataFrame, column: str = "symbols", rounds: int = ROUNDS, most: int = RULES) -> list[str]:
    """Re-Pair rules over all strings of the table. A round counts neighbours (a pair of equal ones without overlaps) where the
    strings are, adds the counts up, and names the most frequent pairs that have no symbol in common."""
    rules: list[str] = []
    for _ in range(rounds):
        known = list(rules)

        def count(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            seen: Counter = Counter()
            for batch in batches:
                for s in batch.column(0).to_pylist():
                    s = compressed(s.translate(TO_PROGRAMME), known)
                    pairs = Counter(map("".join, zip(s, s[1:])))
                    seen.update({p: s.count(p) if p[0] == p[1] else n for p, n in pairs.items()})
            if seen:  # at most the square of the alphabet, which `most` bounds
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["pair", "n"])

        totals = strings.select(column).mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 1")
        taken: set[str] = set()
        for row in totals.orderBy(F.desc("n"), "pair").limit(4 * most).collect():
            if len(rules) < most and not taken & set(row["pair"]):
                rules.append(row["pair"])
                taken |= set(row["pair"])
        if not taken:
            break
    return rules


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies) after the rule of faults by the checksum of `conv:turn`; rows without copies are dropped."""
    filled = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rest = F.crc32(F.concat(filled(conv), F.lit(":"), filled(turn)).cast("binary")) % 20
    new = rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), filled(role).alias("role"), filled(text).alias("text"), rest.alias("rest"))
    return new.filter("rest <> 0").select(
        "conv", "turn", F.when(F.col("rest") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("rest") == 1, "").when(F.col("rest") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("rest") == 3, 2).otherwise(1).alias("copies"),
    )


def plain(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies) of rows as they are."""
    filled = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(c)
    return rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), filled(role).alias("role"), filled(text).alias("text"), F.lit(1).alias("copies"))


ORDER = ("conv", "has", "turn", "role", "mark")


def _placed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("has", F.col("turn").isNotNull()).withColumn("mark", F.md5(F.col("text").cast("binary")))


def _judged(rows: DataFrame) -> DataFrame:
    """(conv, has, turn, role, mark, letter, again, n): different rows with their symbol, their copies' symbol and their number."""
    body = F.rtrim("text", F.lit(BLANKS))
    shape = F.when(body == "", 2).when(F.right(body, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1)
    light = _placed(rows).select(*ORDER, shape.alias("shape"), "copies").groupBy(*ORDER).agg(F.min("shape").alias("shape"), F.sum("copies").alias("n"))
    first = light.groupBy(F.col("conv").alias("c1"), F.col("role").alias("r1"), F.col("mark").alias("m1")).agg(F.min(F.struct("has", "turn")).alias("at"))
    met = F.col("conv").eqNullSafe(F.col("c1")) & (F.col("role") == F.col("r1")) & (F.col("mark") == F.col("m1")) & (F.col("has") == F.col("at.has")) & F.col("turn").eqNullSafe(F.col("at.turn"))
    fault = lambda own: F.when(F.col("shape") == 2, 2).otherwise(own)
    kind = F.when(F.left("role", F.lit(1)).isin(*"sua"), F.instr(F.lit("sua"), F.left("role", F.lit(1))) - 1).otherwise(3)
    name = lambda f: F.char(65 + 4 * kind + f)
    own = fault(F.when(F.col("c1").isNull() & F.col("r1").isNull(), 3).otherwise(F.col("shape")))
    return light.join(first, met, "left").select(*ORDER, name(own).alias("letter"), name(fault(F.lit(3))).alias("again"), "n")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _tables(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches."""
    while part := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows in order -> blocks of at most BLOCK different rows: the first row's place, the turns, the symbols."""
    for _, part in groupby(_rows(batches), key=lambda r: r[0]):
        while block := list(islice(part, BLOCK)):
            turns = [r[2] for r in block if r[2] is not None]
            ends = (turns[0], turns[-1]) if turns else (None, None)
            yield *block[0][:5], *ends, len(set(turns)), "".join(r[5] + r[6] * (r[7] - 1) for r in block)


def _lined(rows: DataFrame) -> DataFrame:
    """(conv, gaps, symbols): the symbols of each conversation in order, from blocks dealt by range."""
    kind = rows.schema["conv"].dataType
    schema = f"conv {kind.simpleString()}, has boolean, turn long, role string, mark string, low long, high long, turns long, symbols string"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    spread = _judged(rows.withColumn("turn", F.col("turn").cast("long"))).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    blocks = spread.mapInArrow(lambda batches: _tables(_block_rows(batches), arrow), schema)
    each = blocks.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("has", "turn", "role", "mark", "low", "high", "turns", "symbols"))).alias("b"))
    # a turn that goes on in the next block counts once
    fold = F.aggregate("b", F.struct(F.lit(None).cast("long").alias("high"), F.lit(0).cast("long").alias("turns")), lambda a, x: F.struct(F.coalesce(x["high"], a["high"]).alias("high"), (a["turns"] + x["turns"] - F.when(x["low"] == a["high"], 1).otherwise(0)).cast("long").alias("turns")))
    lined = each.select("conv", F.array_min("b.low").alias("low"), fold.alias("f"), F.array_join("b.symbols", "").alias("symbols"))
    return lined.select("conv", F.coalesce(F.col("f.high") - F.col("low") + 1 - F.col("f.turns"), F.lit(0)).alias("gaps"), "symbols")


COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def _audited(strings: DataFrame, rules: list[str]) -> DataFrame:
    """(symbols, counts of faults, cost, audit) of different strings."""

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = matrices(rules)
        kinds = str.maketrans({c: k for c, (k, _) in ALPHABET.items()})
        names = {f: [c for c, (_, x) in ALPHABET.items() if x == f] for f in FAULTS}
        schema = pa.schema([("symbols", pa.string()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string())])

        def each() -> Iterator[tuple]:
            for (s,) in _rows(batches):
                line = s.translate(kinds)
                illegal = max(0, len(s) - 1) - sum(line.count(p) for p in ("su", "ua", "au"))
                yield s, *[sum(map(s.count, names[f])) for f in ("blank", "duplicate", "truncated")], illegal, *cheapest(s, rules, of)

        yield from _tables(each(), schema)

    return strings.select("symbols").mapInArrow(audit, f"symbols string, {', '.join(f'{c} long' for c in COUNTS)}, audit string")


HEAD = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _streamed(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """Each conversation's head and then its rows in order, in one partition."""
    nothing = lambda *names: [F.lit(None).cast("long").alias(c) for c in names]
    top = heads.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("boolean").alias("has"), *nothing("turn"), F.lit("").alias("role"), F.lit("").alias("mark"), F.col("audit").alias("text"), F.lit(1).alias("copies"), *HEAD)
    body = _placed(rows).select("conv", F.lit(1).alias("kind"), "has", F.col("turn").cast("long").alias("turn"), "role", "mark", "text", "copies", *nothing(*HEAD))
    return top.unionByName(body).repartition("conv").sortWithinPartitions("conv", "kind", "has", "turn", "role", "mark")


def _repaired(part: Iterator[tuple], audit: str) -> Iterator[tuple]:
    """(edit, turn, role, text) of one conversation's rows in order; a deleted row has its own role and text."""
    left = sum(c != "D" for c in audit)
    rows = ((r[3], r[4], r[6]) for r in part for _ in range(r[7]))
    place = -(left % 2)  # of an odd number the first is an s, which can only be kept; then user and assistant take turns
    for edit in audit:
        role = ("user", "assistant")[place % 2]
        if edit == "I":
            yield edit, None, role, ""
        else:
            turn, own, text = next(rows)
            yield edit, turn, role if edit == "R" else own, text
        place += edit != "D"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for _, part in groupby(_rows(batches), key=lambda r: r[0]):
        head = next(part)
        digest, first = hashlib.sha256(), True
        for edit, _, role, text in _repaired(part, head[6]):
            if edit != "D":
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                first = False
        yield head[0], *head[8:], head[6], digest.hexdigest()


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for _, part in groupby(_rows(batches), key=lambda r: r[0]):
        head = next(part)
        for step, (edit, turn, role, text) in enumerate(_repaired(part, head[6])):
            yield head[0], step, edit, turn, role, text


class Repair:
    """Cheapest repairs of conversations given as (conv, turn, role, text, copies), see `plain` and `damaged`; `every` names
    conversations that count even without a row."""

    def __init__(self, rows: DataFrame, every: DataFrame | None = None, rounds: int = ROUNDS, most: int = RULES):
        self.rows = rows
        lined = written(_lined(rows), "conversation-symbols")
        strings = written(lined.select("symbols").distinct(), "conversation-strings")
        self.rules = learned(strings, rounds=rounds, most=most)
        heads = lined.join(_audited(strings, self.rules), "symbols").drop("symbols")
        if every is not None:
            every = every.select(F.col(every.columns[0]).alias("c0")).distinct()
            heads = every.join(heads, F.col("c0").eqNullSafe(F.col("conv")), "left").drop("conv").withColumnRenamed("c0", "conv")
        self.heads = heads.select("conv", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in HEAD], F.coalesce("audit", F.lit("")).alias("audit"))

    def _through(self, run, columns: str) -> DataFrame:
        kind = self.heads.schema["conv"].dataType.simpleString()
        arrow = to_arrow_schema(T._parse_datatype_string(f"conv {kind}, {columns}"))
        return _streamed(self.heads, self.rows).mapInArrow(lambda batches: _tables(run(batches), arrow), f"conv {kind}, {columns}")

    def messages(self) -> DataFrame:
        """(conv, step, edit, turn, role, text): the edits in order; rows without D are the repaired conversation."""
        return self._through(_messages, "step long, edit string, turn long, role string, text string")

    def digests(self) -> DataFrame:
        """A row for each conversation: faults, cost, audit and the hash of the repaired messages."""
        return self._through(_digests, f"{', '.join(f'{c} long' for c in HEAD)}, audit string, repaired_sha256 string")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return Repair(damaged(rows), rows.select("conv_id")).digests().withColumnRenamed("conv", "conv_id")
