"""Similarity joins of word sets (V5, J7, J16): equal sets are one kind, different kinds meet at their rarer words.

The index holds no words but the rarest of each kind, with their position in the group's order of words (by use) and a
signature. A pair that meets at a word is dropped at once if the words that may still follow in both are too few, or if the
signatures differ in more bits than alike sets of these sizes can. Sizes are part of the join key, as bands; a word that very many
kinds have is dealt in cells of (left, right) blocks, each pair in one. Pairs that are left are compared on whole sets.
No filter drops an alike pair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions.text import jaccard, token_set
from corpuslake.sources.tables import written

WORD_BLOCK = 4_096  # kinds of a word in one block


def kinds(rows: DataFrame, key: str, text: str, within: str) -> DataFrame:
    """(within, words, kind, n): the distinct word sets of each group, named by their least key, as a written table
    (each later step reads it). Texts without words go."""
    words = rows.select(F.col(within).alias("within"), F.col(key).alias("key"), F.array_sort(token_set(F.col(text))).alias("words"))
    return written(words.filter(F.size("words") > 0).groupBy("within", "words").agg(F.min("key").alias("kind"), F.count(F.lit(1)).alias("n")), "kinds")


def _band(size: Column, least: float) -> Column:
    """Sizes of one band differ by a factor of `least` at most; monotone in the size."""
    return F.floor(F.log(size) / F.log(F.lit(1 / least))) if least < 1 else size.cast("long")


def prefix_index(sets: DataFrame, least: float) -> DataFrame:
    """(within, word, kind, size, at, s0, s1): the words of each kind that an alike kind must share one of, rarest first, but
    words of one kind alone. `at` is the word's place; s0 and s1 hold the parity of the kind's words by hash, 64 bits each."""
    each = sets.select("within", "kind", F.explode("words").alias("word"))
    uses = each.groupBy("within", "word").agg(F.count(F.lit(1)).alias("uses"))
    bit = lambda half: F.expr(f"bit_xor(CASE WHEN shiftrightunsigned(xxhash64(word), 63) = {half} THEN shiftleft(1L, cast(xxhash64(word) & 63 AS int)) ELSE 0L END)")
    ordered = each.join(uses, ["within", "word"]).groupBy("within", "kind").agg(F.array_sort(F.collect_list(F.struct("uses", "word"))).alias("by_use"), bit(0).alias("s0"), bit(1).alias("s1"))
    size = F.size("by_use")
    prefix = F.slice("by_use", 1, (size - F.ceil(size * least - 1e-9) + 1).cast("int"))
    placed = ordered.select("within", "kind", size.alias("size"), "s0", "s1", F.posexplode(prefix).alias("at", "x"))
    return placed.filter("x.uses > 1").select("within", F.col("x.word").alias("word"), "kind", "size", "at", "s0", "s1")


def _sides(index: DataFrame, least: float, block: int) -> tuple[DataFrame, DataFrame]:
    """The index as smaller and as larger sets, dealt by (within, word, i, j, band): i is the left side's block of a word,
    j the right side's."""
    hot = index.groupBy("within", "word").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > block).select("within", "word", F.ceil(F.col("held") / block).cast("int").alias("blocks"))
    dealt = index.join(hot, ["within", "word"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("kind"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    side = lambda s, mine, other, band: dealt.select("within", "word", own.alias(mine), every.alias(other), band.alias("band"), *[F.col(c).alias(f"{c}_{s}") for c in ("kind", "size", "at", "s0", "s1")])
    # the smaller set is listed in each band that a larger partner may be in
    reach = F.sequence(_band(F.col("size"), least), _band(F.floor(F.col("size") / least + 1e-9), least))
    return side("l", "i", "j", reach).withColumn("band", F.explode("band")), side("r", "j", "i", _band(F.col("size"), least))


def candidates(index: DataFrame, least: float, wanted: Callable[[Column, Column], Column] | None = None, block: int = WORD_BLOCK) -> DataFrame:
    """(within, a, b), a < b: pairs of kinds that meet at a word and pass the bounds, each once. `wanted` narrows the pairs
    by their two names."""
    left, right = _sides(index, least, block)
    l, r = F.col("size_l"), F.col("size_r")
    common = F.ceil((l + r) * (least / (1 + least)) - 1e-9)  # words that alike sets of these sizes share
    order = (l < r) | ((l == r) & (F.col("kind_l") < F.col("kind_r")))
    follows = F.least(l - F.col("at_l"), r - F.col("at_r")) >= common  # true at the first word that an alike pair shares
    apart = F.bit_count(F.col("s0_l").bitwiseXOR(F.col("s0_r"))) + F.bit_count(F.col("s1_l").bitwiseXOR(F.col("s1_r")))
    met = left.join(right, ["within", "word", "i", "j", "band"]).filter(order & follows & (apart <= l + r - 2 * common))
    swapped = F.col("kind_l") < F.col("kind_r")
    a, b = F.when(swapped, F.col("kind_l")).otherwise(F.col("kind_r")), F.when(swapped, F.col("kind_r")).otherwise(F.col("kind_l"))
    pairs = met.select("within", a.alias("a"), b.alias("b"))
    return (pairs if wanted is None else pairs.filter(wanted(F.col("a"), F.col("b")))).distinct()


def links(sets: DataFrame, least: float, wanted: Callable[[Column, Column], Column] | None = None, block: int = WORD_BLOCK) -> DataFrame:
    """(within, a, b, na, nb, similarity) of kinds that are as similar as that, a < b, each pair once. 0 < least <= 1."""
    pairs = candidates(written(prefix_index(sets, least), "prefixes"), least, wanted, block)
    side = lambda s: sets.select("within", F.col("kind").alias(s), F.col("n").alias(f"n{s}"), F.col("words").alias(f"w{s}"))
    scored = pairs.join(side("a"), ["within", "a"]).join(side("b"), ["within", "b"])
    return scored.select("within", "a", "b", "na", "nb", jaccard(F.col("wa"), F.col("wb")).alias("similarity")).filter(F.col("similarity") >= least)


def linked(rows: DataFrame, key: str, text: str, within: str, least: float) -> DataFrame:
    """(within, key, kind, n_links) for each row: the least key with the same words, and how many other rows of its group
    are as similar as that. Rows without words are their own kind and have no links."""
    sets = kinds(rows, key, text, within)
    found = links(sets, least)
    ends = found.select("within", F.col("a").alias("kind"), F.col("nb").alias("n")).union(found.select("within", "b", "na"))
    near = ends.groupBy("within", "kind").agg(F.sum("n").alias("near"))
    counted = sets.join(near, ["within", "kind"], "left").select(F.col("within").alias("__w"), F.col("words").alias("__words"), "kind", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    named = rows.select(F.col(within).alias("within"), F.col(key).alias("key"), F.array_sort(token_set(F.col(text))).alias("words"))
    joined = named.join(counted, (F.col("within") == F.col("__w")) & (F.col("words") == F.col("__words")), "left")
    return joined.select("within", "key", F.coalesce("kind", "key").alias("kind"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
