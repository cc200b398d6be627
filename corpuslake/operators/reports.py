"""Period, activity, worklog and goal reports over entries(entry_id, ts, type, topic, tags, words, n_links, tenant)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def worklog_report(rows: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Per workstream in the last days: count, first and last day, activity mix."""
    recent = rows.filter(F.col("ts") >= F.date_sub(F.to_date(as_of), days))
    mix = recent.groupBy("workstream", "activity").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return mix.groupBy("workstream").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("activity", "n")))).alias("mix"))


def period_summary(entries: DataFrame) -> DataFrame:
    """Counts by type, weekday and topic in one pass, as facets; the mean of words."""
    facets = F.array(F.struct(F.lit("all").alias("facet"), F.lit("").alias("value")), F.struct(F.lit("type").alias("facet"), F.col("type").alias("value")), F.struct(F.lit("weekday").alias("facet"), F.date_format("ts", "E").alias("value")), F.struct(F.lit("topic").alias("facet"), F.col("topic").alias("value")))
    each = entries.select("words", F.explode(facets).alias("f"))
    return each.groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("words"), 4).alias("mean_words"))


def recurring(entries: DataFrame, least: int = 2) -> DataFrame:
    return entries.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def sentiment_by_week(entries: DataFrame) -> DataFrame:
    """Weekly counts of each sentiment."""
    week = F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week")
    names = ("positive", "neutral", "negative")
    return entries.groupBy(week).agg(*[F.count_if(F.col("sentiment") == s).alias(s) for s in names])


def context_split(entries: DataFrame) -> DataFrame:
    """Work, system and personal entries with their shares."""
    context = F.when(F.array_contains("tags", "work"), "work").when(F.col("type").isin("briefing", "summary", "analysis"), "system").otherwise("personal")
    counts = entries.groupBy(context.alias("context")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("context", "n", F.round(100 * F.col("n") / F.col("total"), 2).alias("percent"))  # one row


def tag_pairs(entries: DataFrame) -> DataFrame:
    """How often two tags stand on one entry (A15); an entry's own tags are few."""
    tags = F.array_sort(F.array_distinct("tags"))
    pairs = F.flatten(F.transform(tags, lambda a, i: F.transform(F.slice(tags, i + 2, F.greatest(F.size(tags), F.lit(1))), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return entries.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


def link_density(entries: DataFrame) -> DataFrame:
    return entries.agg(F.round(F.avg("n_links"), 4).alias("mean_links"), F.count_if(F.col("n_links") == 0).alias("n_unlinked"), F.max("n_links").alias("most_links"))


def rhythm(entries: DataFrame) -> DataFrame:
    """Entries by day of week and hour."""
    return entries.groupBy(F.dayofweek("ts").alias("weekday"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def busiest(entries: DataFrame) -> DataFrame:
    """Most active weekday and hour; the earlier of equal ones."""
    r = rhythm(entries)
    by = lambda c: r.groupBy(c).agg(F.sum("n").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("o"), c)).alias("x")).select(F.col(f"x.{c}").alias(c))
    return by("weekday").join(by("hour"))  # two single rows


def types_by_week(entries: DataFrame) -> DataFrame:
    return entries.groupBy(F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week"), "type").agg(F.count(F.lit(1)).alias("n"))


def dropped_threads(entries: DataFrame, as_of: Column, back: int = 90, most: int = 2, quiet: int = 14) -> DataFrame:
    """Topics begun in the look-back, with few entries, quiet for days."""
    seen = entries.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return seen.filter((F.col("first") >= F.date_sub(F.to_date(as_of), back)) & (F.col("n") <= most) & (F.col("last") < F.date_sub(F.to_date(as_of), quiet)))


def bursts(entries: DataFrame, least: int = 5, days: int = 2) -> DataFrame:
    """Entries whose topic has `least` or more entries in the days up to them (A20). A range frame over time."""
    w = Window.partitionBy("topic").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-days * 86_400_000_000, 0)
    return entries.withColumn("in_frame", F.count(F.lit(1)).over(w)).filter(F.col("in_frame") >= least)


def switches(entries: DataFrame) -> DataFrame:
    """Topics and topic switches of each day and tenant."""
    w = Window.partitionBy("tenant", F.to_date("ts")).orderBy("ts", "entry_id")
    moved = F.coalesce((F.lag("topic").over(w) != F.col("topic")).cast("int"), F.lit(0))
    return entries.withColumn("s", moved).groupBy("tenant", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.countDistinct("topic").alias("n_topics"), F.sum("s").alias("n_switches"))


def goal_alignment(goals: DataFrame, entries: DataFrame) -> DataFrame:
    """Goals with the entries that serve them, goals without and entries without."""
    served = entries.groupBy("topic").agg(F.count(F.lit(1)).alias("n_entries"))
    return goals.join(served, "topic", "full_outer").select("goal", "topic", F.coalesce("n_entries", F.lit(0)).alias("n_entries"), F.when(F.col("goal").isNull(), "no goal").when(F.col("n_entries").isNull(), "no entry").otherwise("served").alias("status"))


def goal_status(goals: DataFrame, entries: DataFrame, as_of: Column) -> DataFrame:
    """green: three or more entries in a week, yellow: some, red: none but some in a month, white: none."""
    day = F.to_date(as_of)
    counts = entries.groupBy("topic").agg(F.count_if(F.col("ts") >= F.date_sub(day, 7)).alias("week"), F.count_if(F.col("ts") >= F.date_sub(day, 30)).alias("month"))
    return goals.join(counts, "topic", "left").select("goal", F.when(F.col("week") >= 3, "green").when(F.col("week") >= 1, "yellow").when(F.col("month") >= 1, "red").otherwise("white").alias("status"))


def catch_up(entries: DataFrame, since: Column) -> DataFrame:
    """By day since then: entries, types, topics, inbox items."""
    return entries.filter(F.col("ts") >= since).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("type").alias("n_types"), F.countDistinct("topic").alias("n_topics"), F.count_if(F.col("type") == "inbox").alias("n_inbox"))


def orientation(entries: DataFrame, as_of: Column, themes: int = 3) -> DataFrame:
    """The last week's most frequent topics with their entries."""
    recent = entries.filter(F.col("ts") >= F.date_sub(F.to_date(as_of), 7))
    return recent.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "topic").limit(themes)


def highlights(entries: DataFrame, most: int = 5) -> DataFrame:
    """Most significant entries by words, links and importance."""
    score = F.round(F.col("words") / 100 + 2 * F.col("n_links") + F.col("importance"), 4)
    return entries.withColumn("score", score).orderBy(F.desc("score"), "entry_id").limit(most)


def compared(entries: DataFrame, period: str = "week") -> DataFrame:
    """Entries of each period with the change and its direction from the one before."""
    counts = entries.groupBy(F.date_format(F.date_trunc(period, "ts"), "yyyy-MM-dd").alias("period"), "tenant").agg(F.count(F.lit(1)).alias("n"))
    change = F.col("n") - F.lag("n").over(Window.partitionBy("tenant").orderBy("period"))
    return counts.withColumn("change", change).withColumn("trend", F.when(F.col("change") > 0, "up").when(F.col("change") < 0, "down").when(F.col("change") == 0, "flat"))


def latest_trend(compared_rows: DataFrame) -> DataFrame:
    """Each tenant's last period with its direction."""
    w = Window.partitionBy("tenant").orderBy(F.desc("period"))
    return compared_rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("tenant", "period", "n", F.coalesce("trend", F.lit("new")).alias("trend"))


def with_suffix(rows: DataFrame, entry_id: str = "entry_id", order: str = "seq") -> DataFrame:
    """Ids made distinct: the second of equal ids gets -1, and so on."""
    n = F.row_number().over(Window.partitionBy(entry_id).orderBy(order)) - 1
    return rows.withColumn("unique_id", F.when(n > 0, F.concat(entry_id, F.lit("-"), n)).otherwise(F.col(entry_id)))


def suggested_links(terms: DataFrame, titles: DataFrame, most: int = 3) -> DataFrame:
    """For each term, notes whose title holds it as a word, shortest first (J18): terms meet titles at the words of
    the titles, an equi join."""
    words = titles.select("title", F.explode(F.array_distinct(F.split(F.lower("title"), r"\W+"))).alias("word"))
    met = terms.select("term", F.lower("term").alias("word")).join(words, "word")
    w = Window.partitionBy("term").orderBy(F.length("title"), "title")
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("term", "title", "rank")


def labelled(entries: DataFrame, keywords: DataFrame, text: str = "content", neutral: str = "neutral") -> DataFrame:
    """The label whose keywords occur most often, `neutral` on ties and without any."""
    words = entries.select("entry_id", F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word"))
    counts = words.join(keywords, "word").groupBy("entry_id", "label").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("entry_id").agg(F.max("n").alias("top")).join(counts, "entry_id").filter("n = top").groupBy("entry_id").agg(F.when(F.count(F.lit(1)) == 1, F.min("label")).otherwise(neutral).alias("label"))
    return entries.join(best, "entry_id", "left").withColumn("label", F.coalesce("label", F.lit(neutral)))


def entry_path(ts: Column, slug: Column) -> Column:
    """YYYY/MM/<14-digit id>-<slug>.md."""
    return F.concat(F.date_format(ts, "yyyy/MM/yyyyMMddHHmmss"), F.lit("-"), slug, F.lit(".md"))


def summary_path(ts: Column, period: str) -> Column:
    """Path of a weekly, monthly, quarterly or yearly summary."""
    year = F.date_format(ts, "yyyy")
    return {
        "weekly": F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("/weekly-"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0")),
        "monthly": F.concat(year, F.lit("/monthly-"), F.date_format(ts, "MM")),
        "quarterly": F.concat(year, F.lit("/quarterly-Q"), F.quarter(ts).cast("string")),
        "yearly": F.concat(year, F.lit("/yearly")),
    }[period]


def templated(template: Column, ts: Column, project: Column) -> Column:
    """{YYYY}, {MM}, {DD} and {project} filled in."""
    out = template
    for mark, value in (("{YYYY}", F.date_format(ts, "yyyy")), ("{MM}", F.date_format(ts, "MM")), ("{DD}", F.date_format(ts, "dd")), ("{project}", project)):
        out = F.replace(out, F.lit(mark), value)
    return out
