"""Queries of the report family: events as entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.operators import reports
from corpuslake.plans.base import query, table


def _entries(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    tags = F.filter(F.array(F.when(F.col("event_id") % 2 == 0, "work"), F.when(F.col("event_id") % 3 == 0, "idea"), F.when(F.col("event_id") % 5 == 0, "home")), lambda x: x.isNotNull())
    return e.select(
        F.col("event_id").alias("entry_id"), "ts", F.col("event_type").alias("type"), F.concat(F.lit("t"), k).alias("topic"), tags.alias("tags"), (F.col("event_id") % 300).alias("words"), (F.col("event_id") % 4).alias("n_links"),
        (F.col("user_id") % 10).alias("tenant"), F.when(F.col("value") > 70, "positive").when(F.col("value") < 30, "negative").otherwise("neutral").alias("sentiment"), (F.col("event_id") % 10 / 10).alias("importance"),
    )


ENTRIES_SQL = """entries AS (SELECT event_id AS entry_id, ts, event_type AS type, 't' || json_extract_string(props, '$.k') AS topic, list_filter([CASE WHEN event_id % 2 = 0 THEN 'work' END, CASE WHEN event_id % 3 = 0 THEN 'idea' END, CASE WHEN event_id % 5 = 0 THEN 'home' END], lambda x: x IS NOT NULL) AS tags,
  event_id % 300 AS words, event_id % 4 AS n_links, user_id % 10 AS tenant, CASE WHEN value > 70 THEN 'positive' WHEN value < 30 THEN 'negative' ELSE 'neutral' END AS sentiment, event_id % 10 / 10 AS importance FROM events)"""
END = "2024-01-31 12:00:00"


def _end():
    return F.lit(END).cast("timestamp")


def _worklogs(spark, sf_dir):
    return _entries(spark, sf_dir).select("ts", F.concat(F.lit("w"), "tenant").alias("workstream"), F.col("type").alias("activity"))


@query("a9_worklog_report", f"WITH {ENTRIES_SQL} SELECT 'w' || tenant AS workstream, count(*) AS n, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day, count(*) FILTER (type = 'click') AS n_click FROM entries WHERE ts >= DATE '2024-01-24' GROUP BY tenant")
def worklog_report(spark, sf_dir):
    out = reports.worklog_report(_worklogs(spark, sf_dir), _end(), 7)
    return out.select("workstream", "n", F.date_format("first", "yyyy-MM-dd").alias("first_day"), F.date_format("last", "yyyy-MM-dd").alias("last_day"), F.coalesce(F.col("mix")["click"], F.lit(0)).alias("n_click"))


@query("a11_period_summary", f"WITH {ENTRIES_SQL}, f AS (SELECT 'all' AS facet, '' AS value, words FROM entries UNION ALL SELECT 'type', type, words FROM entries UNION ALL SELECT 'weekday', strftime(ts, '%a'), words FROM entries UNION ALL SELECT 'topic', topic, words FROM entries) SELECT facet, value, count(*) AS n, round(avg(words), 4) AS mean_words FROM f GROUP BY facet, value")
def period_summary(spark, sf_dir):
    return reports.period_summary(_entries(spark, sf_dir))


@query("a12_recurring_topics", f"WITH {ENTRIES_SQL} SELECT topic, count(*) AS n FROM entries GROUP BY topic HAVING count(*) >= 2")
def recurring_topics(spark, sf_dir):
    return reports.recurring(_entries(spark, sf_dir))


@query("a13_sentiment_by_week", f"WITH {ENTRIES_SQL} SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) FILTER (sentiment = 'negative') AS negative FROM entries GROUP BY 1")
def sentiment_by_week(spark, sf_dir):
    return reports.sentiment_by_week(_entries(spark, sf_dir))


@query("a14_context_split", f"WITH {ENTRIES_SQL}, c AS (SELECT CASE WHEN list_contains(tags, 'work') THEN 'work' ELSE 'personal' END AS context, count(*) AS n FROM entries GROUP BY 1) SELECT context, n, round(100 * n / (SELECT sum(n) FROM c), 2) AS percent FROM c")
def context_split(spark, sf_dir):
    return reports.context_split(_entries(spark, sf_dir))


@query("a15_tag_pairs", f"WITH {ENTRIES_SQL}, t AS (SELECT entry_id, unnest(tags) AS tag FROM entries) SELECT x.tag AS a, y.tag AS b, count(*) AS n FROM t x JOIN t y ON x.entry_id = y.entry_id AND x.tag < y.tag GROUP BY ALL")
def tag_pairs(spark, sf_dir):
    return reports.tag_pairs(_entries(spark, sf_dir))


@query("a16_link_density", f"WITH {ENTRIES_SQL} SELECT round(avg(n_links), 4) AS mean_links, count(*) FILTER (n_links = 0) AS n_unlinked, max(n_links) AS most_links FROM entries")
def link_density(spark, sf_dir):
    return reports.link_density(_entries(spark, sf_dir))


@query("a17_rhythm", f"WITH {ENTRIES_SQL} SELECT CAST(dayofweek(ts) + 1 AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM entries GROUP BY 1, 2")
def rhythm(spark, sf_dir):
    return reports.rhythm(_entries(spark, sf_dir))


@query("a17_busiest", f"WITH {ENTRIES_SQL}, d AS (SELECT CAST(dayofweek(ts) + 1 AS INTEGER) AS weekday, count(*) AS n FROM entries GROUP BY 1), h AS (SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM entries GROUP BY 1) SELECT (SELECT weekday FROM d ORDER BY n DESC, weekday LIMIT 1) AS weekday, (SELECT hour FROM h ORDER BY n DESC, hour LIMIT 1) AS hour")
def busiest(spark, sf_dir):
    return reports.busiest(_entries(spark, sf_dir))


@query("a18_types_by_week", f"WITH {ENTRIES_SQL} SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, type, count(*) AS n FROM entries GROUP BY 1, 2")
def types_by_week(spark, sf_dir):
    return reports.types_by_week(_entries(spark, sf_dir))


@query("a19_dropped_threads", f"WITH {ENTRIES_SQL}, s AS (SELECT type || (entry_id % 3000) AS topic, ts FROM entries) SELECT topic, count(*) AS n FROM s GROUP BY topic HAVING min(ts) >= DATE '2024-01-31' - 90 AND count(*) <= 2 AND max(ts) < DATE '2024-01-31' - 14")
def dropped_threads(spark, sf_dir):
    rows = _entries(spark, sf_dir).withColumn("topic", F.concat("type", F.col("entry_id") % 3000))
    return reports.dropped_threads(rows, _end()).select("topic", "n")


@query("a20_bursts", f"WITH {ENTRIES_SQL}, b AS (SELECT entry_id, count(*) OVER (PARTITION BY topic ORDER BY epoch_us(ts) RANGE BETWEEN 172800000000 PRECEDING AND CURRENT ROW) AS in_frame FROM (SELECT entry_id, ts, type || (entry_id % 100) AS topic FROM entries)) SELECT entry_id, in_frame FROM b WHERE in_frame >= 3")
def bursts(spark, sf_dir):
    rows = _entries(spark, sf_dir).withColumn("topic", F.concat("type", F.col("entry_id") % 100))
    return reports.bursts(rows, 3).select("entry_id", "in_frame")


@query("a21_context_switches", f"WITH {ENTRIES_SQL}, s AS (SELECT *, coalesce(CAST(lag(topic) OVER (PARTITION BY tenant, CAST(ts AS DATE) ORDER BY ts, entry_id) <> topic AS INTEGER), 0) AS s FROM entries) SELECT tenant, strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT topic) AS n_topics, CAST(sum(s) AS BIGINT) AS n_switches FROM s GROUP BY 1, 2")
def context_switches(spark, sf_dir):
    return reports.switches(_entries(spark, sf_dir))


def _goals(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("goal"), F.concat(F.lit("t"), F.col("n_nationkey") * 7).alias("topic"))


@query("j14_goal_alignment", f"WITH {ENTRIES_SQL}, g AS (SELECT n_name AS goal, 't' || (n_nationkey * 7) AS topic FROM nation), s AS (SELECT topic, count(*) AS n FROM entries GROUP BY topic) SELECT goal, coalesce(g.topic, s.topic) AS topic, coalesce(n, 0) AS n_entries, CASE WHEN goal IS NULL THEN 'no goal' WHEN n IS NULL THEN 'no entry' ELSE 'served' END AS status FROM g FULL JOIN s ON g.topic = s.topic")
def goal_alignment(spark, sf_dir):
    return reports.goal_alignment(_goals(spark, sf_dir), _entries(spark, sf_dir))


@query("a32_goal_free_activity", f"WITH {ENTRIES_SQL} SELECT topic, count(*) AS n_entries FROM entries WHERE topic NOT IN (SELECT 't' || (n_nationkey * 7) FROM nation) GROUP BY topic")
def goal_free_activity(spark, sf_dir):
    return reports.goal_alignment(_goals(spark, sf_dir), _entries(spark, sf_dir)).filter("status = 'no goal'").select("topic", "n_entries")


@query("a22_goal_status", f"WITH {ENTRIES_SQL}, g AS (SELECT n_name AS goal, 't' || (n_nationkey * 7) AS topic FROM nation), s AS (SELECT topic, count(*) FILTER (ts >= DATE '2024-01-24') AS w, count(*) FILTER (ts >= DATE '2024-01-01') AS m FROM entries GROUP BY topic) SELECT goal, CASE WHEN w >= 3 THEN 'green' WHEN w >= 1 THEN 'yellow' WHEN m >= 1 THEN 'red' ELSE 'white' END AS status FROM g LEFT JOIN s ON s.topic = g.topic")
def goal_status(spark, sf_dir):
    return reports.goal_status(_goals(spark, sf_dir), _entries(spark, sf_dir), _end())


@query("a23_catch_up", f"WITH {ENTRIES_SQL} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT type) AS n_types, count(DISTINCT topic) AS n_topics, CAST(0 AS BIGINT) AS n_inbox FROM entries WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1")
def catch_up(spark, sf_dir):
    return reports.catch_up(_entries(spark, sf_dir), F.lit("2024-01-20").cast("timestamp"))


@query("a24_orientation", f"WITH {ENTRIES_SQL} SELECT topic, count(*) AS n FROM entries WHERE ts >= DATE '2024-01-24' GROUP BY topic ORDER BY n DESC, topic LIMIT 3")
def orientation(spark, sf_dir):
    return reports.orientation(_entries(spark, sf_dir), _end())


@query("a31_highlights", f"WITH {ENTRIES_SQL} SELECT entry_id, CAST(round(words / 100 + 2 * n_links + importance, 4) AS DOUBLE) AS score FROM entries ORDER BY score DESC, entry_id LIMIT 5")
def highlights(spark, sf_dir):
    return reports.highlights(_entries(spark, sf_dir)).select("entry_id", "score")


@query("w8_period_comparison", f"WITH {ENTRIES_SQL}, c AS (SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS period, tenant, count(*) AS n FROM entries GROUP BY 1, 2), d AS (SELECT *, n - lag(n) OVER (PARTITION BY tenant ORDER BY period) AS change FROM c) SELECT period, tenant, n, change, CASE WHEN change > 0 THEN 'up' WHEN change < 0 THEN 'down' WHEN change = 0 THEN 'flat' END AS trend FROM d")
def period_comparison(spark, sf_dir):
    return reports.compared(_entries(spark, sf_dir))


@query("w9_trends", f"WITH {ENTRIES_SQL}, c AS (SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS period, tenant, count(*) AS n FROM entries GROUP BY 1, 2), d AS (SELECT *, n - lag(n) OVER (PARTITION BY tenant ORDER BY period) AS change, row_number() OVER (PARTITION BY tenant ORDER BY period DESC) AS rn FROM c) SELECT tenant, period, n, CASE WHEN change > 0 THEN 'up' WHEN change < 0 THEN 'down' WHEN change = 0 THEN 'flat' ELSE 'new' END AS trend FROM d WHERE rn = 1")
def trends(spark, sf_dir):
    return reports.latest_trend(reports.compared(_entries(spark, sf_dir)))


@query("w10_id_suffix", f"WITH x AS (SELECT event_id, CAST(user_id AS VARCHAR) AS entry_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events) SELECT event_id, entry_id || CASE WHEN n > 0 THEN '-' || n ELSE '' END AS unique_id FROM x")
def id_suffix(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("entry_id"))
    return reports.with_suffix(rows, "entry_id", "event_id").select("event_id", "unique_id")


@query("j18_suggested_links", r"WITH w AS (SELECT DISTINCT title, unnest(string_split_regex(lower(title), '\W+')) AS word FROM (SELECT p_name || ' ' || p_partkey AS title FROM part)), t AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS term FROM part), r AS (SELECT term, title, row_number() OVER (PARTITION BY term ORDER BY length(title), title) AS rank FROM t JOIN w ON lower(term) = word) SELECT term, title, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def suggested_links(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return reports.suggested_links(parts.select(F.element_at(F.split("p_name", " "), 1).alias("term")).distinct(), parts.select(F.concat("p_name", F.lit(" "), "p_partkey").alias("title")))


@query("x31_keyword_labels", r"WITH k(word, label) AS (VALUES ('the', 'positive'), ('of', 'negative'), ('und', 'negative'), ('que', 'positive')), c AS (SELECT doc_id, label, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS word FROM documents) w JOIN k ON k.word = w.word GROUP BY ALL), b AS (SELECT doc_id, max(n) AS top FROM c GROUP BY doc_id), l AS (SELECT c.doc_id, CASE WHEN count(*) = 1 THEN min(label) ELSE 'neutral' END AS label FROM c JOIN b ON b.doc_id = c.doc_id AND n = top GROUP BY c.doc_id) SELECT d.doc_id AS entry_id, coalesce(label, 'neutral') AS label FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id")
def keyword_labels(spark, sf_dir):
    words = (("the", "positive"), ("of", "negative"), ("und", "negative"), ("que", "positive"))
    keywords = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(w).alias("word"), F.lit(x).alias("label")) for w, x in words])).alias("k")).select("k.*")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), F.col("text").alias("content"))
    return reports.labelled(docs, keywords).select("entry_id", "label")


@query("x32_paths", "SELECT event_id, strftime(ts, '%Y/%m/%Y%m%d%H%M%S') || '-' || event_type || '.md' AS entry, strftime(ts, '%G') || '/weekly-' || strftime(ts, '%V') AS weekly, strftime(ts, '%Y/monthly-%m') AS monthly, strftime(ts, '%Y') || '/quarterly-Q' || quarter(ts) AS quarterly FROM events")
def paths(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", reports.entry_path(F.col("ts"), F.col("event_type")).alias("entry"), *[reports.summary_path(F.col("ts"), p).alias(p) for p in ("weekly", "monthly", "quarterly")])


@query("x33_path_templates", "SELECT event_id, 'p/' || event_type || '/' || strftime(ts, '%Y-%m/%d') AS path FROM events")
def path_templates(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", reports.templated(F.lit("p/{project}/{YYYY}-{MM}/{DD}"), F.col("ts"), F.col("event_type")).alias("path"))
