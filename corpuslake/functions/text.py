"""Text expressions: slugs, previews, front matter, titles, escaping, token sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MD_BLOCK = r"(?s)\A---\s*\n(.*?)\n---\s*\n?"
ORG_BLOCK = r"(?s)\A:PROPERTIES:\s*\n(.*?)\n:END:\s*\n?"


def slug(c: Column) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^\w\s-]", ""), r"[\s_]+", "-")
    return F.regexp_replace(F.regexp_replace(dashed, "-+", "-"), "^-+|-+$", "")


def file_format(path: Column) -> Column:
    end = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return F.when(end == "org", "org").when(end.isin("md", "markdown"), "markdown")


def front_matter(content: Column, fmt: Column) -> Column:
    """Key/value block at the head of a document as a map; later lines win; list items join their key with commas."""
    md = F.regexp_extract(content, MD_BLOCK, 1)
    org = F.regexp_extract(content, ORG_BLOCK, 1)
    joined = F.regexp_replace(md, r"\n\s*-\s+", ",")
    md_rows = F.filter(F.split(joined, "\n"), lambda x: x.rlike(r"^\s*[A-Za-z_][\w-]*\s*:"))
    org_rows = F.filter(F.split(org, "\n"), lambda x: x.rlike(r"^\s*:[\w-]+:"))

    def md_pair(x):
        value = F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)), r"^,|^[\"'\[]|[\"'\]]$", "")
        return F.struct(F.trim(F.regexp_extract(x, r"^([^:]*):", 1)).alias("key"), F.regexp_replace(value, r"\s*,\s*", ",").alias("value"))

    def org_pair(x):
        return F.struct(F.lower(F.regexp_extract(x, r"^\s*:([\w-]+):", 1)).alias("key"), F.trim(F.regexp_extract(x, r"^\s*:[\w-]+:(.*)$", 1)).alias("value"))

    rows = F.when(fmt == "org", F.transform(org_rows, org_pair)).otherwise(F.transform(md_rows, md_pair))
    last = F.filter(rows, lambda x, i: ~F.exists(F.slice(rows, i + 2, F.greatest(F.size(rows), F.lit(1))), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def strip_front_matter(content: Column, fmt: Column) -> Column:
    return F.when(fmt == "org", F.regexp_replace(content, ORG_BLOCK, "")).otherwise(F.regexp_replace(content, MD_BLOCK, ""))


def front_matter_block(entries: Column) -> Column:
    """A map as a front matter block, keys sorted."""
    rows = F.transform(F.array_sort(F.map_entries(entries)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    return F.concat(F.lit("---\n"), F.array_join(rows, "\n"), F.lit("\n---\n"))


def title(content: Column, path: Column, fmt: Column) -> Column:
    """First heading (or org title), else the file's name in title case."""
    md = F.nullif(F.trim(F.regexp_extract(content, r"(?m)^#\s+(\S.*)$", 1)), F.lit(""))
    org = F.coalesce(F.nullif(F.trim(F.regexp_extract(content, r"(?mi)^#\+TITLE:\s*(\S.*)$", 1)), F.lit("")), F.nullif(F.trim(F.regexp_extract(content, r"(?m)^\*\s+(\S.*)$", 1)), F.lit("")))
    name = F.initcap(F.regexp_replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z]+$", ""), "[-_]+", " "))
    return F.coalesce(F.when(fmt == "org", org).otherwise(md), name)


def truncated(c: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(F.length(c) > n, F.concat(F.left(c, n), F.lit("..."))).otherwise(c)


def preview(content: Column, fmt: Column, most: int = 150) -> Column:
    """Without block and first heading, in single spaces, cut at a word end in the second half."""
    body = F.regexp_replace(strip_front_matter(content, fmt), r"\A\s*(?:#{1,6}|\*+)\s+[^\n]*\n?", "")
    flat = F.trim(F.regexp_replace(body, r"\s+", " "))
    head = F.left(flat, F.lit(most))
    space = F.lit(most) - F.locate(" ", F.reverse(head)) + 1
    cut = F.when((F.locate(" ", F.reverse(head)) > 0) & (space - 1 > most // 2), F.left(head, space - 1)).otherwise(head)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(cut, F.lit("...")))


def xml_escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def token_set(c: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(c), r"\s+"), ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def links(content: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(content, F.lit(r"\[\[([^\]|]+)"), 1))
