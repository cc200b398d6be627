"""Namespaced ids: building and parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslake.functions.text import slug
from corpuslake.options import EPHEMERAL_PREFIXES


def tier(doc_id: Column) -> Column:
    return F.when(F.split_part(doc_id, F.lit("::"), F.lit(1)).isin(*EPHEMERAL_PREFIXES) & F.contains(doc_id, F.lit("::")), "ephemeral").otherwise("durable")


def parsed(doc_id: Column) -> Column:
    """struct(namespace, full_prefix, content_id, tier, chunk); a bare path is a vault document."""
    bare = ~F.contains(doc_id, F.lit("::"))
    full = F.when(bare, F.concat(F.lit("vault::"), doc_id)).otherwise(doc_id)
    chunk = F.regexp_extract(full, r"#chunk-(\d+)$", 1).try_cast("int")
    stem = F.regexp_replace(full, r"#chunk-\d+$", "")
    namespace = F.split_part(stem, F.lit("::"), F.lit(1))
    prefix = F.when(namespace == "memory", F.concat(F.substring_index(stem, "::", 2), F.lit("::"))).otherwise(F.concat(namespace, F.lit("::")))
    return F.struct(namespace.alias("namespace"), prefix.alias("full_prefix"), F.replace(stem, prefix, F.lit("")).alias("content_id"), tier(doc_id).alias("tier"), chunk.alias("chunk"))


def chunk_id(path: Column, chunk: Column) -> Column:
    return F.concat(F.lit("vault::"), path, F.coalesce(F.concat(F.lit("#chunk-"), chunk.cast("string")), F.lit("")))


def memory_id(scope: Column, project: Column, name: Column) -> Column:
    return F.concat(F.lit("memory::"), F.when(scope == "global", F.lit("global")).otherwise(slug(project)), F.lit("::"), slug(name))


def relationship_id(a: Column, b: Column) -> Column:
    return F.concat(F.lit("rel::"), F.array_join(F.array_sort(F.array(slug(a), slug(b))), "::"))


def stamped_id(prefix: str, ts: Column, content: Column) -> Column:
    """Time-based id; a content digest keeps rows of the same millisecond apart."""
    return F.concat(F.lit(prefix + "::"), F.unix_millis(ts).cast("string"), F.lit("-"), F.left(F.md5(content.cast("binary")), F.lit(8)))


def memory_path(scope: Column, project: Column, name: Column) -> Column:
    return F.concat_ws("/", F.when(scope == "global", F.lit("memories")).otherwise(F.concat(F.lit("projects/"), slug(project))), F.concat(slug(name), F.lit(".md")))
