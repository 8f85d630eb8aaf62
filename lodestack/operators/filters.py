"""Metadata filters and row-level access as predicates and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Synonym groups, ordered classes and access lists.
SYNONYMS = {"department_scope": ("department", "owner_department"), "site_scope": ("plant", "applicable_site")}
CLASS_ORDER = {"public": 0, "internal": 1, "sensitive": 2, "restricted": 3}
DEFAULT_CLASS = "internal"
ACCESS_LISTS = {"allowed_users": "user_id", "allowed_departments": "department", "allowed_roles": "role"}
LOCAL_ONLY = ("restricted",)


def _norm(value: object) -> str:
    return str(value).strip().casefold()


def filter_groups(filters: dict) -> list[tuple[tuple[str, ...], list]]:
    """(fields, values) per group: synonyms share one, every other key is its own; empty groups are left out."""
    as_list = lambda v: list(v) if isinstance(v, (list, tuple, set)) else [v]
    grouped, used = [], set()
    for fields in SYNONYMS.values():
        values = [v for f in fields if f in filters for v in as_list(filters[f])]
        used.update(f for f in fields if f in filters)
        if values:
            grouped.append((fields, list(dict.fromkeys(values))))
    return grouped + [((k,), as_list(v)) for k, v in filters.items() if k not in used]


def _is_in(column: str, kind: str, values: list[str]) -> Column:
    if kind.startswith("array"):
        return F.exists(F.col(column), lambda x: F.lower(F.trim(x)).isin(values))
    return F.lower(F.trim(F.col(column).cast("string"))).isin(values)


def filter_chunks(chunks: DataFrame, filters: dict | None, text_fallback: bool = False) -> DataFrame:
    """Rows that match every group: any of its fields holds any of its values, case-folded; lists match by element.

    With ``text_fallback`` a value also matches as a part of the row's flattened metadata.
    """
    kinds = dict(chunks.dtypes)
    metadata = F.lower(F.to_json(F.struct(*[c for c in chunks.columns if c != "content"])))
    for fields, values in filter_groups(filters or {}):
        wanted = [v for v in map(_norm, values) if v]
        tests = [_is_in(f, kinds[f], wanted) for f in fields if f in kinds and wanted]
        if text_fallback:
            tests += [metadata.contains(v) for v in wanted]
        chunks = chunks.filter(F.coalesce(reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), tests, F.lit(False)), F.lit(False)))
    return chunks


def pushable_predicate(filters: dict | None, columns: list[str]) -> Column:
    """What the scan itself can test: children only, plain equality over promoted columns, ``page`` as a number."""
    clauses = [F.col("chunk_level") == "child"]
    for fields, values in filter_groups(filters or {}):
        direct = [f for f in fields if f in columns]
        wanted = [str(v).strip() for v in values if str(v).strip()]
        if direct and wanted:
            tests = [F.col(f).isin([int(float(v)) for v in wanted]) if f == "page" else F.col(f).isin(wanted) for f in direct]
            clauses.append(reduce(lambda a, b: a | b, tests))
    return reduce(lambda a, b: a & b, clauses)


def merge_filters(explicit: Column, intent: Column, access: Column) -> Column:
    """Maps of key -> values: explicit keys override intent's, access values are added; empty entries go."""
    clean = lambda m: F.map_filter(F.coalesce(m, F.create_map().cast("map<string,array<string>>")), lambda k, v: v.isNotNull() & (F.size(v) > 0))
    explicit, intent, access = clean(explicit), clean(intent), clean(access)
    base = F.map_zip_with(explicit, intent, lambda k, a, b: F.coalesce(a, b))
    none = F.array().cast("array<string>")
    return F.map_zip_with(base, access, lambda k, a, b: F.array_union(F.coalesce(a, none), F.coalesce(b, none)))


def match_filters(rows: DataFrame, filters: DataFrame, fields: list[str]) -> DataFrame:
    """Rows (query_id, chunk columns) that satisfy their query's filters, given as (query_id, field, value).

    Each group of a query that matches nothing in a row removes it; queries without filters keep all rows. The groups of a
    query travel as one small map, so a row meets its query's filters in one join.
    """
    group = F.col("field")
    for name, members in SYNONYMS.items():
        group = F.when(F.col("field").isin(*members), name).otherwise(group)
    wanted = filters.filter("value is not null").withColumn("g", group).groupBy("query_id", "g").agg(F.collect_set(F.lower(F.trim("value"))).alias("v"))
    wanted = wanted.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("g", "v"))).alias("_filters"))
    members = {f: [f] for f in fields if not any(f in m for m in SYNONYMS.values())} | {k: [f for f in m if f in fields] for k, m in SYNONYMS.items()}
    joined = rows.join(wanted, "query_id", "left")
    no = F.lit(False)
    held = {g: reduce(lambda a, b: a | b, [F.coalesce(F.array_contains(F.try_element_at(F.col("_filters"), F.lit(g)), F.lower(F.trim(F.col(f).cast("string")))), no) for f in m], no) for g, m in members.items()}
    matched = F.array_compact(F.array(*[F.when(t, g) for g, t in held.items()])) if held else F.array().cast("array<string>")
    missing = F.size(F.array_except(F.map_keys("_filters"), matched))
    return joined.filter(F.col("_filters").isNull() | (missing == 0)).drop("_filters")


def class_ordinal(value: Column, default: str = DEFAULT_CLASS) -> Column:
    known = F.create_map(*[F.lit(x) for pair in CLASS_ORDER.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(value))), F.lit(CLASS_ORDER[default]))


def class_name(ordinal: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in CLASS_ORDER]), ordinal + 1)


def norm_classification(value: Column, default: str = DEFAULT_CLASS) -> Column:
    return class_name(class_ordinal(value, default))


def access_filters(queries: DataFrame) -> DataFrame:
    """Per question the access values as a map of list name -> values, and the normal clearance."""
    one = lambda c: F.when(F.trim(F.col(c)) != "", F.array(F.trim(F.col(c))))
    pairs = [F.struct(F.lit(name).alias("k"), one(user).alias("v")) for name, user in ACCESS_LISTS.items()]
    pairs.append(F.struct(F.lit("project_ids").alias("k"), F.col("project_ids").alias("v")))
    kept = F.filter(F.array(*pairs), lambda p: p["v"].isNotNull() & (F.size(p["v"]) > 0))
    return queries.withColumn("access", F.map_from_entries(kept)).withColumn("clearance_level", norm_classification(F.col("clearance_level")))


def accessible(strict: bool = True, check_class: bool = True) -> Column:
    """Predicate over a hit's columns and its question's ``user_id, department, role, project_ids, clearance_level``.

    The question's columns carry the prefix ``q_``.
    """
    level = class_ordinal(F.col("data_classification"))
    open_ = F.lit(True) if not check_class else class_ordinal(F.col("q_clearance_level")) >= level
    filled = lambda c: F.coalesce(F.size(F.col(c)) > 0, F.lit(False))
    names = [*ACCESS_LISTS, "project_ids"]
    any_list = reduce(lambda a, b: a | b, [filled(c) for c in names])
    if strict:
        open_ = open_ & ~((level >= CLASS_ORDER["sensitive"]) & ~any_list)
    for name, user in ACCESS_LISTS.items():
        open_ = open_ & (~filled(name) | F.coalesce(F.array_contains(F.col(name), F.trim(F.col(f"q_{user}"))), F.lit(False)))
    return open_ & (~filled("project_ids") | F.coalesce(F.arrays_overlap("project_ids", "q_project_ids"), F.lit(False)))


def apply_acl(hits: DataFrame, queries: DataFrame, strict: bool = True) -> DataFrame:
    """Hits that their question's user may read, with audit columns acl_checked and acl_classification."""
    users = queries.select("query_id", *[F.col(c).alias(f"q_{c}") for c in ("user_id", "department", "role", "project_ids", "clearance_level")])
    kept = hits.join(users, "query_id").filter(accessible(strict)).drop(*[c for c in users.columns if c != "query_id"])
    return kept.withColumns({"acl_checked": F.lit(True), "acl_classification": norm_classification(F.col("data_classification"))})


def max_classification(hits: DataFrame, default: str = DEFAULT_CLASS) -> DataFrame:
    """Per question the highest class of its hits, never under the default."""
    top = F.max(F.greatest(class_ordinal(F.col("data_classification"), default), F.lit(CLASS_ORDER[default])))
    return hits.groupBy("query_id").agg(top.alias("level")).select("query_id", class_name(F.col("level")).alias("data_classification"))


def model_route(classification: Column, allow_external: Column, enabled: bool = True, external_sensitive: bool = False) -> Column:
    if not enabled:
        return F.lit("default")
    level = norm_classification(classification)
    sensitive = F.when(F.coalesce(allow_external, F.lit(False)) | F.lit(external_sensitive), "external_allowed").otherwise("local_preferred")
    local = F.coalesce(~allow_external, F.lit(False)) | level.isin(*LOCAL_ONLY)
    return F.when(local, "local_only").when(level == "sensitive", sensitive).otherwise("external_allowed")


def access_denied(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """Per question: there were hits, and none survived the access rules."""
    a = raw.groupBy("query_id").agg(F.count("*").alias("raw_hits"))
    b = kept.groupBy("query_id").agg(F.count("*").alias("kept_hits"))
    both = a.join(b, "query_id", "full_outer")
    n, k = F.coalesce("raw_hits", F.lit(0)), F.coalesce("kept_hits", F.lit(0))
    return both.select("query_id", n.alias("raw_hits"), k.alias("kept_hits"), ((n > 0) & (k == 0)).alias("access_denied"))
