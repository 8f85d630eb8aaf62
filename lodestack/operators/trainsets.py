"""Training-set builders and their quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.text import fold_ws


#: The assistant's text of refusal rows that have no answer of their own.
REFUSED = "这条问题没有可用的依据，因此不作回答。"


#: Heads of a training row's parts; rows that hold the first one count as grounded.
EVIDENCE_HEAD, TEXT_MARK, NOTICE_MARK, QUESTION_MARK = "Evidence found:", "[text ", "Note: ", "Asked: "

def _none() -> Column:
    return F.array().cast("array<string>")


def folded(texts: Column) -> Column:
    """Folded non-empty texts, repeats dropped, order kept."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(texts, _none()), fold_ws), lambda t: F.coalesce(t, F.lit("")) != ""))


def reference_join(report: DataFrame, dataset: DataFrame, order: str = "row_no") -> DataFrame:
    """Report rows with the last dataset row of the same folded question (ref_* columns)."""
    ref = dataset.withColumn("_k", fold_ws(F.col("question"))).filter("_k <> ''")
    last = Window.partitionBy("_k").orderBy(F.desc(order))
    ref = ref.withColumn("_n", F.row_number().over(last)).filter("_n = 1")
    ref = ref.select("_k", *[F.col(c).alias(f"ref_{c}") for c in ("ground_truth", "contexts", "scenario", "tags") if c in dataset.columns])
    return report.withColumn("_k", fold_ws(F.col("question"))).join(ref, "_k", "left").drop("_k")


def usable_rows(report: DataFrame) -> DataFrame:
    """Rows with a question, without an expected or actual refusal."""
    have = set(report.columns)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in have else F.lit(False)
    return report.filter((F.coalesce(fold_ws(F.col("question")), F.lit("")) != "") & ~flag("expected_refusal") & ~flag("refusal"))


def positives(rows: DataFrame) -> Column:
    """Reference contexts, then retrieved ones, each folded text once."""
    parts = [F.col(c) for c in ("ref_contexts", "contexts") if c in rows.columns]
    return folded(F.concat(*[F.coalesce(p, _none()) for p in parts]))


def seeded_number(seed: int, text: Column) -> Column:
    """A number of 60 bits from a seed and a text, by SHA-256, so that any engine can draw the same."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), text), 256), 1, 15), 16, 10).cast("long")


def negatives(rows: DataFrame, pool: DataFrame, n: int = 3, seed: int = 42) -> DataFrame:
    """``rows`` (row_id, question, contexts, positives) with ``negatives``: retrieved non-positives first, then pool texts.

    Every row may take any pool text. Ordering the whole pool for each row would be a cross join, so the pool is ordered once
    by a seeded hash and cut in numbered slots; a row starts at a slot of its own hash and looks at as many texts as it could
    need: n plus its own positives and retrieved texts.
    """
    texts = pool.select(fold_ws(F.col("text")).alias("text")).filter("text <> ''").distinct()
    count = max(1, texts.count())
    bucketed = texts.withColumn("h", seeded_number(seed, F.col("text")))
    # numbers by (bucket offset + place in bucket): no single task sorts the pool
    bucketed = bucketed.withColumn("b", F.pmod("h", F.lit(max(1, -(-count // 4096)))))
    sizes = bucketed.groupBy("b").agg(F.count("*").alias("size"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("b", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("b").orderBy("h", "text")) - 1
    numbered = bucketed.withColumn("place", place).join(offsets, "b").select((F.col("offset") + F.col("place")).alias("slot"), "text")
    own = F.array_except(folded(F.col("contexts")), F.col("positives"))
    base = rows.withColumn("_own", F.slice(own, 1, n))
    need = F.when(F.size("_own") < n, F.least(F.lit(count), F.lit(n) + F.size("positives") + F.size("_own"))).otherwise(0)
    start = F.pmod(seeded_number(seed, F.col("question")), F.lit(count))
    slots = base.filter(need > 0).select("row_id", F.posexplode(F.transform(F.sequence(F.lit(0), need - 1), lambda i: F.pmod(start + i, F.lit(count)))).alias("i", "slot"))
    drawn = slots.join(numbered, "slot").groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("_d"))
    out = base.join(drawn, "row_id", "left")
    extra = F.array_except(F.coalesce(F.transform("_d", lambda d: d["text"]), _none()), F.concat("positives", "_own"))
    return out.withColumn("negatives", F.slice(F.concat("_own", extra), 1, n)).drop("_own", "_d")


def build_triplets(report: DataFrame, dataset: DataFrame, n: int = 3, seed: int = 42, max_rows: int | None = None) -> DataFrame:
    """One row per positive: query, positive, negative, negatives, scenario, tags, source, by row_no and position."""
    rows = reference_join(usable_rows(report), dataset).withColumn("row_id", F.col("row_no"))
    rows = rows.withColumn("positives", positives(rows)).filter(F.size("positives") > 0)
    pool = dataset.select(F.explode("contexts").alias("text"))
    full = negatives(rows, pool, n, seed).filter(F.size("negatives") > 0)
    have = set(full.columns)
    text = lambda c: F.nullif(F.col(c), F.lit("")) if c in have else F.lit(None).cast("string")
    scenario = F.coalesce(text("scenario"), text("ref_scenario"), text("query_scene"), F.lit(""))
    tags = F.coalesce("ref_tags", _none()) if "ref_tags" in have else _none()
    out = full.select("row_id", fold_ws(F.col("question")).alias("query"), F.posexplode("positives").alias("positive_no", "positive"), F.col("negatives")[0].alias("negative"), F.slice("negatives", 2, max(1, n)).alias("negatives"), scenario.alias("scenario"), tags.alias("tags"), F.lit("eval_report").alias("source"))
    return out if max_rows is None else out.orderBy("row_id", "positive_no").limit(max_rows)


def build_sft(report: DataFrame, dataset: DataFrame, system_prompt: str, include_refusal: bool = True, include_conflict: bool = True) -> DataFrame:
    """Chat rows: system, user (evidence, governance notice, question) and assistant, with governance columns."""
    rows = reference_join(report, dataset)
    have = set(rows.columns)
    text = lambda c: F.coalesce(fold_ws(F.col(c)), F.lit("")) if c in have else F.lit("")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in have else F.lit(False)
    refusal, conflict = flag("refusal"), flag("conflict_detected")
    contexts = folded(F.col("contexts"))
    if "ref_contexts" in have:
        contexts = F.when(F.size(contexts) > 0, contexts).otherwise(folded(F.col("ref_contexts")))
    refused = F.when(text("refusal_reason") != "", F.concat(F.lit(f"{REFUSED} ("), text("refusal_reason"), F.lit(")"))).otherwise(REFUSED)
    answer = F.when(text("answer") != "", text("answer")).when(text("ref_ground_truth") != "", text("ref_ground_truth")).when(refusal, refused).otherwise("")
    lines = F.concat(F.array(F.lit(EVIDENCE_HEAD)), F.transform(contexts, lambda t, i: F.concat(F.lit(TEXT_MARK), (i + 1).cast("string"), F.lit("] "), t)), F.array(F.lit("")))
    notice = F.when(conflict & (text("conflict_summary") != ""), F.array(F.concat(F.lit(NOTICE_MARK), F.col("conflict_summary") if "conflict_summary" in have else F.lit("")), F.lit(""))).otherwise(_none())
    user = F.array_join(F.concat(F.when(F.size(contexts) > 0, lines).otherwise(_none()), notice, F.array(F.concat(F.lit(QUESTION_MARK), text("question")))), "\n")
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    kept = rows.filter((text("question") != "") & (answer != ""))
    if not include_refusal:
        kept = kept.filter(~refusal)
    if not include_conflict:
        kept = kept.filter(~conflict)
    tags = [F.col(c) for c in ("ref_tags", "tags") if c in have]
    return kept.select(
        F.array(message("system", F.lit(system_prompt)), message("user", user), message("assistant", answer)).alias("messages"), text("question").alias("question"),
        F.coalesce(F.nullif(text("scenario"), F.lit("")), text("ref_scenario")).alias("scenario"), F.coalesce(*tags, _none()).alias("tags"), F.lit("eval_report").alias("source"),
        refusal.alias("refusal"), text("refusal_reason").alias("refusal_reason"), conflict.alias("conflict_detected"), text("conflict_summary").alias("conflict_summary"),
        text("data_classification").alias("data_classification"), text("model_route").alias("model_route"), text("answer_mode").alias("answer_mode"),
    )


def all_negatives(triplets: DataFrame) -> Column:
    return F.filter(F.transform(F.concat(F.array("negative"), F.coalesce("negatives", _none())), fold_ws), lambda t: F.coalesce(t, F.lit("")) != "")


def pairwise(triplets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query, text, label) pairs, label 1 for the positive, and the rejected invalid rows."""
    rows = triplets.withColumns({"_q": F.coalesce(fold_ws(F.col("query")), F.lit("")), "_p": F.coalesce(fold_ws(F.col("positive")), F.lit("")), "_n": all_negatives(triplets)})
    ok = (F.col("_q") != "") & (F.col("_p") != "") & (F.size("_n") > 0)
    pair = lambda t, y: F.struct(t.alias("text"), F.lit(y).alias("label"))
    pairs = rows.filter(ok).select(F.col("_q").alias("query"), F.explode(F.concat(F.array(pair(F.col("_p"), 1)), F.transform("_n", lambda t: pair(t, 0)))).alias("r")).select("query", "r.*")
    return pairs, rows.filter(~ok).drop("_q", "_p", "_n")


def triplet_report(triplets: DataFrame) -> DataFrame:
    """One row: totals, invalid rows, positives among negatives, repeated triplets, distinct queries, length means."""
    r = triplets.select(F.coalesce(fold_ws(F.col("query")), F.lit("")).alias("q"), F.coalesce(fold_ws(F.col("positive")), F.lit("")).alias("p"), all_negatives(triplets).alias("n"), "scenario", "tags", "source")
    r = r.withColumn("ok", (F.col("q") != "") & (F.col("p") != "") & (F.size("n") > 0))
    key = F.when(F.col("ok"), F.sha2(F.concat_ws("\x01", "q", "p", F.array_join(F.array_sort(F.array_distinct("n")), "\x02")), 256))
    r = r.withColumn("key", key).withColumn("chars", F.aggregate("n", F.lit(0), lambda s, t: s + F.length(t)))
    on = lambda c: F.when(F.col("ok"), c)
    valid = F.count_if("ok")
    filled = lambda c: F.count_if(F.col("ok") & (F.coalesce(fold_ws(F.col(c)), F.lit("")) != ""))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 2)
    return r.agg(
        F.count("*").alias("total_rows"), valid.alias("valid_rows"), (F.count("*") - valid).alias("invalid_rows"), F.count_if(F.col("ok") & F.array_contains("n", F.col("p"))).alias("positive_is_negative_rows"),
        (valid - F.countDistinct("key")).alias("duplicate_triplet_rows"), F.countDistinct(on(F.col("q"))).alias("unique_queries"), zero(F.avg(on(F.length("q")))).alias("avg_query_chars"), zero(F.avg(on(F.length("p")))).alias("avg_positive_chars"),
        zero(F.sum(on(F.col("chars"))) / F.sum(on(F.size("n")))).alias("avg_negative_chars"), filled("scenario").alias("rows_with_scenario"), F.count_if(F.col("ok") & (F.size(F.coalesce("tags", _none())) > 0)).alias("rows_with_tags"), filled("source").alias("rows_with_source"),
    )


def triplet_tops(triplets: DataFrame, n: int = 10) -> DataFrame:
    """(kind, value, n, rank): most frequent queries, scenarios, sources, tags and numbers of negatives of valid rows."""
    e = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    rows = triplets.withColumn("_n", all_negatives(triplets)).filter((F.coalesce(fold_ws(F.col("query")), F.lit("")) != "") & (F.coalesce(fold_ws(F.col("positive")), F.lit("")) != "") & (F.size("_n") > 0))
    singles = F.array(e("query", fold_ws(F.col("query"))), e("scenario", fold_ws(F.col("scenario"))), e("source", fold_ws(F.col("source"))), e("negatives", F.size("_n").cast("string")))
    long = rows.select(F.explode(F.concat(singles, F.transform(F.coalesce("tags", _none()), lambda t: e("tag", fold_ws(t))))).alias("e")).select("e.*").filter("value is not null and value <> ''")
    counts = long.groupBy("kind", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "value"))).filter(F.col("rank") <= n)


def message_of(messages: Column, role: str) -> Column:
    return F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == role), lambda m: m["content"]), "\n")


def sft_report(sft: DataFrame) -> DataFrame:
    """One row: totals, invalid and repeated rows, ratios of grounded, refusal and conflict rows, length means."""
    r = sft.withColumns({"_u": fold_ws(message_of(F.col("messages"), "user")), "_a": fold_ws(message_of(F.col("messages"), "assistant"))})
    r = r.withColumn("ok", (F.col("_u") != "") & (F.col("_a") != ""))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    valid = F.count_if("ok")
    share = lambda t: F.round(F.coalesce(F.count_if(F.col("ok") & t) / F.nullif(valid, F.lit(0)), F.lit(0.0)), 4)
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(F.col("ok"), F.length(c))), F.lit(0.0)), 2)
    return r.agg(
        F.count("*").alias("total_rows"), valid.alias("valid_rows"), (valid - F.countDistinct(F.when(F.col("ok"), F.struct("_u", "_a")))).alias("duplicate_rows"), share(F.col("_u").contains(EVIDENCE_HEAD)).alias("grounded_ratio"),
        share(flag("refusal")).alias("refusal_ratio"), share(flag("conflict_detected")).alias("conflict_ratio"), mean("_u").alias("avg_user_chars"), mean("_a").alias("avg_assistant_chars"),
    )


def normalize_messages(rows: DataFrame) -> DataFrame:
    """``messages`` from either layout: kept when present, else built from instruction, input and output columns."""
    have = set(rows.columns)
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) if c in have else F.lit("")
    m = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    user = F.concat_ws("\n", F.nullif(text("instruction"), F.lit("")), F.nullif(text("input"), F.lit("")))
    built = F.filter(F.array(m("user", user), m("assistant", text("output"))), lambda x: x["content"] != "")
    if "messages" not in have:
        return rows.withColumn("messages", built)
    kept = F.filter(F.transform("messages", lambda x: F.struct(F.lower(F.trim(x["role"])).alias("role"), F.trim(x["content"]).alias("content"))), lambda x: F.coalesce(x["content"], F.lit("")) != "")
    return rows.withColumn("messages", F.when(F.size(F.coalesce(F.col("messages"), F.array().cast("array<struct<role:string,content:string>>"))) > 0, kept).otherwise(built))


def render_chat(messages: Column) -> Column:
    """Plain template text: one ``<|role|>`` block per message."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"])), "\n")
