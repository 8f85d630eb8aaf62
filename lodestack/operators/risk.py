"""Risk rules, features and hints, audit events and alerts, histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.text import redact, truncate_text
from lodestack.operators.filters import class_ordinal, norm_classification
from lodestack.operators.govern import authority_rank

# Fixed values.
HIGH_RISK_WORDS = ("预算", "裁员", "薪酬", "工资", "招采", "采购合同", "收购", "名单", "身份证", "手机号", "密码", "导出全部", "完整名单", "编制调整")
MEDIUM_RISK_WORDS = ("审批", "人员", "报销", "预算", "制度", "采购")
BULK_EXPORT = ("导出全部", "完整名单", "全部名单", "原文全文", "全部预算明细", "所有人员信息")
HINT_PATTERNS = ("导出全部", "完整名单", "全部名单", "身份证号", "银行卡", "账号口令", "薪资明细")
SIMPLE_PATTERNS = ("导出全部", "完整名单", "身份证号", "银行卡", "restricted", "账号口令", "薪资明细")
LEVELS = ("low", "medium", "high")
FEATURES = {
    "past_24h_query_count": ("user_history", 0.0),
    "high_risk_ratio_7d": ("user_history", 0.0),
    "failed_auth_count_7d": ("user_history", 0.0),
    "session_query_count": ("session", 0.0),
    "session_duration_sec": ("session", 0.0),
    "query_interval_sec": ("session", 60.0),
    "top1_score": ("retrieval", 0.0),
    "top5_score_mean": ("retrieval", 0.0),
    "restricted_hit_ratio": ("retrieval", 0.0),
    "sensitive_hit_ratio": ("retrieval", 0.0),
    "authority_score_mean": ("retrieval", 0.0),
    "source_count": ("retrieval", 1.0),
}
REQUEST_FEATURES = tuple(FEATURES)[:6]


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(text.contains(w), F.lit(False)) for w in words])


def query_risk(text: Column) -> Column:
    return F.when(contains_any(text, HIGH_RISK_WORDS), "high").when(contains_any(text, MEDIUM_RISK_WORDS), "medium").otherwise("low")


def level_ordinal(level: Column) -> Column:
    """0..2; anything unknown is low."""
    return F.greatest(F.array_position(F.array(*map(F.lit, LEVELS)), F.lower(F.trim(F.coalesce(level, F.lit("low"))))) - 1, F.lit(0)).cast("int")


def merge_levels(*levels: Column) -> Column:
    top = F.greatest(*map(level_ordinal, levels)) if len(levels) > 1 else level_ordinal(levels[0])
    return F.element_at(F.array(*map(F.lit, LEVELS)), top + 1)


def risk_decision(q: DataFrame, enabled: bool = True) -> DataFrame:
    """risk_* columns of questions (question, data_classification, model_route, refusal_reason, conflict_detected)."""
    has = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in q.columns else F.lit(d)
    level = merge_levels(has("risk_level_hint", "low"), query_risk(F.col("question")))
    cls = norm_classification(has("data_classification", None).cast("string"))
    low = lambda c: F.lower(F.trim(has(c, "")))
    high = F.lit("high")

    def made(allow: bool, action: str, lv: Column, reason: str, local: bool = False, redacted: bool = False, alert: Column | bool = False, review: bool = False) -> Column:
        alert = alert if isinstance(alert, Column) else F.lit(alert)
        return F.struct(
            F.lit(allow).alias("risk_allow"), F.lit(action).alias("risk_action"), lv.alias("risk_level"), F.lit(reason).alias("risk_reason"), F.lit(local).alias("risk_force_local_only"),
            F.lit(redacted).alias("risk_require_redaction"), alert.alias("risk_require_alert"), F.lit(review).alias("risk_require_review"),
        )

    if not enabled:
        chosen = made(True, "allow", level, "risk_engine_disabled")
    else:
        chosen = (
            F.when(contains_any(F.col("question"), BULK_EXPORT), made(False, "deny", high, "bulk_sensitive_export_request", alert=True, review=True))
            .when(low("refusal_reason") == "access_denied", made(False, "deny", high, "access_denied", alert=True))
            .when((cls == "restricted") | (low("model_route") == "local_only"), made(True, "local_only", high, "restricted_data_local_only", local=True, alert=True))
            .when(cls == "sensitive", made(True, "minimize", high, "sensitive_context_minimized", redacted=True, alert=level == "high"))
            .when(cls == "internal", made(True, "redact", level, "internal_context_redacted", redacted=True, alert=level == "high"))
            .otherwise(made(True, "allow", level, "allow", alert=has("conflict_detected", False)))
        )
    return q.withColumn("_r", chosen).select("*", "_r.*").drop("_r")


def fail_open(decided: DataFrame, allow: bool = True) -> DataFrame:
    """Rows whose decision is null get an allow (or deny) instead, with reason risk_engine_error."""
    missing = F.col("risk_action").isNull()
    return decided.withColumns({"risk_allow": F.when(missing, allow).otherwise(F.col("risk_allow")), "risk_reason": F.when(missing, "risk_engine_error").otherwise(F.col("risk_reason")), "risk_action": F.when(missing, "allow" if allow else "deny").otherwise(F.col("risk_action"))})


def risk_features(q: DataFrame) -> DataFrame:
    """Request features from map columns ``flat`` (name -> text) and ``nested`` (group -> name -> text), with defaults."""
    made = {}
    for name in REQUEST_FEATURES:
        group, default = FEATURES[name]
        inner = F.try_element_at(F.try_element_at(F.col("nested"), F.lit(group)), F.lit(name))
        made[name] = F.coalesce(F.try_element_at(F.col("flat"), F.lit(name)).try_cast("double"), inner.try_cast("double"), F.lit(default))
    return q.withColumns(made | {name: F.lit(default) for name, (_, default) in FEATURES.items() if name not in made})


def risk_hint(q: DataFrame) -> DataFrame:
    """risk_level_hint, hint_confidence and hint_signals from the question and the request features."""
    c = F.col
    strong = [("text_pattern", contains_any(c("question"), HINT_PATTERNS)), ("failed_auth_spike", c("failed_auth_count_7d") >= 3), ("high_risk_history_ratio", c("high_risk_ratio_7d") >= 0.40), ("query_volume_spike", c("past_24h_query_count") >= 30), ("burst_session_pattern", (c("session_query_count") >= 8) & (c("query_interval_sec") <= 10))]
    medium = [("elevated_history_ratio", c("high_risk_ratio_7d") >= 0.15), ("elevated_query_volume", c("past_24h_query_count") >= 12), ("elevated_session_depth", c("session_query_count") >= 5), ("short_query_interval", c("query_interval_sec") <= 20)]
    listed = lambda xs: F.array_compact(F.array(*[F.when(t, name) for name, t in xs]))
    s, m = listed(strong), listed(medium)
    return q.withColumns(
        {
            "risk_level_hint": F.when(F.size(s) > 0, "high").when(F.size(m) > 0, "medium").otherwise("low"),
            "hint_confidence": F.when(F.size(s) > 0, 0.88).when(F.size(m) > 0, 0.67).otherwise(0.56),
            "hint_signals": F.when(F.size(s) > 0, s).otherwise(m),
        }
    )


def simple_risk_rules(q: DataFrame) -> DataFrame:
    """rule_allow, rule_action, rule_level, rule_reason of questions with the numeric features."""
    c = F.col
    row = lambda allow, action, level, reason: F.struct(F.lit(allow).alias("rule_allow"), F.lit(action).alias("rule_action"), F.lit(level).alias("rule_level"), F.lit(reason).alias("rule_reason"))
    chosen = (
        F.when(contains_any(c("question"), SIMPLE_PATTERNS), row(False, "deny", "high", "matched_explicit_high_risk_pattern"))
        .when((c("restricted_hit_ratio") >= 0.4) | (c("failed_auth_count_7d") >= 3), row(True, "review", "high", "restricted_retrieval_or_failed_auth_spike"))
        .when((c("sensitive_hit_ratio") >= 0.2) | (c("high_risk_ratio_7d") >= 0.25), row(True, "review", "medium", "sensitive_hit_ratio_or_history_risk_elevated"))
        .otherwise(row(True, "allow", "low", "no_explicit_rule_hit"))
    )
    return q.withColumn("_r", chosen).select("*", "_r.*").drop("_r")


def hybrid_risk(ruled: DataFrame, hint: Column) -> DataFrame:
    """Rules and a hint column together: deny wins, the higher level wins, an allow at high becomes review."""
    final = merge_levels(F.col("rule_level"), hint)
    action = F.when(F.col("rule_allow") & (F.col("rule_action") == "allow") & (final == "high"), "review").otherwise(F.col("rule_action"))
    return ruled.withColumns({"final_level": final, "final_action": action, "final_allow": F.col("rule_allow")})


def numeric_features(samples: DataFrame) -> DataFrame:
    """The twelve features of nested samples (user_history, session, retrieval), in their fixed order."""
    return samples.withColumns({name: F.coalesce(F.col(group)[name].cast("double"), F.lit(default)) for name, (group, default) in FEATURES.items()})


def fit_stats(features: DataFrame, names: tuple[str, ...] = tuple(FEATURES)) -> DataFrame:
    """(feature, mean, std) with the population deviation, 1 where it is tiny; one aggregation over all names."""
    row = features.agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names])
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"m_{n}").alias("mean"), F.when(F.col(f"s_{n}") > 1e-6, F.col(f"s_{n}")).otherwise(1.0).alias("std")) for n in names])
    return row.select(F.explode(pairs).alias("r")).select("r.*")


def standardize(features: DataFrame, stats: DataFrame) -> DataFrame:
    """Each feature less its mean over its deviation; the statistics are one row a feature and travel as a broadcast row."""
    names = [n for n in FEATURES if n in features.columns]
    wide = stats.agg(*[F.max(F.when(F.col("feature") == n, F.struct("mean", "std"))).alias(f"_{n}") for n in names])
    out = features.crossJoin(F.broadcast(wide))  # one row
    return out.withColumns({n: (F.col(n) - F.col(f"_{n}")["mean"]) / F.col(f"_{n}")["std"] for n in names}).drop(*[f"_{n}" for n in names])


def label_metrics(predictions: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Per class precision, recall and support, with the accuracy over all rows."""
    right = F.col(label) == F.col(pred)
    both = F.array(F.struct(F.col(label).alias("cls"), F.lit(1).alias("is_label"), F.lit(0).alias("is_pred"), right.cast("int").alias("hit")), F.struct(F.col(pred).alias("cls"), F.lit(0).alias("is_label"), F.lit(1).alias("is_pred"), F.lit(0).alias("hit")))
    per = predictions.select(F.explode(both).alias("r")).select("r.*").groupBy("cls").agg(F.sum("is_label").alias("support"), F.sum("is_pred").alias("predicted"), F.sum("hit").alias("hits"))
    total = predictions.agg(F.avg(right.cast("double")).alias("accuracy"))
    ratio = lambda d: F.when(F.col(d) > 0, F.col("hits") / F.col(d)).otherwise(0.0)
    return per.crossJoin(F.broadcast(total)).select("cls", "support", ratio("predicted").alias("precision"), ratio("support").alias("recall"), "accuracy")


def _preview(text: Column, chars: int, masked: bool) -> Column:
    return truncate_text(redact(text) if masked else text, chars)


def audit_events(a: DataFrame, stage: str = "response", preview_chars: int = 240, masked: bool = True) -> DataFrame:
    """Flat audit events of answer rows: hashes, previews, id lists; columns a row lacks are null."""
    has = lambda c, kind="string": F.col(c) if c in a.columns else F.lit(None).cast(kind)
    flag = lambda c: F.coalesce(has(c, "boolean"), F.lit(False))
    question = F.coalesce(has("question"), F.lit(""))
    hashed = lambda c: F.when(F.coalesce(has(c), F.lit("")) != "", F.sha2(has(c), 256))
    shown = lambda c: F.when(F.coalesce(has(c), F.lit("")) != "", _preview(has(c), preview_chars, masked))
    plain = ("trace_id", "audit_id", "risk_action", "risk_reason", "user_id", "department", "role", "data_classification", "model_route", "refusal_reason", "conflict_summary")
    return a.select(
        F.lit(stage).alias("event_type"), *[has(c).cast("string").alias(c) for c in plain], F.coalesce(has("risk_level"), query_risk(question)).alias("risk_level"), flag("risk_require_alert").alias("risk_require_alert"),
        F.sha2(question, 256).alias("question_hash"), _preview(question, preview_chars, masked).alias("question_preview"),
        F.coalesce(has("project_ids", "array<string>"), F.array().cast("array<string>")).alias("project_ids"), flag("refusal").alias("refusal"), flag("conflict_detected").alias("conflict_detected"),
        F.coalesce(has("retrieved_chunk_ids", "array<string>"), F.array().cast("array<string>")).alias("retrieved_chunk_ids"), F.coalesce(has("retrieved_doc_ids", "array<string>"), F.array().cast("array<string>")).alias("retrieved_doc_ids"),
        hashed("prompt").alias("prompt_hash"), shown("prompt").alias("prompt_preview"), hashed("output").alias("output_hash"), shown("output").alias("output_preview"),
    )


def needs_alert(a: DataFrame) -> Column:
    has = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in a.columns else F.lit(d)
    low = lambda c: F.lower(F.trim(has(c, "")))
    level = query_risk(has("question", ""))
    return has("risk_require_alert", False) | (level == "high") | (low("data_classification") == "restricted") | low("refusal_reason").isin("access_denied", "restricted_data_local_only") | has("conflict_detected", False)


def alert_events(a: DataFrame) -> DataFrame:
    rows = a.filter(needs_alert(a))
    return audit_events(rows.withColumn("risk_level", query_risk(F.coalesce("question", F.lit("")))), "security_alert")


def bucket_histogram(df: DataFrame, column: str, bounds: list[float]) -> DataFrame:
    """(bound, n, cumulative) for fixed upper bounds and one beyond them (null)."""
    slot = F.lit(len(bounds))
    for i, b in reversed(list(enumerate(bounds))):
        slot = F.when(F.col(column) <= b, i).otherwise(slot)
    counts = df.filter(F.col(column).isNotNull()).groupBy(slot.cast("int").alias("slot")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("slot"))
    full = every.join(counts, "slot", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    upto = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)  # one row a bound
    named = F.try_element_at(F.array(*[F.lit(float(b)) for b in bounds]), F.col("slot") + 1)
    return full.select("slot", named.alias("bound"), "n", F.sum("n").over(upto).alias("cumulative"))


def retrieval_risk_features(hits: DataFrame) -> DataFrame:
    """Per question: top1_score, top5_score_mean, restricted and sensitive shares, authority mean, source count."""
    level = class_ordinal(F.col("data_classification"))
    return hits.groupBy("query_id").agg(
        F.max("score").alias("top1_score"),
        F.round(F.avg(F.when(F.col("rank") <= 5, F.col("score"))), 6).alias("top5_score_mean"),
        F.round(F.avg((level == 3).cast("double")), 6).alias("restricted_hit_ratio"),
        F.round(F.avg((level == 2).cast("double")), 6).alias("sensitive_hit_ratio"),
        F.round(F.avg(authority_rank(F.col("authority_level")) / 3.0), 6).alias("authority_score_mean"),
        F.countDistinct("source").cast("double").alias("source_count"),
    )
