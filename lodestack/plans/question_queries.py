"""Driver queries of question understanding, clarification, plans, routes and prompt budgets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestack.operators import budget, filters, fuse, govern, search, understand
from lodestack.plans.queries import BM25, FOLD, KEYWORDS, bench_questions, doc_chunks, doc_index, query, table

#: What is put before the user turns, by (3 * conv_id + turn) % 12; the last but one stands alone.
SAID = (
    "", "今天谁值班 ", "请问报错怎么处理 ", "张三老师的电话 ", "白班和夜班的区别 ", "为什么版本1.2部署到生产 ", "那夜班呢 ", "3号线设备部门 检修流程 ", "ERR-1001 超时 ", "制度流程在哪 ", "这个", "“备件清单”以及维修 AB-12 ",
)
#: A vocabulary beside the default one: words of the invented languages, so that its rules are met.
VOCAB = """{"policy_keywords": ["制度", "quean"], "meeting_keywords": [" ouch "], "department_aliases": {"d-one": ["ndr", "eaux"], "d-two": ["est", ""]}, "site_aliases": {"north": ["ung"]}, "system_aliases": {},
 "business_domain_keywords": {"harbour": ["thth", "ique"]}, "blank": ["", "x"], "system_keywords": ["接口", "平台"]}"""


def said_turns(spark, sf_dir):
    """User turns with a phrase before them, and with the six messages before each, phrases included, as history."""
    c = table(spark, sf_dir, "conversations")
    k = (3 * F.col("conv_id") + F.col("turn")) % 12
    phrase = F.element_at(F.array(*map(F.lit, SAID)), (k + 1).cast("int"))
    said = F.when(k == 10, phrase).otherwise(F.concat(phrase, F.coalesce("text", F.lit(""))))
    c = c.withColumn("text", F.when(F.col("role") == "user", said).otherwise(F.col("text")))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-6, -1)
    h = c.withColumn("history", F.collect_list(F.struct("role", F.col("text").alias("content"))).over(before))
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return h.filter("role = 'user'").select(key.alias("query_id"), "conv_id", "turn", F.col("text").alias("question"), "history")


_PHRASES = "[" + ", ".join(f"'{x}'" for x in SAID) + "]"
_DEP = "(?:车间|部门|班组|小组|中心|事业部|工段|科室|仓库|产线|号线|线)"
_DEPARTMENT = f"[一-鿿A-Za-z0-9_-]{{2,30}}{_DEP}"
_TIME = r"(今天|明天|后天|昨天|本周|下周|本月|上月|本季度|今年|去年|\d{1,2}月\d{1,2}[日号]?|\d{1,2}[日号])"
_ENV = "(?i)(生产|测试|预发|本地|线上|线下|docker|k8s|kubernetes|macos|linux|windows)"
_DOC = r"[A-Za-z]{1,10}[-_/][A-Za-z0-9一-鿿\-_/]{2,32}"
_EQUIPMENT = "(?:锅炉|汽轮机|发电机|输煤皮带|磨煤机|风机|泵|压缩机|变压器|阀门|机组)"
_VERSION = r"(?i)(\b\d+\.\d+(\.\d+)?\b|版本|version)"
_ERROR = r"(?i)\b(ERR|ERROR|E)[-_]?\d+\b"
_PRECISE = r"""\b[A-Z][A-Z0-9._/-]{2,}\b|\b\d{3,}\b|`[^`]{2,40}`|“[^”]{2,40}”|"[^"]{2,40}\""""


def _has(pattern: str, text: str = "q") -> str:
    return f"regexp_matches({text}, '{pattern}')"


def _any(words: tuple[str, ...], case: str = "(?i)") -> str:
    return _has(f"{case}({'|'.join(words)})")


def _alias(names: dict[str, list[str]]) -> str:
    """The name with most aliases found, then the earliest, then the longest, then the last by name."""
    one = lambda name, words: f"{{'n': {' + '.join(f'contains(q, {chr(39)}{w}{chr(39)})::INT' for w in words)}, 'at': -least({', '.join(f'CASE WHEN contains(q, {chr(39)}{w}{chr(39)}) THEN strpos(q, {chr(39)}{w}{chr(39)}) ELSE 1000000 END' for w in words)}, 1000000), 'size': greatest({', '.join(f'CASE WHEN contains(q, {chr(39)}{w}{chr(39)}) THEN {len(w)} ELSE 0 END' for w in words)}, 0), 'name': '{name}'}}"
    return f"list_max(list_filter([{', '.join(one(k, v) for k, v in names.items())}], lambda x: x.n > 0)).name"


SIGNALS = f"""
u AS (SELECT conv_id, turn, conv_id || '-' || turn AS query_id, (3 * conv_id + turn) % 12 AS k, coalesce(text, '') AS t FROM conversations WHERE role = 'user'),
w AS (SELECT conv_id, turn, query_id, CASE WHEN k = 10 THEN '这个' ELSE ({_PHRASES})[k + 1] || t END AS raw FROM u),
q0 AS (SELECT *, {FOLD.format('raw')} AS q FROM w),
a AS (SELECT *, {_has(_ERROR)} AS err, {_has(_TIME)} AS tim, {_has('(?i)' + _DEPARTMENT)} AS dep0, {_alias({'d-one': ['ndr', 'eaux'], 'd-two': ['est']})} AS dep, {_alias({'north': ['ung']})} AS site,
  {_alias({'dispatch': ['调度', '值班', '排班', '交接班'], 'equipment_maintenance': ['巡检', '检修', '保养', '点检', '维修', '设备'], 'harbour': ['thth', 'ique'], 'it_ops': ['接口', '错误码', '数据库', '平台', '系统', '发布'], 'project_management': ['项目', '方案变更', '里程碑', '立项', '会议纪要']})} AS dom,
  {_has('([一-鿿]{2,4})(老师|同事|主管|经理|负责人)')} AS per, {_has(_ENV)} AS env, {_has(_VERSION)} AS ver, {_any(('白班', '夜班', '早班', '中班', '晚班'))} AS shf, {_has(_DOC)} AS num, {_has('((?:[一-鿿A-Za-z0-9_-]{0,30})?' + _EQUIPMENT + ')')} AS equ, {_any(('和', '与', 'vs', '对比', '比较', '区别', '差异'))} AS cmp FROM q0),
b AS (SELECT *, dep0 OR dep IS NOT NULL AS has_dep, err OR ver OR num OR {_has(_PRECISE)} OR dep0 AS pre, {_any(('谁', '哪位', '哪里', '在哪', '几点', '多少', '名单', '电话', '联系人', '值班', '排班', '班次', '部门', '负责人', '归属'))} OR (tim AND (dep0 OR dep IS NOT NULL OR per OR shf)) AS lookup,
  cmp OR {_has('(以及|并且|同时|分别|先.*再|不仅.*还|原因.*处理)')} AS hop FROM a),
c AS (SELECT *, {_has('^(?:那|那么|如果是|那如果|这个|那个|它|这条|这项|这类|这种|再|然后)')} OR (tim AND NOT has_dep AND {_has('(谁|值班|排班|安排|负责人|电话|在哪|哪里)')}) AS history,
  CASE WHEN {_any(('制度', 'quean'))} THEN 'policy_lookup' WHEN {_any(('SOP', '流程', '步骤', '作业指导书', '操作手册', '巡检', '检修', '应急预案'))} THEN 'procedure_lookup' WHEN {_any(('ouch',))} THEN 'meeting_trace' WHEN {_any(('项目', '方案变更', '里程碑', '立项', '需求'))} THEN 'project_trace'
    WHEN err THEN 'error_code_lookup' WHEN lookup THEN 'structured_fact_lookup' WHEN hop THEN 'comparison_analysis' ELSE 'general_lookup' END AS scene,
  hop OR {_any(('原因', '排查', '处理', '解决', '方案', '架构', '设计', '步骤', '流程', '以及', '并且', '影响', '区别', '对比'))} AS subs, {_any(('为什么', '原因', '原理', '方案', '架构', '设计', '最佳实践', '适用场景', '思路'))} AND NOT lookup AND NOT pre AS hyde, pre OR lookup OR {_has('[A-Za-z0-9._/-]{3,}')} AS boost FROM b),
s AS (SELECT *, CASE WHEN scene IN ('policy_lookup', 'error_code_lookup', 'structured_fact_lookup') THEN 'sparse' WHEN scene = 'meeting_trace' THEN 'dense' ELSE 'hybrid' END AS retriever,
  CASE WHEN scene IN ('policy_lookup', 'error_code_lookup', 'structured_fact_lookup') THEN 'precise' WHEN scene IN ('meeting_trace', 'project_trace', 'comparison_analysis') THEN 'broad' ELSE 'balanced' END AS profile,
  CASE scene WHEN 'policy_lookup' THEN 'policy' WHEN 'procedure_lookup' THEN 'procedure' WHEN 'meeting_trace' THEN 'meeting' END AS cat,
  CASE WHEN {_any(('接口', '平台'))} THEN coalesce(dom1, 'it_ops') ELSE dom1 END AS domain FROM (SELECT *, CASE WHEN dom IS NOT NULL AND (d0 IS NULL OR d0 = 'equipment_maintenance') THEN dom ELSE d0 END AS dom1
    FROM (SELECT *, CASE WHEN equ THEN CASE WHEN scene = 'project_trace' THEN 'project_management' ELSE coalesce(dom, 'equipment_maintenance') END WHEN scene = 'project_trace' THEN 'project_management' END AS d0 FROM c)))
"""


def signals(spark, sf_dir):
    return understand.strategy_signals(said_turns(spark, sf_dir), understand.load_vocab(VOCAB))


@query("vocabulary_signals", f"""
WITH {SIGNALS} SELECT query_id, err AS has_error_code, tim AS has_time_constraint, has_dep AS has_department_constraint, per AS has_person_constraint, env AS has_environment_constraint, ver AS has_version_constraint, shf AS has_shift_constraint, num AS has_doc_number,
  equ AS has_equipment_constraint, cmp AS is_comparison, pre AS has_precise_identifier, lookup AS likely_structured_lookup, hop AS is_multi_hop, history AS need_history_resolution, subs AS need_sub_queries, hyde AS need_hyde, boost AS need_keyword_boost, scene AS query_scene, retriever AS preferred_retriever, profile AS top_k_profile,
  concat_ws(';', 'business_domain=' || domain, 'department=' || dep, 'doc_category=' || cat, 'plant=' || site) AS intent FROM s""")
def vocabulary_signals(spark, sf_dir):
    """All signals under a vocabulary of its own, with what the intent map names."""
    s = signals(spark, sf_dir)
    named = [F.concat(F.lit(f"{k}="), F.try_element_at("metadata_intent", F.lit(k))) for k in ("business_domain", "department", "doc_category", "plant")]
    flags = ("has_error_code", "has_time_constraint", "has_department_constraint", "has_person_constraint", "has_environment_constraint", "has_version_constraint", "has_shift_constraint", "has_doc_number", "has_equipment_constraint")
    needs = ("is_comparison", "has_precise_identifier", "likely_structured_lookup", "is_multi_hop", "need_history_resolution", "need_sub_queries", "need_hyde", "need_keyword_boost", "query_scene", "preferred_retriever", "top_k_profile")
    return s.select("query_id", *flags, *needs, F.concat_ws(";", *named).alias("intent"))


CONFIDENCE = """
n AS (SELECT *, (domain IS NOT NULL)::INT + 2 * (dep IS NOT NULL)::INT + (cat IS NOT NULL)::INT + 2 * (site IS NOT NULL)::INT + num::INT + equ::INT + (equ AND scene = 'procedure_lookup')::INT AS keys,
  scene IN ('policy_lookup', 'procedure_lookup', 'meeting_trace', 'error_code_lookup', 'structured_fact_lookup') AS strong FROM s),
conf AS (SELECT *, round(greatest(0.18::DOUBLE, least(0.96::DOUBLE, 0.28::DOUBLE + CASE WHEN num THEN 0.26::DOUBLE ELSE 0 END + CASE WHEN err THEN 0.24::DOUBLE ELSE 0 END + CASE WHEN lookup THEN 0.18::DOUBLE ELSE 0 END + CASE WHEN pre THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN equ THEN 0.08::DOUBLE ELSE 0 END
  + CASE WHEN strong THEN 0.18::DOUBLE ELSE 0 END + CASE WHEN cat IS NOT NULL THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN cmp THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN tim AND has_dep THEN 0.08::DOUBLE ELSE 0 END
  - CASE WHEN length(q) >= 32 THEN 0.06::DOUBLE ELSE 0 END - CASE WHEN hop THEN 0.08::DOUBLE ELSE 0 END - CASE WHEN keys >= 3 THEN 0.05::DOUBLE ELSE 0 END - CASE WHEN scene IN ('general_lookup', 'project_trace') AND NOT pre AND NOT lookup THEN 0.08::DOUBLE ELSE 0 END)), 4) AS conf FROM n),
g AS (SELECT *, conf < 0.58 AS low, CASE WHEN conf < 0.58 AND NOT pre AND NOT lookup THEN 'general_lookup' ELSE scene END AS gscene FROM conf)
"""


@query("guarded_signals", f"""
WITH {SIGNALS}, {CONFIDENCE} SELECT query_id, conf AS analysis_confidence, CASE WHEN num OR err OR lookup OR pre OR equ OR strong OR cat IS NOT NULL OR cmp OR (tim AND has_dep)
    THEN concat_ws(',', CASE WHEN num THEN 'doc_number' END, CASE WHEN err THEN 'error_code' END, CASE WHEN lookup THEN 'fact_lookup' END, CASE WHEN pre THEN 'identifier' END, CASE WHEN equ THEN 'equipment' END, CASE WHEN strong THEN 'strong_scene' END, CASE WHEN cat IS NOT NULL THEN 'doc_category' END, CASE WHEN cmp THEN 'comparison' END, CASE WHEN tim AND has_dep THEN 'time_and_department' END)
    ELSE 'none' END AS analysis_reason, CASE WHEN low THEN 'hybrid' ELSE retriever END AS preferred_retriever, CASE WHEN low THEN 'balanced' ELSE profile END AS top_k_profile, hyde AND NOT low AS need_hyde, gscene AS query_scene, CASE WHEN low THEN 'heuristic_guardrail' ELSE 'heuristic' END AS analysis_source FROM g""")
def guarded_signals(spark, sf_dir):
    s = understand.apply_guardrail(understand.confidence(signals(spark, sf_dir)))
    return s.select("query_id", "analysis_confidence", "analysis_reason", "preferred_retriever", "top_k_profile", "need_hyde", "query_scene", "analysis_source")


_ERROR_WORD, _SYMPTOM = "(报错|错误|异常|失败|问题|不生效|无法|不工作|故障)", "(卡住|超时|失败|报错|无法|异常|中断|不生效|没结果|没返回)"
_DETAIL = r"(?i)(\b(ERR|ERROR|E)[-_]?\d+\b|traceback|exception|stack trace|[A-Za-z]+Error|[A-Za-z]+Exception)"
_COMPARE, _DEICTIC = r"(和|与|vs\.?|VS\.?|对比|比较|区别|差异)", "^(这个|那个|它|这条|这项|这类|这种|那|那么|那如果|如果是)"
_ROSTER, _CONTACT, _DEPLOY = "(谁值班|谁上班|排班|班次|值班表|安排表)", "(负责人|联系人|电话|归属谁|谁负责)", "(部署|安装|升级|兼容|接入)"


@query("clarifications", f"""
WITH {SIGNALS}, h AS (SELECT s.*, EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = s.conv_id AND c.turn < s.turn) AS hist FROM s),
m AS (SELECT query_id, list_filter([CASE WHEN length(q) <= 4 THEN 'target_object' END, CASE WHEN {_has(_DEICTIC)} AND history AND NOT hist THEN 'runtime_context' END, CASE WHEN {_has(_DEICTIC)} AND length(q) <= 12 AND NOT hist THEN 'target_object' END,
  CASE WHEN {_has(_COMPARE)} AND len(list_filter(regexp_split_to_array(q, '{_COMPARE}'), lambda x: trim(x) <> '')) < 2 THEN 'comparison_targets' END, CASE WHEN {_has(_ERROR_WORD)} AND NOT {_has(_DETAIL)} THEN 'symptom_description' END, CASE WHEN {_has(_ERROR_WORD)} AND NOT env THEN 'runtime_context' END,
  CASE WHEN {_has(_ROSTER)} AND NOT tim THEN 'time_range' END, CASE WHEN {_has(_ROSTER)} AND NOT {_has(_DEPARTMENT)} AND NOT hist THEN 'department' END, CASE WHEN {_has(_ROSTER)} AND contains(q, '值班') AND NOT shf AND NOT hist THEN 'shift' END,
  CASE WHEN {_has(_CONTACT)} AND NOT {_has(_DEPARTMENT)} AND NOT per THEN 'target_object' END, CASE WHEN {_has(_DEPLOY)} AND NOT ver THEN 'version' END, CASE WHEN {_has(_DEPLOY)} AND NOT env THEN 'environment' END,
  CASE WHEN {_has('(怎么处理|怎么办|如何处理|如何解决)')} AND NOT {_has(_SYMPTOM)} THEN 'symptom_description' END], lambda x: x IS NOT NULL) AS l FROM h),
d AS (SELECT query_id, (SELECT list(x ORDER BY n) FROM (SELECT x, min(n) AS n FROM (SELECT unnest(l) AS x, generate_subscripts(l, 1) AS n) GROUP BY x)) AS l FROM m)
SELECT query_id, coalesce(array_to_string(l, ','), '') AS missing_slots, coalesce(len(l), 0) > 0 AS need_clarify, CASE WHEN len(l) > 0 THEN '还需要知道：' || array_to_string(list_transform(l, lambda x: MAP {{{', '.join(f"'{k}': '{v}'" for k, v in understand.SLOT_LABELS.items())}}}[x]), '、') || '？' ELSE '' END AS clarify_question FROM d""")
def clarifications(spark, sf_dir):
    s = understand.clarify(signals(spark, sf_dir).withColumn("has_history", F.size("history") > 0))
    return s.select("query_id", F.array_join("missing_slots", ",").alias("missing_slots"), "need_clarify", "clarify_question")


def _edge(x: str) -> str:
    return f"trim({FOLD.format(x)}, ' ,.;，。；：' || chr(10) || chr(9))"


def _ordered(values: str, limit: int) -> str:
    """First spellings without case, folded, blanks left out."""
    kept = f"list_filter(list_transform({values}, lambda x: {_edge('x')}), lambda x: x <> '')"
    return f"list_filter({kept}, lambda x, i: list_position(list_transform({kept}, lambda y: lower(y)), lower(x)) = i)[1:{limit}]"


def _take(pattern: str, text: str = "base", group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, '{pattern}', {group}), '')"


_DEP1, _SHIFT, _LINE = f"([一-鿿A-Za-z0-9_-]{{2,30}}{_DEP})", "(白班|夜班|早班|中班|晚班)", r"(\d+号线|\d+线)"
_ENV1, _VER1 = _ENV, r"(?i)(\b\d+\.\d+(?:\.\d+)?\b|版本|version)"
#: A version number between characters that are no letter, digit or underscore of any script: RE2's own edges know ASCII only.
_NUMBER = r"(?:^|[^\p{L}\p{N}_])(\d+\.\d+(?:\.\d+)?)(?:$|[^\p{L}\p{N}_])"
_FOLLOWUP = "^(那|那么|如果是|那如果|这个|那个|它|这条|这项|这类|这种|再|然后)"
_SPLIT = r"^(.+?)(和|与|vs\.?|VS\.?|对比|比较)(.+)"
def _or_blank(pattern: str, text: str) -> str:
    return f"coalesce({_take(pattern, text)}, '')"


_SLOTS = _ordered("[" + ", ".join(_or_blank(p, "e") for p in (_DEP1, _SHIFT, _TIME, _ENV1, _VER1)) + "]", 9)

FOLLOWED = f"""
msg AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, {_edge("coalesce(CASE WHEN role <> 'user' THEN text WHEN (3 * conv_id + turn) % 12 = 10 THEN '这个' ELSE (" + _PHRASES + ")[(3 * conv_id + turn) % 12 + 1] || coalesce(text, '') END, '')")} AS e FROM conversations),
slot AS (SELECT *, {_SLOTS} AS slots FROM msg),
near AS (SELECT m.conv_id, m.turn, p.e, p.slots, p.n, row_number() OVER (PARTITION BY m.conv_id, m.turn ORDER BY p.n DESC) AS back FROM msg m JOIN slot p ON p.conv_id = m.conv_id AND p.n < m.n AND p.n >= m.n - 6 AND p.e <> '' QUALIFY back <= 4),
hist AS (SELECT conv_id, turn, count(*) AS texts, arg_max(e, n) AS last, arg_max(slots, n) FILTER (len(slots) > 0) AS slots FROM near GROUP BY conv_id, turn),
f AS (SELECT g.*, {_edge('raw')} AS eq, texts, last, hist.slots FROM g LEFT JOIN hist USING (conv_id, turn)),
res AS (SELECT *, CASE WHEN eq <> '' AND texts > 0 AND ({_has(_FOLLOWUP, 'eq')} OR ({_has(_TIME, 'eq')} AND NOT {_has(_DEP1, 'eq')})) THEN CASE WHEN slots IS NOT NULL THEN CASE WHEN carried <> eq THEN carried ELSE '' END ELSE {_edge("last || ' ' || eq")} END ELSE '' END AS resolved
  FROM (SELECT *, {_edge("array_to_string(list_filter(slots, lambda s: NOT contains(eq, s)), ' ') || ' ' || eq")} AS carried FROM f)),
p0 AS (SELECT *, coalesce(nullif({_edge('resolved')}, ''), eq) AS base FROM res),
p1 AS (SELECT *, {_take(_TIME)} AS f_time, nullif(trim(regexp_replace(coalesce({_take(_DEP1)}, ''), '^(今天|明天|后天|昨天|本周|下周|本月|上月|本季度|今年|去年)', '')), '') AS f_dep, {_take(_SHIFT)} AS f_shift, {_take(_ENV1)} AS f_env, {_take(_NUMBER)} AS f_ver, {_take(_LINE)} AS f_line,
  {_take('(联系人|负责人|值班人|审批人|经理|主管|老师)' + chr(92) + 's*[:：]?' + chr(92) + 's*([一-鿿]{2,4})', 'base', 2)} AS f_person, {_edge("trim(regexp_replace(base, '^(请问|想问一下|麻烦问下|帮我看下|帮我查下|咨询一下|我想知道)', ''))")} AS plain,
  {_ordered(r"list_concat(regexp_extract_all(base, '(?i)\b(?:ERR|ERROR|E)[-_]?\d+\b'), regexp_extract_all(base, '[" + '"' + r"“”''`【】\[\]]([^" + '"' + r"“”''`【】\[\]]{2,40})[" + '"' + r"“”''`【】\[\]]', 1), [coalesce(" + _take(_DEP1) + r", ''), coalesce(" + _take(_SHIFT) + r", ''), coalesce(" + _take(_LINE) + r", '')], list_filter(regexp_extract_all(base, '[A-Za-z0-9._/-]{2,}|[一-鿿]{2,}'), lambda t: regexp_matches(t, '[A-Za-z0-9._/-]')))", 6)} AS words FROM p0),
p2 AS (SELECT *, CASE WHEN plain = '' THEN {_edge('base')} WHEN lookup OR pre THEN plain WHEN {_has('(原因|排查|怎么处理|如何处理|解决|异常)', 'plain')} THEN plain || ' 原因 排查 处理方法' WHEN {_has('(制度|规范|要求|流程|步骤|SOP)', 'plain')} THEN plain || ' 制度 规范 步骤' ELSE plain END AS rewritten,
  CASE WHEN NOT boost AND len(words) <= 1 THEN [] ELSE {_ordered("list_concat(words, [coalesce(f_dep || ' ' || f_shift, ''), coalesce(f_dep || ' ' || f_time, ''), coalesce(f_line || ' ' || f_time, '')])", 4)} END AS keywords,
  CASE WHEN NOT subs THEN [] WHEN {_has(_SPLIT, 'base')} THEN {_ordered(f"[x || ' 特点 适用场景' for x in [{_edge(_take(_SPLIT))}, {_edge(_take(_SPLIT, 'base', 3))}]] || [{_edge(_take(_SPLIT))} || ' ' || {_edge(_take(_SPLIT, 'base', 3))} || ' 区别']", 3)}
    WHEN {_has('(原因|异常|报错|故障|失败)', 'base')} THEN {_ordered("[base || ' 原因', base || ' 排查步骤', base || ' 处理方法']", 3)} WHEN {_has('(方案|架构|设计|建设|选型|最佳实践)', 'base')} THEN {_ordered("[base || ' 方案', base || ' 适用场景', base || ' 风险 注意事项']", 3)}
    WHEN {_has('(制度|规范|流程|步骤|SOP)', 'base')} THEN {_ordered("[base || ' 适用范围', base || ' 执行步骤', base || ' 注意事项']", 3)} ELSE [] END AS sub, CASE WHEN hyde AND NOT low THEN {_edge("'以下段落说明：' || base")} ELSE '' END AS hyd FROM p1)
"""


def plans(spark, sf_dir):
    s = understand.apply_guardrail(understand.confidence(signals(spark, sf_dir)))
    return understand.query_plan(understand.resolve_followup(s))


@query("resolved_plans", f"""
WITH {SIGNALS}, {CONFIDENCE}, {FOLLOWED} SELECT query_id, resolved AS resolved_query, rewritten AS rewritten_query, array_to_string(keywords, '|') AS keyword_queries, array_to_string(sub, '|') AS sub_queries, hyd AS hyde_query,
  concat_ws(';', 'time=' || f_time, 'department=' || f_dep, 'shift=' || f_shift, 'environment=' || f_env, 'version=' || f_ver, 'line=' || f_line, 'person=' || f_person) AS filters FROM p2""")
def resolved_plans(spark, sf_dir):
    """Follow-ups resolved from the history, and the plan of each question."""
    names = ("time", "department", "shift", "environment", "version", "line", "person")
    named = [F.concat(F.lit(f"{k}="), F.try_element_at("structured_filters", F.lit(k))) for k in names]
    return plans(spark, sf_dir).select("query_id", "resolved_query", "rewritten_query", F.array_join("keyword_queries", "|").alias("keyword_queries"), F.array_join("sub_queries", "|").alias("sub_queries"), "hyde_query", F.concat_ws(";", *named).alias("filters"))


#: Routes of plans (query_id, raw, resolved, rewritten, sub, keywords, hyd, profile, prefer) with pruned retrievers and limits.
ROUTES = """
r0 AS (SELECT query_id, profile, prefer, unnest(list_concat([{'name': 'original_query', 'kind': 'original_query', 'q': trim(raw), 's': true, 'd': true}, {'name': 'resolved_query', 'kind': 'resolved_query', 'q': trim(resolved), 's': true, 'd': true}, {'name': 'rewritten_query', 'kind': 'rewritten_query', 'q': trim(rewritten), 's': true, 'd': true}],
  list_transform(sub, lambda x, i: {'name': 'sub_query_' || i, 'kind': 'sub_query', 'q': trim(x), 's': true, 'd': true}), list_transform(keywords, lambda x, i: {'name': 'keyword_' || i, 'kind': 'keyword', 'q': trim(x), 's': true, 'd': false}), [{'name': 'hyde', 'kind': 'hyde', 'q': trim(hyd), 's': false, 'd': true}]), recursive := true), generate_subscripts(list_concat([1, 2, 3], list_transform(sub, lambda x: 1), list_transform(keywords, lambda x: 1), [1]), 1) AS n FROM PLANS),
r1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n) - 1 AS ord FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lower(q) ORDER BY n) AS k FROM r0 WHERE q <> '') WHERE k = 1),
r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY ord) AS nth FROM r1),
r3 AS (SELECT *, (kind = 'hyde' AND profile <> 'broad') OR (kind = 'sub_query' AND (profile = 'precise' OR nth > CASE WHEN profile = 'broad' THEN 3 ELSE 2 END)) OR (kind = 'keyword' AND (nth > 2 OR prefer = 'dense')) AS dropped,
  d AND NOT (prefer = 'sparse' AND (kind IN ('sub_query', 'keyword') OR (profile = 'precise' AND kind IN ('rewritten_query', 'resolved_query')))) AS ud, s AND NOT (prefer = 'dense' AND kind = 'sub_query') AS us FROM r2),
r4 AS (SELECT *, NOT dropped AND (us OR ud) AS keep FROM r3), r5 AS (SELECT *, NOT max(keep) OVER w AND ord = min(ord) OVER w AS first_only FROM r4 WINDOW w AS (PARTITION BY query_id)),
r6 AS (SELECT query_id, ord, name, kind, q, CASE WHEN first_only THEN s ELSE us END AS us, CASE WHEN first_only THEN d ELSE ud END AS ud, profile, prefer FROM r5 WHERE keep OR first_only),
r7 AS (SELECT *, CASE WHEN profile = 'precise' THEN 10 WHEN profile = 'broad' THEN 30 ELSE 20 END AS s0, CASE WHEN profile = 'precise' THEN 10 WHEN profile = 'broad' THEN 30 ELSE 20 END AS d0 FROM r6),
r8 AS (SELECT *, CASE WHEN prefer = 'dense' THEN greatest(2, least(s0, greatest(2, s0 // 2))) ELSE s0 END AS s1, CASE WHEN prefer = 'sparse' THEN greatest(2, least(d0, greatest(2, d0 // 2))) ELSE d0 END AS d1 FROM r7),
routes AS (SELECT *, CASE WHEN kind = 'keyword' THEN greatest(3, least(s1, greatest(3, s1 // 2))) ELSE s1 END AS sk, CASE WHEN kind = 'hyde' THEN greatest(3, least(d1, greatest(3, d1 // 2))) ELSE d1 END AS dk FROM r8)
"""


@query("query_plans", f"""
WITH {SIGNALS}, {CONFIDENCE}, {FOLLOWED}, pl AS (SELECT *, CASE WHEN low THEN 'balanced' ELSE profile END AS gprofile, CASE WHEN low THEN 'hybrid' ELSE retriever END AS prefer FROM p2), {ROUTES.replace('PLANS', '(SELECT query_id, raw, resolved, rewritten, sub, keywords, hyd, gprofile AS profile, prefer FROM pl)')}
SELECT query_id, ord::INTEGER AS route_order, name AS route_name, kind AS route_kind, q AS route_query, us AS use_sparse, ud AS use_dense, profile AS top_k_profile, prefer AS preferred_retriever, sk::INTEGER AS sparse_k, dk::INTEGER AS dense_k FROM routes""")
def query_plans(spark, sf_dir):
    """Signals, confidence, guardrail, follow-ups, plan, routes and budgets of all user turns."""
    return search.route_top_k(search.prune_routes(search.build_routes(plans(spark, sf_dir))))


ROUTED = """
bp AS (SELECT query_id, question AS raw, CASE WHEN query_id % 4 = 0 THEN upper(question) ELSE '' END AS resolved, array_to_string(string_split(question, ' ')[1:6], ' ') AS rewritten, [array_to_string(string_split(question, ' ')[1:4], ' '), array_to_string(string_split(question, ' ')[5:8], ' '), array_to_string(string_split(question, ' ')[9:12], ' ')] AS sub,
  [string_split(question, ' ')[1], string_split(question, ' ')[2], string_split(question, ' ')[3]] AS keywords, '' AS hyd, ['precise', 'balanced', 'broad'][query_id % 3 + 1] AS profile, ['sparse', 'hybrid', 'dense', 'hybrid'][query_id % 4 + 1] AS prefer FROM q)
"""


@query("routed_hits", rf"""
WITH {BM25}, {ROUTED}, {ROUTES.replace('PLANS', 'bp')}, lim AS (SELECT * FROM routes WHERE us),
rt AS (SELECT query_id, ord, token, count(*) AS qtf FROM (SELECT query_id, ord, unnest(list_transform(regexp_extract_all(q, '[\p{{L}}\p{{N}}_]+'), lambda x: lower(x))) AS token FROM lim) GROUP BY ALL),
rs AS (SELECT query_id, ord, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM rt JOIN term USING (token) JOIN post USING (token), tot GROUP BY ALL),
rr AS (SELECT rs.*, name, row_number() OVER (PARTITION BY query_id, ord ORDER BY score DESC, doc_id) AS rank, sk FROM rs JOIN lim USING (query_id, ord) QUALIFY rank <= sk),
m AS (SELECT query_id, doc_id, max(score) AS score, array_to_string(list(name ORDER BY ord), ',') AS names, count(*) AS n FROM rr JOIN documents USING (doc_id) WHERE (query_id % 2 = 1 OR lang = 'en') AND doc_id % 4 <= query_id % 4 GROUP BY query_id, doc_id)
SELECT query_id, doc_id AS chunk_id, score, names AS matched_routes, n AS matched_route_count, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM m""")
def routed_hits(spark, sf_dir):
    """A route table run with the limits of each route, then the question's filters and access rules, hits merged over routes."""
    i, w = F.col("query_id"), F.split("question", " ")
    part = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    asked = bench_questions(spark, sf_dir)
    made = asked.select(
        "query_id", "question", F.when(i % 4 == 0, F.upper("question")).otherwise("").alias("resolved_query"), part(1, 6).alias("rewritten_query"), F.array(part(1, 4), part(5, 4), part(9, 4)).alias("sub_queries"), F.slice(w, 1, 3).alias("keyword_queries"), F.lit("").alias("hyde_query"),
        F.element_at(F.array(*map(F.lit, ("precise", "balanced", "broad"))), (i % 3 + 1).cast("int")).alias("top_k_profile"), F.element_at(F.array(*map(F.lit, ("sparse", "hybrid", "dense", "hybrid"))), (i % 4 + 1).cast("int")).alias("preferred_retriever"),
    )
    routes = search.route_top_k(search.prune_routes(search.build_routes(made)))
    hits = search.run_routes(routes, doc_index(spark, sf_dir))
    open_ = ("allowed_departments", "allowed_roles")  # clearance alone decides here
    rows = search.with_chunks(hits, doc_chunks(spark, sf_dir).withColumns({c: F.lit(None).cast("array<string>") for c in open_}))
    wanted = asked.filter("query_id % 2 = 0").select("query_id", F.lit("lang").alias("field"), F.lit("en").alias("value"))
    kept = filters.apply_acl(filters.match_filters(rows, wanted, ["lang"]), asked, strict=False)
    ranked = search.top_k(fuse.merge_routes(kept), 1 << 30)
    return ranked.select("query_id", "chunk_id", "score", F.array_join("matched_routes", ",").alias("matched_routes"), "matched_route_count", "rank")


def _tokens(x: str) -> str:
    return f"(len(regexp_extract_all({x}, '[一-鿿]|[A-Za-z0-9_./:-]+')) + greatest(1, length({x}) // 80))"


def _overlap(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"


def _greedy(items: str, most: int, tokens: int) -> str:
    """Keys of an ordered list of {keys: [key], used: cost}: number and tokens are limited, the first always fits."""
    ok = f"len(a.keys) < {most} AND (len(a.keys) = 0 OR a.used + x.used <= {tokens})"
    return f"list_reduce(list_concat([{{'keys': []::BIGINT[], 'used': 0::BIGINT}}], {items}), lambda a, x: {{'keys': CASE WHEN {ok} THEN list_concat(a.keys, x.keys) ELSE a.keys END, 'used': CASE WHEN {ok} THEN a.used + x.used ELSE a.used END}}).keys"


#: Words put before turns, by turn % 4, so that the memory's rules are met.
MARKS = ("", "必须 一定要 ", "根据 流程 ", "还没 待确认 ")

TURNS = f"""
t0 AS (SELECT conv_id, turn, role, (['', '必须 一定要 ', '根据 流程 ', '还没 待确认 '])[turn % 4 + 1] || coalesce(text, '') AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS age FROM conversations),
t1 AS (SELECT t0.*, q.question, {KEYWORDS.format('q.question')} AS qk, list_distinct(regexp_extract_all({FOLD.format('content')}, '[一-鿿]|[A-Za-z0-9_./:-]+')) AS ck, {FOLD.format('content')} AS f FROM t0 JOIN q ON q.query_id = conv_id),
t2 AS (SELECT *, list_filter(ck, lambda w: NOT list_contains(['的', '了', '呢', '吗', '是', '在', '和', '与', '及'], w)) AS tk FROM t1),
t3 AS (SELECT *, round(0.38 * {_overlap('qk', 'tk')} + 0.22 / (1.0::DOUBLE + age) + (CASE WHEN role = 'user' THEN 0.08 ELSE 0.03 END + CASE WHEN regexp_matches(content, '必须|优先|不要|一定要') THEN 0.12 ELSE 0.0 END + CASE WHEN regexp_matches(content, '待确认|不确定|还没|还需要') THEN 0.10 ELSE 0.0 END), 4) AS score, {_tokens("'[' || upper(role) || '] ' || f")} AS cost FROM t2),
t4 AS (SELECT conv_id, {_greedy("list({'keys': [turn], 'used': cost} ORDER BY score DESC, turn DESC)", 4, 420)} AS keys FROM t3 GROUP BY conv_id),
turns AS (SELECT t3.*, list_contains(keys, turn) AS selected FROM t3 JOIN t4 USING (conv_id))
"""


def marked_turns(spark, sf_dir):
    mark = F.element_at(F.array(*map(F.lit, MARKS)), (F.col("turn") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat(mark, F.coalesce("text", F.lit(""))).alias("content"))


def asked_conversations(spark, sf_dir):
    """Benchmark questions, each over the conversation of its number."""
    return bench_questions(spark, sf_dir).select("query_id", F.col("query_id").alias("conv_id"), "question")


@query("select_turns", f"WITH {BM25}, {TURNS} SELECT conv_id, turn, round(score, 3) AS score, cost::INTEGER AS cost, selected FROM turns")
def select_turns(spark, sf_dir):
    picked = budget.select_turns(budget.score_turns(marked_turns(spark, sf_dir), asked_conversations(spark, sf_dir)))
    return picked.select("conv_id", "turn", F.round("score", 3).alias("score"), "cost", "selected")


_MARK = "。！？!?；;"
EVIDENCE = f"""
e0 AS (SELECT h.query_id, h.chunk_id, h.score / (h.score + 1.5) AS r, d.source, coalesce(d.text, '') AS content, 'topic ' || (h.chunk_id % 5) AS title, 'part ' || (h.chunk_id % 2) AS section, h.chunk_id % 3 + 1 AS authority, q.question, {KEYWORDS.format('q.question')} AS qk FROM hits h JOIN documents d ON d.doc_id = h.chunk_id JOIN q USING (query_id)),
e1 AS (SELECT *, round(0.50 * r + 0.28 * {_overlap('qk', 'ck')} + 0.06 * authority + 0.04, 4) AS escore, list_filter(list_transform(regexp_extract_all({FOLD.format('content')}, '[^{_MARK}]*[{_MARK}]|[^{_MARK}]+$'), lambda x: trim(x)), lambda x: x <> '') AS ss FROM (SELECT *, {KEYWORDS.format("content || ' ' || title || ' ' || section")} AS ck FROM e0)),
e2 AS (SELECT *, list_sort(list_transform(ss, lambda x, i: {{'neg': -round(0.42 * {_overlap('qk', KEYWORDS.format('x'))} + CASE WHEN i = 1 THEN 0.08 ELSE 0.0 END + CASE WHEN regexp_matches(x, '\\d') THEN 0.08 ELSE 0.0 END + CASE WHEN {_overlap('qk', KEYWORDS.format('x'))} > 0 THEN 0.10 ELSE 0.0 END, 4), 'key': i, 'cost': {_tokens('x')}}})) AS ordered FROM e1),
e3 AS (SELECT *, CASE WHEN len(ss) = 0 THEN left(content, 160) ELSE array_to_string(list_transform({_greedy("list_transform(ordered, lambda o: {'keys': [o.key::BIGINT], 'used': o.cost::BIGINT})", 3, 245)}, lambda k: ss[k]), ' ') END AS compressed, row_number() OVER (PARTITION BY query_id ORDER BY escore DESC, chunk_id) AS n FROM e2),
e4 AS (SELECT *, '[CHUNK_ID:' || chunk_id || '] title=' || title || ' source=' || source || ' section=' || section || chr(10) || compressed AS block FROM e3),
e5 AS (SELECT *, {_tokens('block')} AS cost FROM e4), e6 AS (SELECT query_id, {_greedy("list({'keys': [n], 'used': cost} ORDER BY n)", 4, 980)} AS keys FROM e5 GROUP BY query_id),
evidence AS (SELECT e5.* FROM e5 JOIN e6 USING (query_id) WHERE list_contains(keys, n))
"""


def chosen_evidence(spark, sf_dir):
    asked = asked_conversations(spark, sf_dir)
    hits = search.with_chunks(search.bm25_search(asked, doc_index(spark, sf_dir), 10), doc_chunks(spark, sf_dir))
    found = hits.select("query_id", "chunk_id", "title", "source", "section", "content", (F.col("score") / (F.col("score") + 1.5)).alias("retrieval_score"), govern.authority_rank(F.col("authority_level")).alias("authority_level"), F.lit(1).alias("freshness_level"))
    return budget.select_evidence(budget.score_evidence(found, asked))


@query("budget_evidence", f"WITH {BM25}, {EVIDENCE} SELECT query_id, chunk_id, round(escore, 3) AS evidence_score, n::INTEGER AS evidence_rank, compressed, cost::INTEGER AS cost FROM evidence")
def budget_evidence(spark, sf_dir):
    """Hits as evidence: scored, compressed to their best sentences, chosen under the budget."""
    return chosen_evidence(spark, sf_dir).select("query_id", "chunk_id", F.round("evidence_score", 3).alias("evidence_score"), "evidence_rank", "compressed", "cost")


_LIST = "list(left(f, 80) ORDER BY turn) FILTER ({})"
MEMORY = f"""
m0 AS (SELECT conv_id, coalesce(({_LIST.format("f <> '' AND role = 'user'")})[1], '围绕企业知识问答的持续追问') AS topic, coalesce({_LIST.format("role = 'user' AND regexp_matches(f, '必须|优先|不要|只看|一定要|需要')")}, []) AS cs, coalesce({_LIST.format("regexp_matches(f, '结论|根据|来自|入口|流程|规范|安生平台|二矿|安环部')")}, []) AS fs,
  coalesce({_LIST.format("regexp_matches(f, '还没|还需要|待确认|没找到|不确定')")}, []) AS us FROM turns WHERE NOT selected GROUP BY conv_id),
m1 AS (SELECT conv_id, 'ACTIVE_SESSION_MEMORY:' || chr(10) || to_json({{'topic': topic, 'user_constraints': cs[1:2], 'confirmed_facts': fs[1:2], 'unresolved_tasks': us[1:2]}})::VARCHAR AS full_, 'ACTIVE_SESSION_MEMORY: ' || to_json({{'topic': topic, 'user_constraints': cs[1:1], 'confirmed_facts': fs[1:1], 'unresolved_tasks': us[1:1]}})::VARCHAR AS compact FROM m0),
memory AS (SELECT conv_id, CASE WHEN {_tokens('full_')} <= 260 THEN full_ WHEN {_tokens('compact')} <= 260 THEN compact ELSE left(compact, 910) END AS summary FROM m1)
"""


@query("rolling_summaries", f"WITH {BM25}, {TURNS}, {MEMORY} SELECT conv_id, summary FROM memory")
def rolling_summaries(spark, sf_dir):
    picked = budget.select_turns(budget.score_turns(marked_turns(spark, sf_dir), asked_conversations(spark, sf_dir)))
    return budget.rolling_summary(picked.filter("not selected"))


@query("budget_prompts", f"""
WITH {BM25}, {TURNS}, {EVIDENCE}, {MEMORY}, said AS (SELECT conv_id, string_agg('[' || upper(role) || '] ' || f, chr(10) ORDER BY turn) FILTER (selected) AS ls, count(*) FILTER (NOT selected) AS dropped FROM turns GROUP BY conv_id),
shown AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY n) AS ev FROM evidence GROUP BY query_id),
b AS (SELECT q.query_id, dropped, ev, 'SYSTEM_RULES:' || chr(10) || '- Use nothing but the evidence below.' || chr(10) || '- If it does not settle the question, decline.' || chr(10) || '- Give the chunk behind each statement.' || chr(10) AS rules, 'CURRENT_TASK:' || chr(10) || '- question: ' || {FOLD.format('question')} || chr(10) || '- resolved_query: ' || chr(10) || '- answer_goal: An answer whose statements can be looked up.' || chr(10) AS task,
  summary || chr(10) AS mem, 'RECENT_RELEVANT_TURNS:' || chr(10) || nullif(ls, '') || chr(10) AS rec, 'RETRIEVED_EVIDENCE:' || chr(10) || chr(10) || nullif(ev, '') || chr(10) AS evi, CASE WHEN q.query_id % 2 = 0 THEN 'GOVERNANCE_NOTICE:' || chr(10) || 'n' || chr(10) END AS gov, 'OUTPUT_SCHEMA:' || chr(10) || 'ANSWER: ...' || chr(10) || 'CONFIDENCE: ...' || chr(10) || 'REASONING_SUMMARY: ...' || chr(10) || 'CITATIONS_JSON: [...]' || chr(10) AS sch
  FROM q LEFT JOIN said ON said.conv_id = q.query_id LEFT JOIN shown ON shown.query_id = q.query_id LEFT JOIN memory ON memory.conv_id = q.query_id), p AS (SELECT *, concat_ws(chr(10), rules, task, mem, rec, evi, gov, sch) AS prompt FROM b)
SELECT query_id, prompt, {_tokens('prompt')}::INTEGER AS total_tokens, {_tokens("coalesce(mem, '')")}::INTEGER AS memory_tokens, {_tokens("coalesce(evi, '')")}::INTEGER AS evidence_tokens, concat_ws(',', CASE WHEN dropped > 0 THEN 'dropped_turns:' || dropped END, CASE WHEN ev IS NULL THEN 'no_evidence' END) AS drop_reasons FROM p""")
def budget_prompts(spark, sf_dir):
    """Turns, memory and evidence of all questions as prompts with their token use."""
    asked = asked_conversations(spark, sf_dir)
    picked = budget.select_turns(budget.score_turns(marked_turns(spark, sf_dir), asked))
    q = asked.withColumns({"resolved_query": F.lit(""), "governance_notice": F.when(F.col("query_id") % 2 == 0, "n").otherwise("")})
    made = budget.budget_prompt(q, picked, chosen_evidence(spark, sf_dir), budget.rolling_summary(picked.filter("not selected")))
    use = lambda k: F.col("token_usage")[k]
    return made.select("query_id", "prompt", "total_tokens", use("memory").alias("memory_tokens"), use("evidence").alias("evidence_tokens"), F.array_join("drop_reasons", ",").alias("drop_reasons"))
