"""Document metadata by first-match rules over title, file stem and the first 4000 characters. Existing values win."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import beyond_ascii, norm_list, norm_scalar, strip

HEAD_CHARS = 4000
_HAN = "一-鿿"

# Field patterns, label words and class words of the metadata vocabulary.
FIELD_PATTERNS = {
    "doc_number": rf"(?:文号|文件编号|制度编号|文档编号|编号)\s*[:：]?\s*([A-Za-z0-9{_HAN}\-/()（）〔〕\[\]第号]{{2,64}})",
    "subsidiary": rf"([{_HAN}A-Za-z0-9_-]{{2,40}}(?:分公司|子公司|煤矿|电厂|选煤厂|事业部|运营公司|管理公司))",
    "plant": rf"([{_HAN}A-Za-z0-9_-]{{2,40}}(?:厂|矿|站|基地|园区|中心))",
    "department": rf"([{_HAN}A-Za-z0-9_-]{{2,30}}(?:车间|部门|班组|小组|中心|事业部|工段|科室|仓库|产线|号线|线))",
    "shift": r"(白班|夜班|早班|中班|晚班)",
    "line": r"(\d+号线|\d+线)",
    "environment": r"(?i)(生产|测试|预发|本地|线上|线下|docker|k8s|kubernetes|macos|linux|windows)",
    "version": r"(?iU)(\b\d+\.\d+(?:\.\d+)?\b|v\d+\.\d+(?:\.\d+)?)",
    "time": r"(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}月\d{1,2}[日号]?|今天|明天|本周|下周|本月)",
    "effective_date": r"(?U)\b(20\d{2}[-/]\d{1,2}[-/]\d{1,2})\b",
    "expiry_date": r"(?:失效日期|废止日期|截止日期)\s*[:：]?\s*(20\d{2}[-/]\d{1,2}[-/]\d{1,2})",
    "issued_by": rf"(?:发布部门|印发部门|起草部门|发布单位)\s*[:：]?\s*([{_HAN}A-Za-z0-9_-]{{2,40}})",
    "approved_by": rf"(?:批准人|审批人|审核人|签发人)\s*[:：]?\s*([{_HAN}]{{2,8}})",
    "owner_role": rf"(?:责任角色|责任岗位|岗位)\s*[:：]?\s*([{_HAN}A-Za-z0-9_-]{{2,30}})",
    "equipment_type": rf"([{_HAN}A-Za-z0-9_-]{{2,30}}(?:锅炉|汽轮机|发电机|输煤皮带|磨煤机|风机|泵|压缩机|变压器|阀门|机组))",
    "equipment_id": r"(?:设备编号|设备编码|设备ID|机组编号|设备号)\s*[:：]?\s*([A-Za-z0-9_-]{2,40})",
    "system_name": rf"(?:系统名称|平台名称|系统平台)\s*[:：]?\s*([A-Za-z0-9_\-/{_HAN}]{{2,60}})",
    "project_name": rf"(?:项目名称|工程名称|课题名称)\s*[:：]?\s*([A-Za-z0-9_\-/{_HAN}（）()《》]{{2,80}})",
    "applicable_region": rf"(?:适用区域|适用范围|适用地区)\s*[:：]?\s*([A-Za-z0-9_\-/{_HAN}、，,]{{2,80}})",
    "applicable_site": rf"(?:适用场站|适用厂站|适用地点|适用现场)\s*[:：]?\s*([A-Za-z0-9_\-/{_HAN}、，,]{{2,80}})",
}
LEADING_TIME = r"^(今天|明天|后天|昨天|本周|下周|本月|上月|本季度|今年|去年)"
PERSON = rf"(联系人|负责人|值班人|审批人|经理|主管|老师)\s*[:：]?\s*([{_HAN}]{{2,4}})"
PERSON_PRIORITY = {"值班人": 5, "联系人": 4, "负责人": 3, "审批人": 2, "经理": 1, "主管": 1, "老师": 1}
DOC_TYPES = {".pdf": "pdf", ".docx": "docx", ".pptx": "pptx", ".md": "markdown", ".markdown": "markdown", ".html": "html", ".htm": "html", ".txt": "text", ".csv": "csv"}
CLASS_RULES = {
    "data_classification": ("internal", [("(?i)(绝密|restricted|机密)", "restricted"), ("(?i)(秘密|敏感|sensitive)", "sensitive"), ("(?i)(公开|public)", "public"), ("(?i)(内部|internal)", "internal")]),
    "authority_level": ("medium", [("(制度|规范|标准|条例|办法|规定)", "high"), ("(?i)(SOP|流程|作业指导书|操作手册|应急预案)", "medium"), ("(会议纪要|讨论记录|复盘|草稿|汇报)", "low")]),
    "version_status": ("active", [("(已废止|已作废|已失效|废止执行)", "obsolete"), ("(试行|试运行|暂行)", "trial"), ("(现行|有效|生效|执行中)", "active")]),
    "status": ("active", [("(已废止|已作废|已失效|废止执行)", "inactive"), ("(草稿|征求意见稿|讨论稿)", "draft"), ("(试行|试运行|暂行)", "trial"), ("(现行|有效|生效|执行中)", "active")]),
    "business_domain": (
        "general_ops",
        [
            ("(安全生产|安全检查|隐患排查|事故|应急预案)", "safety_production"),
            ("(巡检|检修|保养|点检|维修|设备)", "equipment_maintenance"),
            ("(调度|值班|排班|交接班)", "dispatch"),
            ("(采购|招采|供应商|合同)", "procurement"),
            ("(报销|预算|财务|付款|结算)", "finance"),
            ("(人员|薪酬|考勤|培训|人力|招聘)", "hr"),
            ("(项目|里程碑|方案变更|会议纪要|立项)", "project_management"),
            ("(接口|错误码|数据库|平台|系统|发布)", "it_ops"),
        ],
    ),
    "process_stage": (
        "general",
        [
            ("(巡检|点检|巡查)", "inspection"),
            ("(检修|维修|保养)", "maintenance"),
            ("(应急|故障处理|事故处置)", "emergency"),
            ("(审批|报批|签批)", "approval"),
            ("(报销|付款|结算)", "reimbursement"),
            ("(招标|采购|比价|询价)", "procurement"),
            ("(调度|值班|排班|交接班)", "dispatch"),
        ],
    ),
    "project_phase": (None, [("(立项|可研)", "initiation"), ("(设计|方案)", "design"), ("(实施|建设|上线|部署)", "implementation"), ("(验收|试运行|试运)", "acceptance"), ("(复盘|总结|收尾)", "closure")]),
}
#: Fields that a text without any Han character can match, too.
PLAIN_TOO = {"environment", "version", "time", "effective_date"}
#: Fields whose values end in one of the words that their patterns close with, after ``MOST_BEFORE`` characters at most.
ENDED, MOST_BEFORE = ("subsidiary", "plant", "department", "equipment_type"), 40
#: Up to the last Han character, and what a label there may still be followed by: all that a pattern with a Han word can take.
NEAR_HAN = rf"(?s)^(.*[{_HAN}]\s*[:：]?\s*.{{0,80}})"
#: How a match of a pattern begins; asked first at each character, as most begin none.
STARTS = {"environment": "[dkmlw生测预本线]", "version": r"[\dv]", "time": "[0-9今明本下]", "effective_date": "20"}
CATEGORY_RULES = [("(值班|排班|安排表)", "schedule"), ("(制度|规范|要求|办法)", "policy"), ("(流程|步骤|SOP|作业指导书)", "procedure"), ("(会议纪要|复盘|记录)", "meeting")]


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def head_text(title: Column, path: Column, content: Column) -> Column:
    empty = F.lit("")
    return F.concat_ws("\n", F.coalesce(title, empty), F.coalesce(file_stem(path), empty), F.substring(F.coalesce(content, empty), 1, HEAD_CHARS))


def first_match(text: Column, pattern: str) -> Column:
    """Group 1 of the first match without a leading time word, null when nothing is left."""
    return cleaned(F.regexp_extract(text, pattern, 1))


def cleaned(found: Column) -> Column:
    return norm_scalar(F.regexp_replace(found, LEADING_TIME, ""))


def ended_match(text: Column, pattern: str) -> Column:
    """Group 1 of the first match of a pattern that closes with words, sought from ``MOST_BEFORE`` characters before the first of
    these; null for a text without one."""
    before = F.length(F.split(text, pattern[pattern.rindex("(?:") : -1], 2)[0])
    start = F.greatest(before - MOST_BEFORE + 1, F.lit(1))
    return F.when(before < F.length(text), F.regexp_extract(F.substring(text, start, F.length(text)), pattern, 1))


def normalize_version(value: Column) -> Column:
    """Without a leading ``version`` or ``v``."""
    plain = F.regexp_replace(F.regexp_replace(strip(value), r"^(version|VERSION)\s*", ""), r"^[vV]\s*", "")
    return F.nullif(plain, F.lit(""))


def extract_person(text: Column) -> Column:
    """The person behind the label of highest priority, the first on ties."""
    labels, names = (F.regexp_extract_all(text, F.lit(PERSON), F.lit(g)) for g in (1, 2))
    order = F.create_map(*[F.lit(x) for pair in PERSON_PRIORITY.items() for x in pair])
    found = F.transform(labels, lambda label, i: F.struct((-order[label]).alias("p"), i.alias("i"), F.element_at(names, i + 1).alias("name")))
    return F.array_min(found)["name"]


def first_rule(text: Column, rules: list[tuple[str, str]], default: str | None, near: Column | None = None) -> Column:
    """The value of the first rule of which any word stands in the text. Han words are sought in ``near``, where that is given."""
    out = F.lit(default)
    for pattern, value in reversed(rules):
        words = pattern.removeprefix("(?i)").strip("()").split("|")
        han = [w for w in words if not w.isascii()]
        found = [(text if near is None else near).contains(w) for w in han]
        if plain := [w for w in words if w.isascii()]:
            found.append(text.rlike(f"{'(?i)' * pattern.startswith('(?i)')}({'|'.join(plain)})"))
        out = F.when(reduce(or_, found), value).otherwise(out)
    return out


def started(name: str) -> str:
    """The pattern of a field behind a look at how its matches begin."""
    pattern = FIELD_PATTERNS[name]
    flags = re.match(r"(\(\?\w+\))?", pattern).end()
    return f"{pattern[:flags]}(?={STARTS[name]}){pattern[flags:]}" if name in STARTS else pattern


def doc_type(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in DOC_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]*)$", 1))), F.lit("unknown"))


def doc_category(text: Column, near: Column | None = None) -> Column:
    return first_rule(text, CATEGORY_RULES, None, near)


def ensure_identity(docs: DataFrame) -> DataFrame:
    """doc_id and title where missing: a hash of the source, the source's file stem."""
    ids = F.coalesce(norm_scalar(F.col("doc_id")), F.sha2(F.col("source"), 256))
    return docs.withColumns({"doc_id": ids, "title": F.coalesce(norm_scalar(F.col("title")), file_stem(F.col("source")))})


def enrich(docs: DataFrame, group_company: str | None = None) -> DataFrame:
    """All metadata fields of documents (source, title, content), as columns; non-blank columns that exist are kept.

    ``group_company`` is a pattern of the parent company's names; without it that field stays null.
    """
    given = docs.columns
    docs = docs.withColumn("_text", head_text(F.col("title"), F.col("source"), F.col("content")))
    docs = docs.withColumn("_near", F.when(beyond_ascii(F.col("_text")), F.nullif(F.regexp_extract("_text", NEAR_HAN, 1), F.lit(""))))
    text, near = F.col("_text"), F.col("_near")
    found = {name: ended_match(near, p) if name in ENDED else F.regexp_extract(text if name in PLAIN_TOO else near, started(name), 1) for name, p in FIELD_PATTERNS.items()}
    docs = docs.withColumns({f"_raw_{name}": v for name, v in found.items()})  # found once, however often it is looked at
    made = {name: cleaned(F.col(f"_raw_{name}")) for name in FIELD_PATTERNS}
    made["group_company"] = first_match(text, f"({group_company})") if group_company else F.lit(None).cast("string")
    made["version"] = normalize_version(made["version"])
    made |= {"owner_department": made["department"], "person": extract_person(near), "doc_type": doc_type(F.col("source")), "source_system": F.lit("local_file"), "doc_category": doc_category(text, near)}
    made |= {name: first_rule(text, rules, default, near) for name, (default, rules) in CLASS_RULES.items()}
    lowered = set(CLASS_RULES)
    have = {c: norm_scalar(F.col(c)) for c in made if c in given}
    docs = docs.withColumns({c: F.coalesce(F.lower(have[c]) if c in lowered else have[c], v) if c in have else v for c, v in made.items()})
    return docs.drop("_text", "_near", *[f"_raw_{name}" for name in FIELD_PATTERNS])


def normalize_metadata(docs: DataFrame, scalars: list[str], lists: list[str]) -> DataFrame:
    """Scalar keys trimmed or null; list keys as arrays of non-blank entries, comma texts split."""
    types = dict(docs.dtypes)
    made = {c: norm_scalar(F.col(c)) for c in scalars if c in types} | {c: norm_list(F.col(c), types[c] == "string") for c in lists if c in types}
    return docs.withColumns(made)
