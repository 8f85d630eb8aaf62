"""Documents to parent and child chunks with stable ids, metadata and local flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.text import beyond_ascii, chunk_summary, first_of_key, norm_scalar, strip

# Sizes by document type (child size and overlap, parent size and overlap, least size) and rule words.
PROFILES = {
    "csv": (220, 0, 420, 0, 20),
    "pptx": (420, 40, 960, 80, 40),
    "pdf": (900, 120, 1800, 180, 80),
    "text": (1000, 100, 1800, 160, 80),
    "default": (1200, 150, 2400, 200, 80),
}
SECTION_RULES = [
    ("(适用范围|范围|总则)", "scope"),
    ("(职责|责任|责任分工)", "responsibility"),
    ("(流程|步骤|操作|处置|方案|实施)", "procedure"),
    ("(例外|异常|特殊情况)", "exception"),
    ("(附录|附件|附表)", "appendix"),
    ("(定义|术语|说明)", "definition"),
]
STEPS = r"(^|\n)\s*(\d+\.|[-*])\s+"
CONTACT = "(联系人|电话|手机号|邮箱)"
VERSION_SIGNAL = "(版本|生效日期|失效日期|作废|试行|现行|version:|effective_date:|expiry_date:|version_status:|status:)"
RISK_SIGNAL = "(风险|隐患|事故|应急|告警|异常)"
KEYWORD = r"[一-鿿A-Za-z0-9_/-]{2,30}"
KEYWORD_SEEDS = ("business_domain", "process_stage", "equipment_type", "equipment_id", "system_name", "project_name", "doc_type")
PAGE_MARK = r"<!--\s*page:(\d+)\s*-->"
HEADING = r"^(#{1,6})\s+(.+)$"


def chunk_profile(docs: DataFrame) -> DataFrame:
    """``docs`` with the sizes of their type: child_max, child_overlap, parent_max, parent_overlap, min_chars, by_page."""
    kind, mime = F.lower(F.coalesce("doc_type", F.lit(""))), F.lower(F.coalesce("mime_type", F.lit("")))
    name = (
        F.when((kind == "csv") | (mime == "text/csv"), "csv")
        .when((kind == "pptx") | mime.contains("presentationml.presentation"), "pptx")
        .when((kind == "pdf") | (mime == "application/pdf"), "pdf")
        .when(kind.isin("txt", "text") | (mime == "text/plain"), "text")
        .otherwise("default")
    )
    columns = ("child_max", "child_overlap", "parent_max", "parent_overlap", "min_chars")
    table = F.create_map(*[x for k, v in PROFILES.items() for x in (F.lit(k), F.struct(*[F.lit(n).alias(c) for n, c in zip(v, columns)]))])
    sized = docs.withColumn("_sizes", table[name]).withColumn("by_page", name == "pdf")
    return sized.select("*", "_sizes.*").drop("_sizes")


def window_pieces(text: Column, size: Column, overlap: Column) -> Column:
    """Windows of ``size`` characters that share ``overlap``; one piece for a text that fits.

    One pass of a pattern that looks ahead for the window and moves on by a step, as long as more than the overlap is left.
    """
    number = lambda c: c.cast("int").cast("string")
    window = F.concat(F.lit("(?s)(?=(.{1,"), number(size), F.lit("}))(?=.{"), number(overlap + 1), F.lit("}).{1,"), number(size - overlap), F.lit("}"))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.regexp_extract_all(text, window, F.lit(1)))


def length_pieces(text: Column, size: Column, overlap: Column) -> Column:
    """A trimmed text whole if it fits, else its paragraphs packed up to ``size`` with oversize ones in windows.

    The trimmed paragraphs stand in one text with a blank line between them; a greedy pattern takes as many whole ones as
    fit, or one that is too long. So a text costs what its length does, however many paragraphs it has.
    """
    end = r"(?=\n\n|\z)"
    packs = F.concat(F.lit("(?s)(.{1,"), size.cast("int").cast("string"), F.lit(rf"}}{end}|.+?{end})(?:\n\n|\z)"))

    def made(trimmed: Column) -> Column:
        paragraphs = F.filter(F.transform(F.split(trimmed, "\n\n+"), strip), lambda p: p != "")
        packed = F.regexp_extract_all(F.array_join(paragraphs, "\n\n"), packs, F.lit(1))
        pieces = F.flatten(F.transform(packed, lambda p: window_pieces(p, size, overlap)))
        return F.when(trimmed == "", F.array().cast("array<string>")).when(F.length(trimmed) <= size, F.array(trimmed)).otherwise(pieces)

    # the lambda's variable holds the trimmed text, which would else be trimmed for each use
    return F.flatten(F.transform(F.array(strip(text)), made))


#: Where a heading line begins: blanks, one to six marks, blanks, text.
_BLANK = r"[\s&&[^\n]]"
HEADING_START = rf"(?mdU)(?=^{_BLANK}*#{{1,6}}{_BLANK}+\S)"


def heading_sections(text: Column) -> Column:
    """Array of (title, level, body) of the parts that begin at ``#`` headings; what stands before the first has no title, level 1."""

    def made(part: Column) -> Column:
        line = strip(F.substring_index(part, "\n", 1))
        is_head = line.rlike(HEADING)
        rest = F.when(F.contains(part, F.lit("\n")), F.regexp_replace(part, r"\A[^\n]*\n", "")).otherwise("")
        title = F.when(is_head, strip(F.regexp_extract(line, HEADING, 2))).otherwise("")
        level = F.when(is_head, F.length(F.regexp_extract(line, HEADING, 1)).cast("int")).otherwise(1)
        return F.struct(title.alias("title"), level.alias("level"), F.when(is_head, strip(rest)).otherwise(strip(part)).alias("body"), is_head.alias("is_head"))

    return F.transform(F.split(text, HEADING_START), made)


def heading_paths(sections: DataFrame) -> Column:
    """The open headings down to a section's own, over rows (doc_id, section_no, section, section_level, is_head) of documents.

    A heading is open until one of its own level or a higher one comes; so a level's last heading is open where it stands
    behind the last one of every level above it. One window for each of the six levels, whatever number of sections.
    """
    upto = Window.partitionBy("doc_id").orderBy("section_no").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("is_head") & (F.col("section_level") == n), F.struct("section_no", "section")), ignorenulls=True).over(upto) for n in range(1, 7)]
    none = F.lit(-1)
    at = [F.coalesce(x["section_no"], none) for x in last]
    above = [none, *[F.greatest(none, none, *at[:n]) for n in range(1, 6)]]
    open_ = [F.when(F.col("is_head") & (F.lit(n + 1) <= F.col("section_level")) & (at[n] > above[n]), last[n]["section"]) for n in range(6)]
    return F.array_join(F.array_compact(F.array(*open_)), " / ")


def page_sections(text: Column) -> Column:
    """Array of (title, level, body, is_head) of the parts that begin with a page mark; empty without marks."""
    parts = F.filter(F.split(text, r"(?=<!--\s*page:\d+\s*-->)"), lambda p: p.rlike(r"^<!--\s*page:\d+\s*-->"))

    def made(part: Column) -> Column:
        title = F.concat(F.lit("第"), F.regexp_extract(part, PAGE_MARK, 1), F.lit("页"))
        return F.struct(title.alias("title"), F.lit(1).alias("level"), strip(part).alias("body"), F.lit(True).alias("is_head"))

    return F.transform(parts, made)


def split_sections(docs: DataFrame) -> DataFrame:
    """One row per section of ``docs`` (doc_id, content, by_page): section_no, section, section_path, section_level, body."""
    text = F.coalesce("content", F.lit(""))
    pages = page_sections(text)
    sections = F.when(F.col("by_page") & (F.size(pages) > 0), pages).otherwise(heading_sections(text))
    kept = [c for c in docs.columns if c != "content"]  # a section doesn't carry its whole document
    out = docs.filter(strip(text) != "").select(*kept, F.posexplode(sections).alias("section_no", "_s"))
    out = out.select("*", F.col("_s.title").alias("section"), F.col("_s.level").alias("section_level"), F.col("_s.body").alias("body"), F.col("_s.is_head").alias("is_head"))
    return out.withColumn("section_path", heading_paths(out)).drop("_s", "is_head")


def chunk_id(prefix: str, doc_id: Column, idx: Column, content: Column) -> Column:
    seed = F.concat_ws(":", F.lit(prefix), doc_id, idx.cast("string"), F.substring(content, 1, 200))
    return F.concat_ws("-", F.lit(prefix), F.substring(doc_id, 1, 8), idx.cast("string"), F.substring(F.sha2(seed, 256), 1, 16))


def carry_page(pieces: DataFrame, doc_id: str = "doc_id", order: tuple[str, ...] = ("section_no", "parent_no")) -> DataFrame:
    """``page``: the piece's own mark, else the last one before it in the document; marks are cut from the content."""
    # most pieces have no comment at all, which a search for its first bytes tells without a pattern
    own = F.when(F.col("content").contains("<!--"), F.nullif(F.regexp_extract("content", PAGE_MARK, 1), F.lit("")).cast("int"))
    upto = Window.partitionBy(doc_id).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cut = F.when(own.isNotNull(), strip(F.regexp_replace("content", PAGE_MARK, ""))).otherwise(F.col("content"))
    return pieces.withColumn("page", F.last(own, ignorenulls=True).over(upto)).withColumn("content", cut)


def section_type(section: Column, content: Column) -> Column:
    text = F.concat_ws("\n", F.coalesce(section, F.lit("")), F.substring(content, 1, 200))
    out = F.lit("general")
    for pattern, label in reversed(SECTION_RULES):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return F.when(beyond_ascii(text), out).otherwise("general")


def topic_keywords(seeds: list[Column], path: Column, content: Column) -> Column:
    """Seeds, then keyword runs of the path and the first 160 characters; no case-insensitive repeats, eight at most."""
    words = F.concat(
        F.filter(F.array(*seeds), lambda v: v.isNotNull()) if seeds else F.array().cast("array<string>"),
        F.regexp_extract_all(F.coalesce(path, F.lit("")), F.lit(KEYWORD), F.lit(0)),
        F.regexp_extract_all(F.substring(content, 1, 160), F.lit(KEYWORD), F.lit(0)),
    )
    words = F.filter(F.transform(words, strip), lambda w: F.length(w) >= 2)
    return first_of_key(words, F.lower, limit=8)


def chunk_flags(chunks: DataFrame) -> DataFrame:
    """section_type, chunk_summary, contains_* and topic_keywords of chunks (content, section, section_path, title)."""
    has = lambda c: F.col(c) if c in chunks.columns else F.lit(None).cast("string")
    empty = F.lit("")
    states = [F.concat(F.lit(f"{k}:"), F.coalesce(has(k), empty)) for k in ("version", "effective_date", "expiry_date", "status", "version_status")]
    # the states come first, where the labels of the version signal always stand; no pattern spans two of these lines
    near = F.concat_ws("\n", F.concat_ws(" ", *states), F.coalesce("section_path", empty), F.coalesce("title", empty), F.substring("content", 1, 500))
    seeds = [norm_scalar(F.col(c)) for c in KEYWORD_SEEDS if c in chunks.columns]
    return chunks.withColumns(
        {
            "section_type": section_type(F.col("section"), F.col("content")),
            "chunk_summary": chunk_summary(F.col("content")),
            "contains_table": F.col("content").contains("|") | F.col("content").contains("\t"),
            "contains_steps": F.col("content").rlike(STEPS),
            "contains_contact": beyond_ascii(near) & near.rlike(CONTACT),
            "contains_version_signal": near.rlike(VERSION_SIGNAL),
            "contains_risk_signal": beyond_ascii(near) & near.rlike(RISK_SIGNAL),
            "topic_keywords": topic_keywords(seeds, F.col("section_path"), F.col("content")),
        }
    )


def build_chunks(docs: DataFrame) -> DataFrame:
    """Parents and children of documents (doc_id, source, title, content, doc_type, mime_type, any metadata).

    A section's short pieces are dropped, a parent without a long enough child gets one of its own text. Metadata columns go
    along. One window per document numbers the pieces, so a document, not the corpus, is what meets in a task.
    """
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.sha2(F.col("source"), 256))
    sections = split_sections(chunk_profile(docs.withColumn("doc_id", doc_id)))
    cut = F.transform(length_pieces(F.col("body"), F.col("parent_max"), F.col("parent_overlap")), strip)
    kept = F.filter(cut, lambda p: (p != "") & ~((F.length(p) < F.col("min_chars")) & (F.col("section") != "")))
    pieces = carry_page(sections.select("*", F.posexplode(kept).alias("parent_no", "content")).drop("body"))
    ordered = Window.partitionBy("doc_id").orderBy("section_no", "parent_no")
    parents = pieces.withColumn("parent_idx", F.row_number().over(ordered) - 1)
    parents = parents.withColumn("parent_chunk_id", chunk_id("p", F.col("doc_id"), F.col("parent_idx"), F.col("content")))
    cut = F.transform(length_pieces(F.col("content"), F.col("child_max"), F.col("child_overlap")), strip)
    long_enough = F.filter(cut, lambda p: (p != "") & ~((F.length(p) < F.col("min_chars")) & (F.length("content") > F.col("min_chars"))))
    # the lambda's variable holds the pieces, which would else be cut twice
    kids = F.flatten(F.transform(F.array(long_enough), lambda k: F.when(F.size(k) > 0, k).otherwise(F.array("content"))))
    part = lambda level, content: F.struct(F.lit(level).alias("level"), content.alias("content"))
    family = F.concat(F.array(part("parent", F.col("content"))), F.transform(kids, lambda k: part("child", k)))
    # a parent and its children come of one row, so a document is cut once
    both = parents.select("*", F.posexplode(family).alias("child_no", "_part")).withColumns({"chunk_level": F.col("_part.level"), "content": F.col("_part.content")})
    inside = Window.partitionBy("doc_id", "chunk_level").orderBy("parent_idx", "child_no")
    both = both.withColumn("chunk_idx", F.row_number().over(inside) - 1)
    child_id = chunk_id("c", F.col("doc_id"), F.col("chunk_idx"), F.concat_ws(":", "parent_chunk_id", "content"))
    both = both.withColumn("chunk_id", F.when(F.col("chunk_level") == "parent", F.col("parent_chunk_id")).otherwise(child_id))
    both = both.drop("_part", "child_no", "parent_idx", "section_no", "parent_no", "by_page", "child_max", "child_overlap", "parent_max", "parent_overlap", "min_chars")
    path = F.when(F.col("section_path") != "", F.col("section_path")).otherwise(F.col("section"))
    return chunk_flags(both.withColumns({"section_path": path, "section": F.nullif("section", F.lit(""))}))


def inherit_metadata(chunks: DataFrame, docs: DataFrame, keys: list[str]) -> DataFrame:
    """Document metadata copied onto chunks that lack those columns."""
    missing = [k for k in keys if k in docs.columns and k not in chunks.columns]
    return chunks.join(docs.select("doc_id", *[norm_scalar(F.col(k)).alias(k) for k in missing]), "doc_id", "left")
