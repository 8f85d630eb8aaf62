"""Sources and sinks: routed files, text, CSV, HTML, JSON lines, FAQ tables, chunk snapshots."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.text import clean_lines, clean_text, norm_scalar, strip
from lodestack.operators.metadata import DOC_TYPES, file_stem
from lodestack.sources.shared import cut

#: Headers from which a CSV row takes its title, in order of preference. A fixed value.
TITLE_HEADERS = ("code", "name", "title", "question", "doc_number", "system_name", "编号", "名称", "标题", "问题")


def route_by_suffix(files: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Files with their ``parser``, and the files whose suffix no parser knows."""
    suffix = F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]*)$", 1))
    known = F.create_map(*[F.lit(x) for pair in DOC_TYPES.items() for x in pair])
    routed = files.withColumn("parser", F.try_element_at(known, suffix))
    return routed.filter("parser is not null"), routed.filter("parser is null").withColumn("error", F.concat(F.lit("unsupported file type: "), suffix)).drop("parser")


def read_text_documents(spark: SparkSession, path: str, mime_type: str = "text/plain") -> DataFrame:
    """Whole files as documents: source, title (the file's stem), content (cleaned; undecodable bytes dropped), mime_type."""
    files = spark.read.format("binaryFile").load(path)
    # only bytes that are no UTF-8 go to Python; a file's bytes don't wait in one batch with those of its neighbours
    plain = F.is_valid_utf8(F.col("content"))
    text = F.when(plain, F.col("content").cast("string")).otherwise(_decode()(F.when(~plain, F.col("content"))))
    return files.select(F.col("path").alias("source"), file_stem(F.col("path")).alias("title"), clean_text(text).alias("content"), F.lit(mime_type).alias("mime_type"))


def _decode():
    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for contents in batches:
            yield contents.map(lambda b: bytes(b).decode("utf-8", "ignore") if b is not None else "")

    return decode


def pick_row_title(headers: Column, cells: Column) -> Column:
    """The first two non-empty values of preferred headers, else ``header: value`` of the first non-empty cell."""
    low = F.transform(headers, lambda h: F.lower(F.trim(h)))
    at = [F.array_position(low, h) for h in TITLE_HEADERS]
    value = lambda i: F.nullif(clean_lines(F.try_element_at(cells, i.cast("int"))), F.lit(""))
    preferred = F.slice(F.array_compact(F.array(*[F.when(i > 0, value(F.greatest(i, F.lit(1)))) for i in at])), 1, 2)
    named = F.filter(F.transform(cells, lambda c, i: F.struct(F.coalesce(F.try_element_at(headers, i + 1), F.concat(F.lit("column_"), (i + 1).cast("string"))).alias("h"), clean_lines(c).alias("v"))), lambda x: x["v"] != "")
    first = F.try_element_at(named, F.lit(1))
    return F.when(F.size(preferred) > 0, F.array_join(preferred, " / ")).otherwise(F.coalesce(F.concat(first["h"], F.lit(": "), first["v"]), F.lit("")))


def csv_rows_to_text(rows: DataFrame) -> DataFrame:
    """Documents of CSV rows (source, row_no from 0 for the header, cells array): content, rows, columns.

    A data row becomes a ``## Row n`` heading and a ``header: value`` line per non-empty cell; blank rows are skipped; a file
    of only a header keeps it.
    """
    plain = F.transform("cells", lambda c: clean_lines(c))
    head = rows.filter("row_no = 0").select("source", F.transform(plain, lambda h, i: F.when(h == "", F.concat(F.lit("column_"), (i + 1).cast("string"))).otherwise(h)).alias("headers"))
    body = rows.filter("row_no > 0").join(head, "source")
    title = pick_row_title(F.col("headers"), F.col("cells"))
    heading = F.concat(F.lit("## Row "), F.col("row_no").cast("string"), F.when(title != "", F.concat(F.lit(": "), title)).otherwise(""))
    lines = F.filter(F.transform(plain, lambda v, i: F.when(v != "", F.concat(F.coalesce(F.try_element_at(F.col("headers"), i + 1), F.concat(F.lit("column_"), (i + 1).cast("string"))), F.lit(": "), v))), lambda x: x.isNotNull())
    blank = ~F.exists("cells", lambda c: F.coalesce(strip(c), F.lit("")) != "")
    texts = body.filter(~blank).select("source", "row_no", F.array_join(F.concat(F.array(heading), lines), "\n").alias("t"))
    joined = texts.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("row_no", "t"))).alias("ts"))
    counts = rows.groupBy("source").agg(F.greatest(F.lit(0), F.count("*") - 1).alias("rows"))
    out = head.join(counts, "source").join(joined, "source", "left")
    content = F.coalesce(F.array_join(F.transform("ts", lambda x: x["t"]), "\n"), F.concat_ws("\n", F.lit("## Header"), F.array_join("headers", "\n")))
    return out.select("source", file_stem(F.col("source")).alias("title"), clean_lines(content).alias("content"), F.lit("text/csv").alias("mime_type"), "rows", F.size("headers").alias("columns"))


class _Headings(HTMLParser):
    """Text of h1-h4, p and li elements in document order, headings marked by ``#``."""

    TAKEN, SKIPPED = ("h1", "h2", "h3", "h4", "p", "li"), ("script", "style", "noscript")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.lines, self.open, self.skip, self.in_title = "", [], [], 0, False

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIPPED:
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif tag in self.TAKEN:
            if tag != "li":
                self.close("p")
            if tag == "li" and any(o[0] == "li" for o in self.open):
                self.close("li")
            self.lines.append(None)
            self.open.append((tag, len(self.lines) - 1, []))

    def handle_endtag(self, tag):
        if tag in self.SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in self.TAKEN:
            self.close(tag)

    def close(self, tag):
        if any(o[0] == tag for o in self.open):
            while self.open:
                name, at, parts = self.open.pop()
                text = " ".join(" ".join(parts).split())
                self.lines[at] = f"{'#' * int(name[1])} {text}" if text and name[0] == "h" else text
                if name == tag:
                    return

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            for _, _, parts in self.open:
                parts.append(data.strip())


def html_to_text():
    """Vectorised UDF html -> struct of title and heading-marked content."""

    def parse(page: str | None) -> tuple[str, str]:
        p = _Headings()
        p.feed(page or "")
        while p.open:
            p.close(p.open[-1][0])
        return " ".join(p.title.split()), "\n".join(line for line in p.lines if line)

    @F.pandas_udf("title string, content string")
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            yield pd.DataFrame([parse(p) for p in pages], columns=["title", "content"])

    return convert


def read_pages(pages: DataFrame, html: str = "html", source: str = "url") -> DataFrame:
    """Page rows as documents: source, title (the page's or the source's stem), content, mime_type; other columns stay."""
    out = pages.withColumn("_p", html_to_text()(F.col(html)))
    title = F.coalesce(F.nullif(F.col("_p.title"), F.lit("")), file_stem(F.col(source)))
    return out.withColumns({"source": F.col(source), "title": title, "content": clean_lines(F.col("_p.content")), "mime_type": F.lit("text/html")}).drop("_p")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under an explicit schema; blank lines give no row."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_faq_csv(spark: SparkSession, path: str) -> DataFrame:
    """FAQ entries of a CSV with header question, answer and optional id, keywords, category: trimmed, incomplete ones dropped."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    has = lambda c: norm_scalar(F.col(c)) if c in raw.columns else F.lit(None).cast("string")
    rows = raw.withColumn("_n", F.monotonically_increasing_id() + 1)
    out = rows.select(F.coalesce(has("id").try_cast("bigint"), F.col("_n")).alias("entry_id"), has("question").alias("question"), has("answer").alias("answer"), F.coalesce(has("keywords"), F.lit("")).alias("keywords"), F.coalesce(has("category"), F.lit("")).alias("category"))
    return out.filter("question is not null and answer is not null").withColumns({"enabled": F.lit(True), "hit_count": F.lit(0).cast("bigint"), "last_hit_at": F.lit(None).cast("timestamp")})


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_clustered(chunks: DataFrame, path: str, by: list[str], bloom: tuple[str, ...] = ("chunk_id",), rows_per_file: int = 250_000) -> None:
    """Chunks in files of neighbouring values of ``by``, with bloom filters of the ``bloom`` columns.

    A predicate on the leading columns then meets few files and row groups by their least and greatest values, and a point
    lookup few by their filters. Equal values are told apart by the chunk's id, so a value that a third of the rows has fills
    as many files as it needs.
    """
    files_ = max(1, -(-chunks.count() // rows_per_file))
    keys = [*by, *[c for c in ("chunk_id",) if c in chunks.columns and c not in by]]
    out = chunks.repartitionByRange(files_, *keys).sortWithinPartitions(*keys).write.mode("overwrite")
    for c in bloom:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(rows_per_file))
    out.parquet(path)


def get_chunks(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Point lookup: the chunks whose id is in ``ids``."""
    return chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def write_snapshot(chunks: DataFrame, vectors: DataFrame, path: str) -> None:
    """Chunks and vectors as one new snapshot; refused unless both have the same ids and the vectors one dimension."""
    vectors = cut(vectors)  # encoded once, however often it is looked at
    sizes = vectors.agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("ids"), F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi")).first()
    n = chunks.count()
    unmatched = chunks.join(vectors, "chunk_id", "left_anti").limit(1).count()
    if n != sizes["n"] or sizes["ids"] != sizes["n"] or unmatched or sizes["lo"] != sizes["hi"]:
        raise ValueError(f"snapshot refused: {n} chunks, {sizes['n']} vectors, dimensions {sizes['lo']}..{sizes['hi']}")
    chunks.write.mode("overwrite").partitionBy("chunk_level").parquet(f"{path}/chunks")
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")


PROMOTED = ("chunk_id", "doc_id", "source", "title", "page", "section", "chunk_level", "parent_chunk_id", "content", "data_classification", "authority_level", "version", "effective_date", "department", "owner_department")


def to_store(chunks: DataFrame) -> DataFrame:
    """Flat store records: promoted columns without nulls (``''``, page -1), the rest as JSON in ``extra``."""
    rest = [c for c in chunks.columns if c not in PROMOTED]
    flat = [(F.coalesce(F.col(c), F.lit(-1)) if c == "page" else F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in PROMOTED if c in chunks.columns]
    return chunks.select(*flat, (F.to_json(F.struct(*rest)) if rest else F.lit("{}")).alias("extra"))


def from_store(records: DataFrame, extra_schema: str) -> DataFrame:
    """The inverse of ``to_store``."""
    flat = [(F.nullif(F.col(c), F.lit(-1)) if c == "page" else F.nullif(F.col(c), F.lit(""))).alias(c) for c in records.columns if c != "extra"]
    return records.select(*flat, F.from_json("extra", extra_schema).alias("_x")).select("*", "_x.*").drop("_x")
