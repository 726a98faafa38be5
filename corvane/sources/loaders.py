"""Loading mixed documents: files to (source, title, text) rows, and the parts of it that need Python."""

from __future__ import annotations

import html
import json
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import text as T

# Suffixes that are read.
SUFFIXES = ("md", "markdown", "txt", "rst", "log", "html", "htm", "json", "csv", "pdf")
# Tags that end a block.
BLOCKS = "p|div|br|hr|li|ul|ol|dl|dt|dd|tr|td|th|table|thead|tbody|section|article|header|footer|nav|aside|main|form|figure|figcaption|blockquote|pre|h[1-6]"


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly to all cores if it has fewer partitions than twice their number, as a file of one row group has; larger inputs stay as they are and aren't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df


@F.pandas_udf(StringType())
def nfkc(s):
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def unescape(s):
    return s.map(lambda x: x if x is None or "&" not in x else html.unescape(x))


@F.pandas_udf(StringType())
def render_json(s):
    """JSON with sorted keys and an indent of two; null if it can't be read."""

    def one(x):
        try:
            return json.dumps(json.loads(x), indent=2, sort_keys=True, ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return s.map(one)


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("row_count", IntegerType()), StructField("column_count", IntegerType())]))
def render_csv(s):
    """Rows that aren't blank, cells stripped and joined by bars."""
    import csv
    import io

    import pandas as pd

    out = []
    for x in s:
        rows = list(csv.reader(io.StringIO(x or "", newline="")))
        lines = [" | ".join(c.strip() for c in r) for r in rows if any(c.strip() for c in r)]
        out.append(("\n".join(lines), len(lines), max(map(len, rows), default=0)))
    return pd.DataFrame(out, columns=["text", "row_count", "column_count"])


def decoded(content: Column) -> Column:
    """UTF-8 with what is not valid replaced."""
    return F.make_valid_utf8(content.cast("string"))


def html_stripped(raw: Column) -> Column:
    r = F.regexp_replace(raw, r"(?s)<!--.*?-->", " ")
    return F.regexp_replace(r, r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)", " ")


def html_title(raw: Column) -> Column:
    """Text of the first title element, before entities are resolved."""
    return F.regexp_replace(F.regexp_extract(html_stripped(raw), r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1), "<[^>]+>", "")


def html_text(raw: Column) -> Column:
    """Text of a page, before entities are resolved: blocks become line ends, other tags spaces."""
    r = html_stripped(raw)
    title = F.regexp_extract(r, r"(?is)<title\b[^>]*>.*?</title\s*>", 0)
    at = F.instr(r, title)
    r = F.when(title != "", F.concat(F.substring(r, F.lit(1), at - 1), F.lit(" "), F.substring(r, at + F.length(title), F.length(r)))).otherwise(r)
    return F.regexp_replace(F.regexp_replace(r, rf"(?i)</?(?:{BLOCKS})\b[^>]*/?>", "\n"), "<[^>]+>", " ")


def first_heading(text: Column) -> Column:
    return F.regexp_extract(text, r"(?m)^#\s+(\S.*?)\s*$", 1)


def load(spark: SparkSession, path: str, recursive: bool = True) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, source, title, text, suffix, bytes) of the files under ``path``, and what was skipped (source, reason).

    Files of other kinds, PDF files (no reader is installed) and files without text are skipped.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    rows = files.select(F.col("path").alias("source"), name.alias("name"), suffix.alias("suffix"), F.col("length").alias("bytes"), decoded(F.col("content")).alias("raw"))
    good = F.col("suffix").isin([s for s in SUFFIXES if s != "pdf"])
    is_html = F.col("suffix").isin("html", "htm")
    read = rows.filter(good).withColumn("csv", render_csv(F.when(F.col("suffix") == "csv", F.col("raw")))["text"]).withColumn("json", render_json(F.when(F.col("suffix") == "json", F.col("raw"))))
    read = read.withColumn("page", unescape(F.when(is_html, html_text(F.col("raw"))))).withColumn("head", unescape(F.when(is_html, html_title(F.col("raw")))))
    body = F.when(F.col("suffix") == "csv", F.col("csv")).when(F.col("suffix") == "json", F.col("json")).when(is_html, F.col("page")).otherwise(F.col("raw"))
    read = read.withColumn("text", T.squeeze(nfkc(body)))
    empty = (F.col("text") == "") | F.col("text").isNull()
    blank = lambda c: F.nullif(c, F.lit(""))
    title = F.coalesce(blank(T.squeeze(F.col("head"))), blank(first_heading(F.col("text"))), F.regexp_replace("name", r"\.[^.]+$", ""), F.col("source"))
    docs = read.filter(~empty).select(T.stable_id(F.col("source")).alias("doc_id"), "source", title.alias("title"), "text", "suffix", "bytes")
    skipped = rows.filter(~good).select("source", F.concat(F.lit("unsupported: "), F.col("suffix")).alias("reason")).union(read.filter(empty).select("source", F.lit("no text").alias("reason")))
    return docs, skipped


def page_spans(pages: Column) -> Column:
    """array<struct<start, end, page>> of a text made of ``pages`` joined by line ends, which belong to the page before."""
    n = F.size(pages)
    sizes = F.transform(pages, lambda p, i: F.length(p) + F.when(i < n - 1, 1).otherwise(0))
    start = lambda i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, x: a + x)
    return F.transform(sizes, lambda s, i: F.struct(start(i).alias("start"), (start(i) + s).alias("end"), (i + 1).alias("page")))


def page_at(spans: Column, place: Column) -> Column:
    """The page whose span starts last at or before ``place``; the first page for earlier places; null without pages."""
    return F.coalesce(F.try_element_at(F.filter(spans, lambda s: s["start"] <= place), F.lit(-1)), F.try_element_at(spans, F.lit(1)))["page"]


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Examples of a JSON-lines file; blank lines and lines of comment are skipped, a broken line raises with its text."""
    schema = "question string, answer string, relevant_doc_ids array<string>, relevant_chunk_texts array<string>, must_abstain boolean, tags array<string>"
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(//|$)"))
    row = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    return lines.select(F.when(row["question"].isNull(), F.raise_error(F.concat(F.lit(f"{path}: "), F.col("value")))).otherwise(row).alias("r")).select("r.*")


def write_golden(examples: DataFrame, path: str) -> None:
    examples.write.mode("overwrite").json(path)
