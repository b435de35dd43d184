"""Markdown and plain-text works: discovery, limits, decoding, chapters, kinds, snapshots."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomtext.functions.numerals import CHAPTER_LINE, chapter_number_col, chapter_of_col
from loomtext.functions.text import js_trim, lines_of, stable_id
from loomtext.sources import storage

# Fixed values.
EXTENSIONS = "md|markdown|txt|epub"
MAX_FILE, MAX_WORK = 16 << 20, 64 << 20
CHAPTER_HINT, CHARACTER_HINT = "chapter|章节|第.+[章回节]", "character|role|人物|角色"


def _plain(path: str) -> str:
    """A path without its scheme and the slash at its end."""
    return re.sub("^[a-z]+:/+", "/", path).rstrip("/")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, relative_path, length, modificationTime, content) of all files under ``root`` but hidden ones; content is
    read only if used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = _plain(root)
    plain = F.regexp_replace("path", "^[a-z]+:/+", "/")
    rel = F.when(plain == base, F.regexp_extract(plain, "([^/]*)$", 1)).otherwise(F.regexp_replace(plain, "^" + "\\Q" + base + "\\E/?", ""))
    return files.withColumn("relative_path", rel).filter(~F.col("relative_path").rlike("(^|/)(\\.|node_modules/)"))


def escaping_links(spark: SparkSession, root: str) -> list[str]:
    """Links under a local folder that lead out of it.  Other stores have no links."""
    if storage.handle(spark, root)[1].getUri().getScheme() != "file":
        return []
    base, out = os.path.realpath(_plain(root)), []
    for folder, folders, names in os.walk(base, followlinks=False):
        out += [at for n in (*folders, *names) if os.path.islink(at := os.path.join(folder, n)) and os.path.commonpath([base, os.path.realpath(at)]) != base]
    return sorted(out)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """The readable sources of :func:`listing`, with ``is_book``; a link that leaves ``root`` is refused."""
    if links := escaping_links(spark, root):
        raise ValueError(f"PATH_NOT_ALLOWED: {links[0]} leads out of the source")
    name = F.col("relative_path")
    return listing(spark, root).filter(name.rlike(f"(?i)\\.({EXTENSIONS})$")).withColumn("is_book", name.rlike("(?i)\\.epub$"))


def check_sizes(files: DataFrame, most: int = MAX_FILE, total: int = MAX_WORK) -> None:
    """Refuse too large sources before any content is read: by file, and by work where there are several."""
    by = ["work_ref"] if "work_ref" in files.columns else []
    found = files.groupBy(*by).agg(F.max("length").alias("most"), F.sum("length").alias("total")).agg(F.max("most").alias("most"), F.max("total").alias("total")).first()
    if (found["most"] or 0) > most:
        raise ValueError("SOURCE_FILE_TOO_LARGE")
    if (found["total"] or 0) > total:
        raise ValueError("SOURCE_TOTAL_TOO_LARGE")


def works(files: DataFrame, root: str) -> DataFrame:
    """Files with their work: each book package is one, all text files together are another."""
    path = F.when(F.col("is_book"), F.regexp_replace("path", "^[a-z]+:/+", "/")).otherwise(F.lit(_plain(root)))
    return files.withColumn("work_path", path).withColumn("work_ref", stable_id("work", F.lit("generic"), F.col("work_path")))


def snapshot(files: DataFrame) -> DataFrame:
    """One row: a fingerprint of paths, sizes and times, in locale order."""
    row = F.struct(F.collate("relative_path", "UNICODE").alias("p"), F.col("length"), F.col("modificationTime").cast("double").alias("t"))
    return files.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: F.concat_ws(":", r["p"].cast("string"), r["length"].cast("string"), r["t"].cast("string"))), "\n"), 256).alias("fingerprint"))


@F.pandas_udf(StringType())
def _decode(data: pd.Series) -> pd.Series:
    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        if b[:3] == b"\xef\xbb\xbf":
            return b[3:].decode("utf-8")
        try:
            return b.decode("utf-8")
        except UnicodeDecodeError:
            try:
                return b.decode("gb18030")
            except UnicodeDecodeError as e:
                raise ValueError("TEXT_ENCODING_UNSUPPORTED: neither UTF-8 nor GB18030") from e

    return data.map(one)


def decode_text(content: Column) -> Column:
    """UTF-8 (a mark at the start goes), else GB18030, else an error; valid UTF-8 without a mark stays in the JVM."""
    text = content.cast("string")
    plain = F.is_valid_utf8(text) & (F.substring(content, 1, 3) != F.unhex(F.lit("EFBBBF")))
    return F.when(plain, text).otherwise(_decode(content))


def base_name(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), "\\.[^.]*$", "")


def markdown_title(content: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(js_trim(F.regexp_extract(content, "(?m)^#[ \\t]+(.+)$", 1)), F.lit("")), base_name(path))


def document_kind(path: Column, title: Column) -> Column:
    """chapter, character or document, by path and title."""
    text = F.lower(F.concat_ws(" ", path, title))
    return F.when(text.rlike(CHAPTER_HINT), "chapter").when(text.rlike(CHARACTER_HINT), "character").otherwise("document")


def markdown_documents(files: DataFrame) -> DataFrame:
    """files(work_ref, relative_path, content) -> one document each."""
    rows = files.withColumn("content", decode_text(F.col("content"))).withColumn("title", markdown_title(F.col("content"), F.col("relative_path")))
    rows = rows.withColumns({"kind": document_kind(F.col("relative_path"), F.col("title")), "document_ref": stable_id("doc", F.col("work_ref"), F.col("relative_path")), "source_start_line": F.lit(1), "chapter_number": chapter_of_col(F.col("title"))})
    order = Window.partitionBy("work_ref").orderBy(F.collate("relative_path", "UNICODE"))
    return rows.withColumn("source_ordinal", F.row_number().over(order) - 1)


def text_documents(files: DataFrame) -> DataFrame:
    """files(work_ref, relative_path, content text) without chapter lines -> one document each, named by the file."""
    title = base_name(F.col("relative_path"))
    return files.select("work_ref", stable_id("doc", F.col("work_ref"), F.col("relative_path")).alias("document_ref"), "relative_path", title.alias("title"), document_kind(F.col("relative_path"), title).alias("kind"), "content", chapter_of_col(title).alias("chapter_number"), F.lit(1).alias("source_start_line"))


def corpus_sizes(rows: DataFrame, group: str, text: Column) -> DataFrame:
    """(group, files, chars, bytes) of the texts of a corpus."""
    return rows.groupBy(group).agg(F.count("*").alias("files"), F.sum(F.length(text)).alias("chars"), F.sum(F.octet_length(text)).alias("bytes"))


def volume_number(number: Column, order: Window) -> Column:
    """struct-free running volume: a number that does not rise starts a new one.  Use in two steps, see chapters()."""
    return F.when(number <= F.lag(number).over(order), 1).otherwise(0)


def chapters(files: DataFrame) -> DataFrame:
    """files(work_ref, relative_path, content text) -> a document per chapter line, and one for what stands before.

    A file of no chapter lines gives no row.  Lines of a file stay together; the chapter of a line is a running sum.
    """
    lines = files.select("work_ref", "relative_path", F.posexplode(lines_of(F.col("content"))).alias("pos", "line"))
    mark = js_trim(F.col("line"))
    number = F.when(mark.rlike(CHAPTER_LINE), chapter_number_col(F.coalesce(F.nullif(F.regexp_extract(mark, CHAPTER_LINE, 1), F.lit("")), F.regexp_extract(mark, CHAPTER_LINE, 2))))
    lines = lines.withColumn("number", F.when(number > 0, number))
    file = Window.partitionBy("work_ref", "relative_path")
    so_far = file.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("chapter", F.count("number").over(so_far)).withColumn("any", F.count("number").over(file)).filter("any > 0")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    docs = lines.groupBy("work_ref", "relative_path", "chapter").agg(joined.alias("content"), F.min("pos").alias("first"), F.max("number").alias("local"), F.min_by("line", "pos").alias("head"))
    order = file.orderBy("chapter")
    docs = docs.withColumn("restart", volume_number(F.col("local"), order)).withColumn("volume", 1 + F.sum("restart").over(order))
    place = F.when(F.col("chapter") == 0, "preface").otherwise(F.concat(F.lit("v"), F.col("volume"), F.lit("-c"), F.col("local")))
    blank = F.length(F.regexp_extract("content", "^((?:[^\\S\\n]*\\n)*)", 1)) - F.length(F.regexp_replace(F.regexp_extract("content", "^((?:[^\\S\\n]*\\n)*)", 1), "\n", ""))
    docs = docs.withColumns(
        {
            "title": F.when(F.col("chapter") == 0, F.concat(base_name(F.col("relative_path")), F.lit(" preface"))).otherwise(js_trim(F.col("head"))),
            "kind": F.when(F.col("chapter") == 0, "document").otherwise("chapter"),
            "document_ref": stable_id("doc", F.col("work_ref"), F.col("relative_path"), place),
            "source_start_line": F.col("first") + 1 + F.when(F.col("chapter") == 0, blank).otherwise(0),
            "chapter_number": F.when(F.col("chapter") > 0, F.col("chapter")).cast("int"),
            "place": place,
        }
    )
    text = F.when(F.col("chapter") == 0, js_trim(F.col("content"))).otherwise(F.regexp_replace("content", "\\s+$", ""))
    return docs.withColumns({"content": text, "relative_path": F.concat_ws("#", "relative_path", "place")}).filter("content <> ''").select(
        "work_ref", "document_ref", "relative_path", "title", "kind", "content", "chapter_number", F.col("volume").cast("int").alias("volume_number"), F.col("local").alias("local_chapter_number"), "source_start_line"
    )
