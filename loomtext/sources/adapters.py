"""From a path to the documents of a work: adapters, their order, source checks, and loading that notices changes.

An adapter finds works under a path (``discover``), fingerprints one (``snapshot``) and reads its documents (``load``).
Special adapters are asked before the general one, which takes any readable text.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.sources import epub, project, storage, text_files

SEGMENTS = "array<struct<k:bigint,relative_path:string,start_line:int,end_line:int,document_start_line:bigint,document_end_line:bigint>>"
COLUMNS = {
    "work_ref": "string", "document_ref": "string", "relative_path": "string", "title": "string", "kind": "string", "content": "string", "chapter_number": "int", "volume_number": "int",
    "local_chapter_number": "int", "source_start_line": "int", "source_ordinal": "int", "segments": SEGMENTS,
}


class SourceError(ValueError):
    def __init__(self, code: str, text: str) -> None:
        super().__init__(f"{code}: {text}")
        self.code = code


@dataclass(frozen=True)
class Candidate:
    """A work that can be read: which adapter found it, where, and its reference."""

    adapter: str
    path: str
    work_ref: str
    title: str


class Adapter(Protocol):
    name: str

    def discover(self, spark: SparkSession, path: str) -> list[Candidate]: ...

    def snapshot(self, spark: SparkSession, work: Candidate) -> str: ...

    def load(self, spark: SparkSession, work: Candidate) -> DataFrame: ...


def shaped(df: DataFrame) -> DataFrame:
    """Every column of a document table, in one order; what a source does not have is null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])


def _files_of(spark: SparkSession, work: Candidate) -> DataFrame:
    files = text_files.discover(spark, work.path)
    return files.filter("not is_book" if not work.path.lower().endswith(".epub") else "is_book").withColumn("work_ref", F.lit(work.work_ref))


@dataclass(frozen=True)
class TextAdapter:
    """Markdown, plain text and book packages: a package is a work by itself, all other files of a folder are one."""

    name: str = "generic"
    most: int = text_files.MAX_FILE
    total: int = text_files.MAX_WORK
    book_limits: epub.Limits = epub.Limits()

    def discover(self, spark: SparkSession, path: str) -> list[Candidate]:
        found = text_files.works(text_files.discover(spark, path), path).groupBy("work_path", "work_ref").agg(F.count("*").alias("files")).orderBy("work_path").collect()
        return [Candidate(self.name, r["work_path"], r["work_ref"], os.path.basename(r["work_path"].rstrip("/"))) for r in found]

    def snapshot(self, spark: SparkSession, work: Candidate) -> str:
        return text_files.snapshot(_files_of(spark, work)).first()["fingerprint"]

    def load(self, spark: SparkSession, work: Candidate) -> DataFrame:
        files = _files_of(spark, work)
        text_files.check_sizes(files, self.most, self.total)  # by length; no content is read for it
        if work.path.lower().endswith(".epub"):
            made = shaped(epub.chapters(epub.spine_items(files, self.book_limits)))
        else:
            plain = files.filter(F.col("relative_path").rlike("(?i)\\.txt$")).withColumn("content", text_files.decode_text(F.col("content")))
            cut = text_files.chapters(plain)
            heads = cut.select(F.substring_index("relative_path", "#", 1).alias("relative_path")).distinct()
            whole = text_files.markdown_documents(files.filter(~F.col("relative_path").rlike("(?i)\\.txt$")))
            uncut = text_files.text_documents(plain.join(heads, "relative_path", "left_anti"))
            made = shaped(cut).unionByName(shaped(whole)).unionByName(shaped(uncut))
        # Source order: the file by locale, then the place in the file.
        order = Window.partitionBy("work_ref").orderBy(F.collate(F.substring_index("relative_path", "#", 1), "UNICODE"), F.coalesce("chapter_number", F.lit(0)), "source_start_line", "document_ref")
        return made.withColumn("source_ordinal", F.row_number().over(order) - 1)


@dataclass(frozen=True)
class ProjectAdapter:
    """A folder with a marker file and books, whose files' places state their kinds."""

    marker: str
    name: str = "project"

    def _files(self, spark: SparkSession, path: str) -> DataFrame:
        return text_files.listing(spark, path).filter(F.col("relative_path").rlike("(?i)\\.(md|json)$"))

    def discover(self, spark: SparkSession, path: str) -> list[Candidate]:
        if self.marker not in storage.names(spark, path):
            return []
        found = project.books(self._files(spark, path), self.marker).orderBy("book").collect()
        return [Candidate(self.name, f"{path.rstrip('/')}#{r['book']}", r["work_ref"], r["title"]) for r in found]

    def snapshot(self, spark: SparkSession, work: Candidate) -> str:
        root, _, book = work.path.partition("#")
        return text_files.snapshot(self._files(spark, root).filter(F.col("relative_path").startswith(f"books/{book}/"))).first()["fingerprint"]

    def load(self, spark: SparkSession, work: Candidate) -> DataFrame:
        files = self._files(spark, work.path.partition("#")[0])
        text_files.check_sizes(files)
        return shaped(project.documents(files, self.marker).filter(F.col("work_ref") == work.work_ref))


def resolve(spark: SparkSession, path: str, adapters: list[Adapter], hint: str | None = None) -> dict:
    """0, 1 or many works under ``path``: unsupported, resolved or ambiguous.  The first adapter that finds any is used;
    ``hint`` names the only one to ask."""
    asked = [a for a in adapters if hint is None or a.name == hint]
    if not asked:
        raise SourceError("ADAPTER_NOT_FOUND", str(hint))
    found: list[Candidate] = next((f for a in asked if (f := a.discover(spark, path))), [])
    status = "unsupported" if not found else "resolved" if len(found) == 1 else "ambiguous"
    notes = [{"code": "UNSUPPORTED_SOURCE"}] if not found else []
    return {"status": status, "work_ref": found[0].work_ref if len(found) == 1 else None, "candidates": found, "diagnostics": notes}


def load_consistent(spark: SparkSession, adapter: Adapter, work: Candidate, attempts: int = 2) -> tuple[DataFrame, str]:
    """(documents, fingerprint) of one state of the sources: read between two equal fingerprints, else tried once more."""
    for _ in range(attempts):
        before = adapter.snapshot(spark, work)
        documents = adapter.load(spark, work).persist()
        documents.count()  # reads the files
        if adapter.snapshot(spark, work) == before:
            return documents, before
        documents.unpersist()
    raise SourceError("SOURCE_CHANGED_DURING_READ", "the sources changed while they were read; try again")
