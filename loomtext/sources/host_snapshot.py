"""Snapshots handed over by a host application: strict validation, hashes, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.text import nul_joined, stable_id
from loomtext.sources import storage
from loomtext.sources.text_files import markdown_title

# Fixed values.
SCHEMA = (
    "protocolVersion int, pluginId string, hostProjectId string, hostRevision string, documents array<struct<relativePath:string,category:string,mediaType:string,content:string,sha256:string>>, "
    "chapters array<struct<chapterKey:string,ordinal:int>>, claimedSnapshotHash string"
)
PROTOCOL_VERSION = 1
MAX_DOCUMENT, MAX_TOTAL, MAX_DOCUMENTS, MAX_REVISION = 16 << 20, 64 << 20, 4096, 256
PROJECT_ID, SHA256 = "^[A-Za-z0-9._:-]{1,128}$", "^[0-9a-f]{64}$"
KIND_OF_CATEGORY = {"character": "character", "outline": "outline", "chapter": "chapter", "foreshadow": "foreshadow"}
CATEGORIES = ("project", "world", "character", "outline", "chapter", "foreshadow")
CHAPTER_KEY = "^(?:n:(?:0|[1-9][0-9]*)|s:.+)$"
MEDIA_TYPE = "text/markdown"


def parse(drafts: DataFrame, column: str = "json") -> DataFrame:
    return drafts.withColumn("draft", F.from_json(column, SCHEMA, {"mode": "FAILFAST"}))


def valid_path(path: Column) -> Column:
    """A relative Markdown path without empty, dotted or escaping segments."""
    odd = F.exists(F.split(path, "/", -1), lambda s: (s == "") | s.startswith("."))
    return path.endswith(".md") & ~path.contains("\\") & ~path.contains("\0") & ~path.startswith("/") & ~odd


def snapshot_hash(version: Column, documents: Column) -> Column:
    """SHA-256 of the canonical JSON: documents sorted by path, three fields of each."""
    shaped = F.transform(F.array_sort(documents, lambda a, b: F.when(a["relativePath"] < b["relativePath"], -1).when(a["relativePath"] > b["relativePath"], 1).otherwise(0)), lambda d: F.struct(d["relativePath"].alias("relativePath"), d["category"].alias("category"), d["sha256"].alias("sha256")))
    return F.sha2(F.to_json(F.struct(version.alias("protocolVersion"), shaped.alias("documents"))), 256)


def project_key(plugin: Column, origin: Column, project: Column) -> Column:
    return F.left(F.sha2(nul_joined(plugin, origin, project), 256), F.lit(32))


def violations(drafts: DataFrame, plugin: str | None = None) -> DataFrame:
    """draft rows with ``violations``: the rules that each breaks.  A missing part breaks its rule."""
    docs, chapters = F.coalesce(F.col("draft.documents"), F.array().cast(drafts.schema["draft"].dataType["documents"].dataType)), F.coalesce(F.col("draft.chapters"), F.array().cast(drafts.schema["draft"].dataType["chapters"].dataType))
    bytes_of = F.transform(docs, lambda d: F.octet_length(d["content"]).cast("long"))
    ordinals = F.array_sort(F.transform(chapters, lambda c: c["ordinal"]))
    rules = {
        "protocol_version": F.col("draft.protocolVersion") != PROTOCOL_VERSION,
        "plugin": F.col("draft.pluginId") != plugin if plugin else F.col("draft.pluginId").isNull(),
        "project_id": ~F.col("draft.hostProjectId").rlike(PROJECT_ID),
        "revision": F.col("draft.hostRevision").isNotNull() & ~F.length("draft.hostRevision").between(1, MAX_REVISION),
        "documents": F.col("draft.documents").isNull() | (F.size(docs) > MAX_DOCUMENTS),
        "chapters": F.col("draft.chapters").isNull(),
        "document_bytes": F.exists(bytes_of, lambda n: n > MAX_DOCUMENT),
        "total_bytes": F.aggregate(bytes_of, F.lit(0).cast("long"), lambda s, n: s + F.coalesce(n, F.lit(0))) > MAX_TOTAL,
        "hash_form": F.exists(docs, lambda d: ~F.coalesce(d["sha256"].rlike(SHA256), F.lit(False))) | ~F.col("draft.claimedSnapshotHash").rlike(SHA256),
        "path": F.exists(docs, lambda d: ~valid_path(d["relativePath"])),
        "category": F.exists(docs, lambda d: ~d["category"].isin(*CATEGORIES)),
        "media_type": F.exists(docs, lambda d: d["mediaType"] != MEDIA_TYPE),
        "content_hash": F.exists(docs, lambda d: F.sha2(d["content"], 256) != d["sha256"]),
        "unique_paths": F.size(F.array_distinct(F.transform(docs, lambda d: d["relativePath"]))) != F.size(docs),
        "contiguous": (F.size(chapters) > 0) & (ordinals != F.sequence(F.lit(1), F.greatest(F.size(chapters), F.lit(1)))),
        "unique_keys": F.size(F.array_distinct(F.transform(chapters, lambda c: c["chapterKey"]))) != F.size(chapters),
        "chapter_key": F.exists(chapters, lambda c: ~c["chapterKey"].rlike(CHAPTER_KEY)),
        "snapshot_hash": snapshot_hash(F.col("draft.protocolVersion"), docs) != F.col("draft.claimedSnapshotHash"),
    }
    return drafts.withColumn("violations", F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(True)), name) for name, test in rules.items()])))


def documents(drafts: DataFrame, work_ref: str) -> DataFrame:
    """The documents of a snapshot, in path order, with the chapter numbers that it states."""
    rows = drafts.select(F.explode("draft.documents").alias("d"))
    kinds = F.create_map(*[F.lit(x) for pair in KIND_OF_CATEGORY.items() for x in pair])
    order = Window.orderBy("d.relativePath")  # one snapshot: at most ``MAX_DOCUMENTS`` rows
    path = F.col("d.relativePath")
    return rows.select(
        F.lit(work_ref).alias("work_ref"), stable_id("doc", F.lit(work_ref), path).alias("document_ref"), path.alias("relative_path"), markdown_title(F.col("d.content"), path).alias("title"),
        F.coalesce(F.element_at(kinds, F.col("d.category")), F.lit("document")).alias("kind"), F.col("d.content").alias("content"), F.lit(1).alias("source_start_line"), (F.row_number().over(order) - 1).alias("source_ordinal"),
    )


def activate(work, drafts: DataFrame, work_ref: str, plugin: str | None = None) -> dict:  # noqa: ANN001
    """Make a snapshot (one row of :func:`parse`) the state of ``work``: checked, then indexed as one revision; the same
    snapshot again does nothing, and one that breaks a rule changes nothing."""
    checked = violations(drafts, plugin).select("violations", snapshot_hash(F.col("draft.protocolVersion"), F.col("draft.documents")).alias("hash")).first()
    if checked["violations"]:
        raise ValueError(f"BRIDGE_SNAPSHOT_INVALID: {', '.join(checked['violations'])}")
    at = f"{work.root}/snapshot.json"
    last = storage.get(work.spark, at)["hash"] if "snapshot.json" in storage.names(work.spark, work.root) else None
    if last == checked["hash"]:
        return {"outcome": "noop", "snapshot_hash": last}
    out = work.index(documents(drafts, work_ref).cache())
    storage.put(work.spark, at, {"hash": checked["hash"]}, True)
    return {"outcome": "activated", "snapshot_hash": checked["hash"], **out}
