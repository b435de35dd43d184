"""Incremental indexing: hashes, differences, derivation of what a change touches, and atomic publication of revisions.

A revision is a list of segments (see :mod:`segments`) under ``<root>/rev=N-T-x``.  It is valid once
``<root>/valid/N.json`` is there, which is made under another name and renamed as the last step; the greatest valid
revision is the current one.  Nothing is deleted or replaced on the way, so a reader, and a reader after a crash, sees a
whole revision or the one before.  A change writes one more segment, with the rows it adds and the keys it takes away;
when there are many, or they are large, a further revision puts them together.

One writer holds a lease: the file of the greatest number under ``<root>/fence``, renewed while it works.  A writer whose
lease has run out is replaced by the next number, and what it still tries to publish is refused (``INDEX_FENCED``).
Derived tables can always be rebuilt from the sources.
"""

from __future__ import annotations

import itertools
import os
import socket
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from loomtext.functions.text import normalize_name, snapshot_hash
from loomtext.operators import fulltext, graph, segments
from loomtext.operators.spans import spans as split
from loomtext.sources import storage

SCHEMA_VERSION, DERIVATION_VERSION = 5, 6  # the latter is a fixed value
IDENTITY = ["document_ref", "relative_path", "title", "kind", "chapter_number", "volume_number", "local_chapter_number", "source_ordinal", "source_start_line", "segments", "content_hash"]
CARRIED = ["relative_path", "title", "kind", "source_ordinal"]  # what a span says of its document, so that reads join nothing
LEASE_SECONDS = 60.0
KEPT_REVISIONS = 2
ORDERED = {"spans": "span_ref", "postings": "term", "terms": "term"}  # tables that are read by key, and the key


def semantic_hash(df: DataFrame) -> Column:
    """SHA-256 of the canonical JSON of what identifies a document's derived rows."""
    have = [F.col(c) for c in IDENTITY if c in df.columns]
    return F.sha2(F.to_json(F.struct(F.lit(DERIVATION_VERSION).alias("derivation"), *have), {"ignoreNullFields": "false"}), 256)


def diff(new: DataFrame, old: DataFrame, key: str = "document_ref", value: str = "semantic_hash") -> DataFrame:
    """(key, status): added, updated, skipped or deleted."""
    left, right = new.select(key, F.col(value).alias("new")), old.select(key, F.col(value).alias("old"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("new") == F.col("old"), "skipped").otherwise("updated")
    return left.join(right, key, "full_outer").select(key, status.alias("status"))


def diff_counts(changes: DataFrame) -> DataFrame:
    spark = changes.sparkSession
    names = spark.createDataFrame([("added",), ("updated",), ("deleted",), ("skipped",)], "status string")
    counted = changes.groupBy("status").agg(F.count("*").alias("n"))
    return names.join(F.broadcast(counted), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def freshness(current: DataFrame, stored: DataFrame | None) -> str:
    """fresh, stale or missing, without writing anything."""
    if stored is None:
        return "missing"
    return "stale" if diff(current, stored).filter("status <> 'skipped'").limit(1).count() else "fresh"


def source_snapshot(documents: DataFrame) -> DataFrame:
    return documents.groupBy("work_ref").agg(snapshot_hash(F.col("document_ref"), F.col("semantic_hash")).alias("source_snapshot_hash"), F.count("*").alias("documents"))


# Derivation ----------------------------------------------------------------------------------------------------------


def keep_revision(new: DataFrame, old: DataFrame | None, key: str, same: list[str], revision: int) -> DataFrame:
    """``new`` with ``revision``: the old row's where nothing in ``same`` differs, else this one."""
    if old is None:
        return new.withColumn("revision", F.lit(revision).cast("long"))
    text = [F.to_json(F.struct(*same)).alias("is")]
    before = old.select(F.col(key).alias("old_key"), *[x.alias("was") for x in text], F.col("revision").alias("old_revision"))
    joined = new.withColumn("is", text[0]).join(before, F.col(key) == F.col("old_key"), "left")
    return joined.withColumn("revision", F.when(F.col("is") == F.col("was"), F.col("old_revision")).otherwise(F.lit(revision)).cast("long")).drop("is", "was", "old_key", "old_revision")


def changed_names(entities: DataFrame, old: DataFrame) -> DataFrame:
    """(work_ref, name, normalized_name, entity_ref) of entities that came, went, or mean something else now."""
    shape = ["work_ref", "name", "normalized_name", "entity_ref", "valid_from_chapter", "valid_to_chapter"]
    a, b = entities.select(*shape), old.select(*shape)
    return a.exceptAll(b).unionByName(b.exceptAll(a)).select(*shape[:4]).distinct()


def spans_holding(spans: DataFrame, names: DataFrame, posted: DataFrame | None) -> DataFrame:
    """(work_ref, span_ref) of spans that hold one of ``names`` (work_ref, name); only spans whose postings have all
    trigrams of a name are read, but for names too short to have any."""
    if posted is not None:
        wanted = names.withColumn("phrase", F.lower("name"))
        long = fulltext.phrase_candidates(posted, wanted.filter("length(phrase) >= 3").select("phrase").distinct())
        at = long.join(wanted.select("work_ref", "phrase").distinct(), ["work_ref", "phrase"]).select("work_ref", "span_ref").distinct()
        short = names.filter("length(name) < 3")
        maybe = spans.join(at, ["work_ref", "span_ref"], "left_semi")
        found = graph.name_occurrences(maybe, names)
        if short.limit(1).count():
            found = found.unionByName(graph.name_occurrences(spans, short))
    else:
        found = graph.name_occurrences(spans, names)
    return found.select("work_ref", "span_ref").distinct()


def affected_spans(kept: DataFrame, fresh: DataFrame, names: DataFrame, old: dict[str, DataFrame]) -> DataFrame:
    """(work_ref, span_ref) whose references are derived anew: fresh spans, kept spans that hold a changed name, and
    those with a link that such a name is, or would have been, the target of."""
    holding = spans_holding(kept, names.select("work_ref", "name").distinct(), old.get("postings"))
    linked = old["mentions"].filter("source_kind = 'native'").join(names.select("work_ref", "entity_ref"), ["work_ref", "entity_ref"], "left_semi").select("work_ref", "span_ref")
    waiting = old["unresolved"].withColumn("normalized_name", normalize_name(F.col("text"))).join(names.select("work_ref", "normalized_name"), ["work_ref", "normalized_name"], "left_semi").select("work_ref", "span_ref")
    links = linked.unionByName(waiting).join(kept.select("span_ref"), "span_ref", "left_semi").select("work_ref", "span_ref")
    return fresh.select("work_ref", "span_ref").unionByName(holding).unionByName(links).distinct()


def measured(spans: DataFrame) -> DataFrame:
    """Spans with what later steps need of their texts: a hash, and the number of trigrams."""
    return spans.withColumns({"content_hash": F.sha2("content", 256), "n_trigrams": fulltext.trigram_count(F.col("heading")) + fulltext.trigram_count(F.col("content"))})


REFERENCE_KINDS = {"appears_in": "target_ref", "mentions": "source_ref", "contains": "source_ref"}  # the document's end


def together(*works: Callable[[], object]) -> None:
    """Run independent chains of jobs at the same time; the first error is raised."""
    with ThreadPoolExecutor(len(works)) as pool:
        for done in [pool.submit(inheritable_thread_target(SparkSession.active())(w)) for w in works]:
            done.result()


def indexed_postings(spans: DataFrame) -> DataFrame:
    """Postings with places of ``spans``."""
    return fulltext.postings(spans.withColumn("source_ordinal", F.col("doc_source_ordinal")), places=True)


def derive(documents: DataFrame, draft: Draft) -> int:
    """Write all tables for ``documents`` into ``draft``; the number of spans.  Each table is written before the next one
    reads it, so nothing is computed twice and plans stay short."""
    save, number = draft.save, F.lit(draft.revision).cast("long").alias("revision")
    stored = save("documents", documents.drop("content"))
    spans = save("spans", measured(split(documents, keep=CARRIED)))

    def references() -> None:
        defined = save("definitions", graph.definitions(spans, stored))
        entities = save("entities", graph.canonical_entities(defined).select("*", number))
        found, (resolved, unresolved) = graph.mentions(spans, entities), graph.links(spans, entities)
        mentions = save("mentions", found.select(*graph.MENTION, number).unionByName(resolved.select(*graph.MENTION, number)))
        save("unresolved", unresolved.select("*", number))
        save("aliases", graph.aliases(entities))
        edges, evidence = graph.edge_tables(stored, spans, entities, mentions)
        save("edges", edges.select("*", number))
        save("evidence", evidence)

    def words() -> None:
        save("terms", fulltext.document_frequency(save("postings", indexed_postings(spans))))

    together(references, words)
    row = spans.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_trigrams"), F.lit(0)).alias("size")).first()
    draft.totals = {"spans": row["n"], "trigrams": row["size"]}
    return row["n"]


def derive_change(documents: DataFrame, changes: DataFrame, old: Callable[[str], DataFrame], totals: dict, draft: Draft) -> int:
    """Write into ``draft`` what ``documents`` change in the tables of the revision before (``old``, by name): rows to add
    and keys to take away; the number of spans whose references were derived.  changes: see :func:`diff`, without skipped.

    Only changed documents are split; definitions, mentions, links and edges are derived for what a change touches: its
    own spans, spans that hold a name that came, went or changed (found through the postings), and links that wait for
    such a name.  Read with the segments before it, the result equals that of a rebuild, but for the numbers of revisions.
    """
    save, revision, steps = draft.save, draft.revision, itertools.count()
    number = F.lit(revision).cast("long").alias("revision")

    def keep(df: DataFrame) -> DataFrame:
        """Written for this writer alone, so that plans stay short."""
        return save(f"_{next(steps)}", df)

    changed = documents.join(changes.filter("status <> 'deleted'").select("document_ref"), "document_ref", "left_semi")
    gone = changes.filter("status <> 'added'").select("document_ref")
    before = keep(old("spans").join(gone, "document_ref", "left_semi"))
    made: dict[str, DataFrame] = {}

    def first(name: str, df: DataFrame) -> Callable[[], None]:
        return lambda: made.update({name: save(name, df)})

    together(first("gone_documents", gone), first("documents", changed.drop("content")), first("spans", measured(split(changed, keep=CARRIED))), first("gone_spans", before.select("span_ref")))
    stored, fresh, gone_spans, gone = made["documents"], made["spans"], made["gone_spans"], made["gone_documents"]

    def words() -> None:
        posted = save("postings", indexed_postings(fresh))
        less = fulltext.document_frequency(fulltext.postings(before)).withColumn("df", -F.col("df"))
        save("terms", fulltext.document_frequency(posted).unionByName(less).groupBy("work_ref", "term").agg(F.sum("df").alias("df")).filter("df <> 0"))
        n, size = (F.sum(F.lit(k) * c) for k, c in ((1, F.col("sign")), (1, F.col("sign") * F.col("n_trigrams"))))
        row = fresh.select("n_trigrams", F.lit(1).alias("sign")).unionByName(before.select("n_trigrams", F.lit(-1).alias("sign"))).agg(F.coalesce(n, F.lit(0)).alias("n"), F.coalesce(size, F.lit(0)).alias("size")).first()
        draft.totals = {"spans": totals["spans"] + row["n"], "trigrams": totals["trigrams"] + row["size"]}

    def references() -> None:
        stay = old("spans").join(gone, "document_ref", "left_anti")
        defined = save("definitions", graph.definitions(fresh, stored))
        were = old("definitions").join(gone, "document_ref", "left_semi")
        affected = save("gone_entities", defined.select("entity_ref").unionByName(were.select("entity_ref")).distinct())
        live = old("definitions").join(gone, "document_ref", "left_anti").join(affected, "entity_ref", "left_semi").unionByName(defined)
        was = keep(old("entities").join(affected, "entity_ref", "left_semi"))
        now = save("entities", keep_revision(graph.canonical_entities(live), was, "entity_ref", ["span_ref", "identity_hash", "evidence_hash", "properties"], revision))
        entities = old("entities").join(affected, "entity_ref", "left_anti").select(*now.columns).unionByName(now)
        names = keep(changed_names(now, was))
        if names.limit(1).count():
            touched = keep(affected_spans(stay, fresh, names, {n: old(n) for n in ("mentions", "unresolved", "postings")}))
            kept = keep(stay.join(touched.select("span_ref"), "span_ref", "left_semi"))
            again = kept.select(*fresh.columns).unionByName(fresh)
        else:
            touched, kept, again = fresh, fresh.limit(0), fresh
        found, (resolved, unresolved) = graph.mentions(again, entities), graph.links(again, entities)
        dead = kept.select("span_ref").unionByName(gone_spans).unionByName(fresh.select("span_ref")).distinct()
        together(
            first("aliases", graph.aliases(now)), first("gone_references", dead), first("unresolved", unresolved.select("*", number)),
            first("mentions", found.select(*graph.MENTION, number).unionByName(resolved.select(*graph.MENTION, number))),
            lambda: made.update({"touched": touched.count()}),
        )
        dead, mentions = made["gone_references"], made["mentions"]
        # Edges of every document that a derived or a former span belongs to, and the chain if a chapter is affected.
        about = keep(changes.select("document_ref").unionByName(kept.select("document_ref")).distinct())
        shape = ["work_ref", "document_ref", "span_ref", "ordinal", "content_hash"]
        there = keep(stay.join(about, "document_ref", "left_semi").select(*shape).unionByName(fresh.select(*shape)))
        known = old("mentions").join(dead, "span_ref", "left_anti").join(there.select("span_ref"), "span_ref", "left_semi").select(*mentions.columns).unionByName(mentions)
        order = ["work_ref", "document_ref", "source_ordinal"]
        papers = old("documents").join(gone, "document_ref", "left_anti").join(about, "document_ref", "left_semi").select(*order).unionByName(stored.select(*order))
        edges, _ = graph.edge_tables(papers, there, None, known)
        end = F.lit(None).cast("string")
        for kind, column in REFERENCE_KINDS.items():
            end = F.when(F.col("kind") == kind, F.col(column)).otherwise(end)
        former = old("edges").withColumn("about", end).join(about, F.col("about") == F.col("document_ref"), "left_semi").drop("about")
        if now.select("kind").unionByName(was.select("kind")).filter("kind = 'Chapter'").limit(1).count():
            everywhere = stay.select("work_ref", "span_ref", "content_hash").unionByName(fresh.select("work_ref", "span_ref", "content_hash"))
            edges = edges.unionByName(graph.precedes_edges(entities, everywhere).select(*edges.columns))
            former = former.unionByName(old("edges").filter("kind = 'precedes'"))
        former = keep(former)
        compared = keep(keep_revision(edges, former, "edge_ref", ["span_ref", "evidence_hash", "valid_from_chapter", "valid_to_chapter"], revision))
        new = compared.filter(F.col("revision") == revision)
        lost = former.select("edge_ref").join(compared.filter(F.col("revision") < revision).select("edge_ref"), "edge_ref", "left_anti")
        _, evidence = graph.edge_tables(papers, again, None, mentions)
        save("edges", new)
        together(first("gone_edges", lost.unionByName(new.select("edge_ref")).distinct()), first("evidence", evidence))

    together(references, words)
    return made["touched"]


# Revisions -----------------------------------------------------------------------------------------------------------


def unreadable(e: Exception) -> bool:
    """Whether an error says that a file of the index is not there, or is not what it was."""
    return any(x in str(e) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER", "FileNotFoundException", "is not a Parquet file", "INDEX_MISSING: the index has no table"))


def damaged(spark: SparkSession, held: dict) -> list[str]:
    """Tables of a revision that are not there, or not whole, as far as a listing shows."""
    return [f"{s['path']}/{n}" for s in held["segments"] for n in s["tables"] if "_SUCCESS" not in storage.names(spark, f"{s['path']}/{n}")]


def valid_revisions(spark: SparkSession, root: str) -> list[int]:
    return [int(n.removesuffix(".json")) for n in storage.names(spark, f"{root}/valid") if n[:1].isdigit() and n.endswith(".json")]


def current_revision(spark: SparkSession, root: str) -> dict | None:
    valid = valid_revisions(spark, root)
    if not valid:
        return None
    found = storage.get(spark, f"{root}/valid/{max(valid):012d}.json")
    if found["schema_version"] != SCHEMA_VERSION:
        raise ValueError("INDEX_SCHEMA_INCOMPATIBLE: rebuild the index")
    return found


@dataclass
class WriterLock:
    """The lease of one writer for an index.

    Holders are numbered, each by a file under ``<root>/fence`` that only one can create; the greatest number holds the
    index.  Its holder renews the file every third of ``LEASE_SECONDS``; when it has not for as long, when its process is
    gone (on this host), or when it has let go, the next writer takes the next number.
    """

    spark: SparkSession
    root: str
    token: int = 0
    _stop: threading.Event = field(default_factory=threading.Event)

    def _path(self, token: int) -> str:
        return f"{self.root}/fence/{token:012d}"

    def _mine(self, **more: object) -> dict:
        return {"pid": os.getpid(), "host": socket.gethostname(), "at": time.time(), "free": False} | more

    def __enter__(self) -> WriterLock:
        last = last_token(self.spark, self.root)
        if last and alive(self.spark, self.root, last):
            raise ValueError("INDEX_BUSY: another writer holds the index")
        try:
            storage.put(self.spark, self._path(last + 1), self._mine())
        except Exception as e:
            if "AlreadyExists" not in str(e):  # Hadoop's own exception, by name
                raise
            raise ValueError("INDEX_BUSY: another writer holds the index") from e
        self.token = last + 1
        for n in storage.names(self.spark, f"{self.root}/fence"):
            if n.isdigit() and int(n) < last:  # the last one stays: numbers only rise
                storage.delete(self.spark, f"{self.root}/fence/{n}")
        threading.Thread(target=self._renew, daemon=True).start()
        return self

    def _renew(self) -> None:
        while not self._stop.wait(LEASE_SECONDS / 3):
            if not self.held():
                return
            storage.put(self.spark, self._path(self.token), self._mine(), overwrite=True)

    def held(self) -> bool:
        """Whether no later writer has taken over."""
        return last_token(self.spark, self.root) == self.token

    def check(self) -> None:
        if not self.held():
            raise ValueError("INDEX_FENCED: another writer has taken over this index")

    def __exit__(self, *_: object) -> None:
        self._stop.set()
        if self.held():
            storage.put(self.spark, self._path(self.token), self._mine(free=True), overwrite=True)


def last_token(spark: SparkSession, root: str) -> int:
    return max((int(n) for n in storage.names(spark, f"{root}/fence") if n.isdigit()), default=0)


def alive(spark: SparkSession, root: str, token: int) -> bool:
    """Whether the holder of a number still works, as far as its file says."""
    try:
        holder = storage.get(spark, f"{root}/fence/{token:012d}")
    except ValueError:  # being written just now
        return True
    except Exception as e:
        if "FileNotFound" not in str(e):
            raise
        return False
    here = holder["host"] == socket.gethostname()
    if holder["free"] or (here and holder["pid"] != os.getpid() and not os.path.exists(f"/proc/{holder['pid']}")):
        return False
    return time.time() - holder["at"] <= LEASE_SECONDS


def _folders(found: dict) -> set[str]:
    return {os.path.basename(s["path"]) for s in found["segments"]}


def recover(spark: SparkSession, root: str) -> int:
    """Delete what dead writers and old revisions left; the number of folders.  The draft of a live writer stays."""
    valid = valid_revisions(spark, root)
    keep = set().union(*(_folders(storage.get(spark, f"{root}/valid/{n:012d}.json")) for n in valid[-KEPT_REVISIONS:]))
    token = last_token(spark, root)
    live = token if token and alive(spark, root, token) else None
    gone = [n for n in storage.names(spark, root) if n.startswith("rev=") and n not in keep and (live is None or n.split("-")[1] != str(live))]
    for n in valid[:-KEPT_REVISIONS]:
        storage.delete(spark, f"{root}/valid/{n:012d}.json")
    for n in gone:
        storage.delete(spark, f"{root}/{n}")
    return len(gone)


def interrupted(spark: SparkSession, root: str) -> bool:
    """Whether a writer died here: a draft that no revision has and no live writer holds."""
    valid = valid_revisions(spark, root)
    known = set().union(*(_folders(storage.get(spark, f"{root}/valid/{n:012d}.json")) for n in valid))
    token = last_token(spark, root)
    live = token if token and alive(spark, root, token) else None
    return any(n.startswith("rev=") and n not in known and (live is None or n.split("-")[1] != str(live)) for n in storage.names(spark, root))


@dataclass
class Draft:
    """A revision that is being written; nobody sees it before ``commit``.

    ``after``: segments that stay before it (none: it is whole by itself); ``lock``: the lease it is written under.
    """

    spark: SparkSession
    root: str
    after: list[dict] = field(default_factory=list)
    lock: WriterLock | None = None
    revision: int = 0
    at: str = ""
    totals: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        before = current_revision(self.spark, self.root)
        self.revision = (before["revision"] if before else 0) + 1
        self.at = f"{self.root}/rev={self.revision}-{self.lock.token if self.lock else 0}-{uuid.uuid4().hex[:8]}"

    def save(self, name: str, df: DataFrame) -> DataFrame:
        """Write a table and read it back.  Tables in ``ORDERED`` are sorted by their key, in small row groups, so a read
        by key opens few of them; a segment after others is small, and is sorted as it lies.  Names with an underscore are
        for the writer only."""
        key, path = ORDERED.get(name), f"{self.at}/{name}"
        if key:
            df = df.sortWithinPartitions(key) if self.after else df.repartitionByRange(key).sortWithinPartitions(key)
        (df.write.option("parquet.block.size", str(4 << 20)) if key else df.write).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _check(self, checks: dict[str, str], segs: list[dict]) -> None:
        """Of the keys that were written, none may stand twice in its table."""
        found = []
        for name, key in checks.items():
            rows = segments.read(self.spark, segs, name).select(F.col(key).alias("key"))
            if self.after:
                rows = rows.join(self.spark.read.parquet(f"{self.at}/{name}").select(F.col(key).alias("key")).distinct(), "key", "left_semi")
            found.append(rows.select(F.lit(f"{name}.{key}").alias("name"), "key"))
        if found:
            rows = found[0]
            for f in found[1:]:
                rows = rows.unionByName(f)
            twice = rows.groupBy("name", "key").agg((F.count("*") - 1).alias("n")).filter("n > 0").groupBy("name").agg(F.sum("n").alias("n")).orderBy("name").first()
            if twice:
                storage.delete(self.spark, self.at)
                raise ValueError(f"INDEX_VALIDATION_FAILED: {twice['name']} repeats {twice['n']} times")

    def commit(self, stats: dict | None = None, checks: dict[str, str] | None = None) -> int:
        """Validate what was written, then make it the current revision; a failed check leaves the old one in place.

        checks: table -> column that must be a key.
        """
        spark, root = self.spark, self.root
        written = storage.names(spark, self.at)
        rows = self.totals.pop("rows", None)
        segs = [*self.after, {"path": self.at, "tables": [n for n in written if not n.startswith("_")], "rows": rows if rows is not None else self.rows()}]
        segs[-1]["gone"] = segments.few(spark, self.at, segs[-1]["tables"])
        self._check(checks or {}, segs)
        for name in written:
            if name.startswith("_"):
                storage.delete(spark, f"{self.at}/{name}")
        made = {"revision": self.revision, "path": self.at, "segments": segs, "schema_version": SCHEMA_VERSION, "stats": stats or {}, "search": self.totals}
        fresh = f"{root}/valid/new-{uuid.uuid4().hex[:8]}"
        if self.lock:
            self.lock.check()
        storage.put(spark, fresh, made)
        if not storage.move(spark, fresh, f"{root}/valid/{self.revision:012d}.json"):
            storage.delete(spark, fresh)
            storage.delete(spark, self.at)
            raise ValueError("INDEX_BUSY: another writer published this revision")
        return self.revision

    def rows(self) -> int:
        """The size of the segment, in spans."""
        return self.spark.read.parquet(f"{self.at}/spans").count() if "spans" in storage.names(self.spark, self.at) else 0


def compact(spark: SparkSession, root: str, lock: WriterLock | None = None) -> int:
    """Put the segments of the current revision together, as the next revision; its rows are the same."""
    held = current_revision(spark, root)
    draft = Draft(spark, root, lock=lock)
    names = sorted({n for s in held["segments"] for n in s["tables"] if not n.startswith("gone_")})
    together(*[lambda n=n: draft.save(n, segments.read(spark, held["segments"], n)) for n in names])
    draft.totals = dict(held["search"])
    return draft.commit(held["stats"] | {"compacted": len(held["segments"])})


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], stats: dict | None = None, checks: dict[str, str] | None = None) -> int:
    """Write ``tables`` as the next revision (see :class:`Draft`)."""
    draft = Draft(spark, root)
    for name, df in tables.items():
        draft.save(name, df)
    return draft.commit(stats, checks)


def read_table(spark: SparkSession, root: str, name: str, held: dict | None = None) -> DataFrame:
    held = held or current_revision(spark, root)
    if held is None:
        raise ValueError("INDEX_MISSING")
    return segments.read(spark, held["segments"], name)


def remove_index(spark: SparkSession, root: str, active_captures: int = 0) -> bool:
    """Delete all derived data of a work, unless a capture of it is still active."""
    if active_captures:
        raise ValueError("DERIVED_DATA_BUSY: finish the captures of this work first")
    return storage.delete(spark, root)
