"""The five tools: resolve, index, explore, context, diagnose; one object for a work, one for all of them.

``Work`` reads and writes one index.  What a read returns is bounded, so it is held as local rows, keyed by revision and
arguments; an equal call on an unchanged index starts no job.  ``Service`` adds what callers meet: authorised roots,
adapters, deadlines, size caps, recovery texts, and the event log.
"""

from __future__ import annotations

import os
import threading
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.text import estimate_tokens
from loomtext.operators import context as packets
from loomtext.operators import batch_search, evidence, explore, indexing, limits
from loomtext.operators.captures import Recorder
from loomtext.operators.search import PRODUCTION, Index, search
from loomtext.sources import adapters as sources
from loomtext.sources import storage

# Fixed values.
DEADLINE_SECONDS, MAX_QUERY, RESULTS_HELD = 30, 2048, 128
OPERATIONS = ("search", "entity", "neighborhood", "timeline", "document", "stats")
MODES = ("status", "incremental", "rebuild")
RECOVERY = {
    "WORK_REF_NOT_FOUND": "resolve the source again", "UNSUPPORTED_SOURCE": "give a Markdown, text, EPUB or project path", "INDEX_BUSY": "try again when the other writer is done",
    "INDEX_MISSING": "index the work first", "INDEX_SCHEMA_INCOMPATIBLE": "rebuild the index", "QUERY_TOO_LARGE": "shorten the query", "PATH_NOT_ALLOWED": "choose a path under an authorised root",
    "INDEX_FENCED": "try again: another writer took over", "INDEX_RECOVERY_REQUIRED": "index the work again", "SOURCE_CHANGED_DURING_READ": "try again when the sources are at rest", "TIME_LIMIT_EXCEEDED": "ask for less, or try again",
}
PACKET = "status string, budget_tokens int, used_tokens long, blocks array<string>, omitted array<struct<ref:string,reason:string,tokens:long>>, task_type string"
KEYS = {"documents": "document_ref", "spans": "span_ref", "entities": "entity_ref", "mentions": "mention_ref", "edges": "edge_ref"}
TABLES = ("documents", "spans", "definitions", "entities", "aliases", "mentions", "edges", "evidence", "unresolved")


class Result(NamedTuple):
    """Rows of a read, in order, and what is to be said about them."""

    rows: DataFrame
    diagnostics: list[dict]
    ambiguous: DataFrame
    metrics: dict
    local: list[Row]  # the same rows, on the driver


def within(roots: list[str], path: str) -> str:
    """The real path, if it lies under an authorised root."""
    if not roots:
        raise PermissionError("AUTHORIZED_ROOTS_REQUIRED")
    real = os.path.realpath(path)
    if not any(os.path.commonpath([real, os.path.realpath(r)]) == os.path.realpath(r) for r in roots):
        raise PermissionError("PATH_NOT_ALLOWED")
    return real


def timed(spark: SparkSession, tag: str, work: Callable[[], Any], seconds: float | None = DEADLINE_SECONDS) -> Any:  # noqa: ANN401
    """Run ``work`` under a tag whose jobs a timer cancels; a call that ends late all the same is an error too.  Without
    ``seconds`` it may take as long as it takes."""
    if seconds is None:
        return work()
    context = spark.sparkContext
    context.addJobTag(tag)
    late = threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    timer.start()
    try:
        made = work()
        if late.is_set():
            raise TimeoutError(f"TIME_LIMIT_EXCEEDED: {tag} took more than {seconds} seconds")
        return made
    except TimeoutError:
        raise
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"TIME_LIMIT_EXCEEDED: {tag} took more than {seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)


@dataclass
class Work:
    """One indexed work: its tables, by revision, and reads over them."""

    spark: SparkSession
    root: str
    held: dict[str, Any] = field(default_factory=dict)
    manifest: dict | None = None
    seen: list | None = None
    results: OrderedDict = field(default_factory=OrderedDict)

    def __post_init__(self) -> None:
        self.spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", "1024")  # lists of chosen rows reach the scan

    # Writing ---------------------------------------------------------------------------------------------------------

    def _state(self) -> dict | None:
        """The current revision; tables and results of another one are forgotten."""
        stamps = storage.stamps(self.spark, f"{self.root}/valid")
        if stamps != self.seen:
            found = indexing.current_revision(self.spark, self.root)
            self.manifest, self.seen = found, stamps
            self.held.clear()
            self.results.clear()
        return self.manifest

    def status(self, documents: DataFrame) -> dict:
        """Whether the index is of ``documents`` (with hashes), and whole; nothing is written."""
        state = self._state()
        notes = []
        if indexing.interrupted(self.spark, self.root) or (state and indexing.damaged(self.spark, state)):
            notes.append({"code": "INDEX_RECOVERY_REQUIRED"})
        if state and any("/documents" in p for p in (indexing.damaged(self.spark, state) if notes else [])):
            return {"freshness": "stale", "revision": state["revision"], "diagnostics": notes}
        freshness = indexing.freshness(documents, self.table("documents") if state else None)
        if state and notes and indexing.damaged(self.spark, state):
            freshness = "stale"
        notes += [{"code": "INDEX_SOURCE_CHANGED"}] if freshness == "stale" else []
        return {"freshness": freshness, "revision": state["revision"] if state else 0, "diagnostics": notes}

    def index(self, documents: DataFrame, mode: str = "incremental", source: str | None = None) -> dict:
        """status, incremental or rebuild.  Nothing is published when nothing changed; a change derives only what it touches
        (``derived_spans`` spans).  An index of another schema, or a damaged one, is rebuilt.  source: the fingerprint of
        what ``documents`` were read from."""
        if mode not in MODES:
            raise ValueError(f"INVALID_MODE: {mode}")
        documents = documents.withColumn("content_hash", F.sha2("content", 256))
        documents = documents.withColumn("semantic_hash", indexing.semantic_hash(documents))
        if mode == "status":
            return self.status(documents)
        notes = []
        with indexing.WriterLock(self.spark, self.root) as lock:
            try:
                state = self._state()
            except ValueError as e:
                if "INDEX_SCHEMA_INCOMPATIBLE" not in str(e):
                    raise
                for name in storage.names(self.spark, self.root):
                    if name != "fence":
                        storage.delete(self.spark, f"{self.root}/{name}")
                state, notes = self._state(), [{"code": "INDEX_SCHEMA_REBUILT"}]
            if state and mode == "incremental" and indexing.damaged(self.spark, state):
                mode, notes = "rebuild", [*notes, {"code": "INDEX_RECOVERED"}]
            out = self._changed(documents, state, lock) if state and mode == "incremental" else self._rebuilt(documents, lock)
            if source:
                storage.put(self.spark, f"{self.root}/source.json", {"source": source}, overwrite=True)
            indexing.recover(self.spark, self.root)
        self._state()
        return out | {"freshness": "fresh", "diagnostics": notes}

    def source(self) -> str | None:
        """The fingerprint of the sources that the index was last brought up to date with."""
        try:
            return storage.get(self.spark, f"{self.root}/source.json")["source"] if "source.json" in storage.names(self.spark, self.root) else None
        except ValueError:  # being written
            return None

    def _rebuilt(self, documents: DataFrame, lock: indexing.WriterLock) -> dict:
        draft = indexing.Draft(self.spark, self.root, lock=lock)
        spans = indexing.derive(documents, draft)
        counted = dict.fromkeys(("added", "updated", "deleted", "skipped"), 0) | {"added": self.spark.read.parquet(f"{draft.at}/documents").count()}
        return {"revision": draft.commit(counted | {"derived_spans": spans}, KEYS), "stats": counted, "derived_spans": spans}

    def _changed(self, documents: DataFrame, state: dict, lock: indexing.WriterLock) -> dict:
        draft = indexing.Draft(self.spark, self.root, state["segments"], lock)
        changes = draft.save("_changes", indexing.diff(documents, self.table("documents")).filter("status <> 'skipped'"))
        found = {r["status"]: r["count"] for r in changes.groupBy("status").count().collect()}
        counted = {k: found.get(k, 0) for k in ("added", "updated", "deleted")}
        counted["skipped"] = documents.count() - counted["added"] - counted["updated"]
        if not found:
            storage.delete(self.spark, draft.at)
            return {"revision": state["revision"], "stats": counted, "derived_spans": 0}
        spans = indexing.derive_change(documents, changes, self.table, state["search"], draft)
        revision = draft.commit(counted | {"derived_spans": spans}, KEYS)
        if indexing.segments.due(indexing.current_revision(self.spark, self.root)["segments"]):
            revision = indexing.compact(self.spark, self.root, lock)
        return {"revision": revision, "stats": counted, "derived_spans": spans}

    # Reading -----------------------------------------------------------------------------------------------------------

    def table(self, name: str) -> DataFrame:
        if name not in self.held:
            self.held[name] = indexing.read_table(self.spark, self.root, name, self.manifest)
        return self.held[name]

    def tables(self) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in TABLES}

    def rows(self) -> DataFrame:
        """Spans with what their documents say."""
        return self.table("spans").withColumnsRenamed({f"doc_{c}": c for c in indexing.CARRIED})

    def search_index(self) -> Index:
        if "index" not in self.held:
            totals = self.manifest["search"]
            self.held["index"] = Index(self.table("postings"), self.table("terms"), totals["spans"], totals["trigrams"] / max(1, totals["spans"]))
        return self.held["index"]

    def searched(self, query: str, limit: int, config: dict | None = PRODUCTION) -> tuple[DataFrame, list[dict]]:
        """Ranked rows through the published index; where that is missing or damaged, by a scan of the spans, which a
        diagnostic says."""
        rows, aliases = self.rows(), self.table("aliases")
        try:
            return search(rows, query, limit, config, aliases, index=self.search_index())
        except Exception as e:
            if not indexing.unreadable(e):
                raise
            for name in ("index", "postings", "terms"):
                self.held.pop(name, None)
            found, notes = search(rows, query, limit, config, aliases)
            return found, [*notes, {"code": "FTS_DEGRADED"}]

    def search_many(self, queries: DataFrame, limit: int = 20, config: dict | None = PRODUCTION, disabled: frozenset[str] = frozenset()) -> DataFrame:
        """queries(query_id, query): all of them searched at once through the published index."""
        if self._state() is None:
            raise ValueError("INDEX_MISSING")
        return batch_search.search_many(queries, self.rows(), self.search_index(), limit, config, self.table("aliases"), disabled)

    def _held(self, key: tuple, make: Callable[[], Any]) -> Any:  # noqa: ANN401
        """The result of an equal call on this revision, or a new one; the least recently used goes first."""
        state = self._state()
        if state is None:
            raise ValueError("INDEX_MISSING")
        key = (state["revision"], *key)
        if key not in self.results:
            try:
                self.results[key] = make()
            except Exception as e:
                if not indexing.unreadable(e):
                    raise
                raise ValueError(f"INDEX_RECOVERY_REQUIRED: {indexing.damaged(self.spark, state) or self.root}") from e
            while len(self.results) > RESULTS_HELD:
                self.results.popitem(last=False)
        self.results.move_to_end(key)
        return self.results[key]

    def _local(self, df: DataFrame) -> DataFrame:
        """A bounded result as local rows: reading it again starts no job."""
        return self.spark.createDataFrame(df.collect(), df.schema)

    def explore(self, operation: str, query: str = "", limit: int = 20, max_hops: int = 2, target_chapter: int | None = None) -> Result:
        if operation not in OPERATIONS:
            raise ValueError(f"unknown operation {operation}")
        if len(query) > MAX_QUERY:
            raise ValueError("QUERY_TOO_LARGE")
        limit = explore.clamp_limit(limit)
        return self._held((operation, query, limit, max_hops, target_chapter), lambda: self._explored(operation, query, limit, max_hops, target_chapter))

    def _explored(self, operation: str, query: str, limit: int, max_hops: int, target_chapter: int | None) -> Result:
        began = time.monotonic()
        rows, notes, other, more = self._read(operation, query, limit, max_hops, target_chapter)
        schema, held = rows.schema, rows.collect()
        rows = self.spark.createDataFrame(held, schema)
        other = self.spark.createDataFrame([], "ref string") if other is None else self._local(other.limit(limit))
        n = len(held)
        metrics = {"candidate_count": n, "returned_count": n, "visited_nodes": n, "max_actual_hops": 0, "omitted_estimate": 0} | more
        return Result(rows, notes, other, metrics | {"elapsed_ms": round(1000 * (time.monotonic() - began), 3)}, held)

    def _read(self, operation: str, query: str, limit: int, max_hops: int, target_chapter: int | None) -> tuple[DataFrame, list[dict], DataFrame | None, dict]:
        if operation == "search":
            found, notes = self.searched(query, limit)
            return found, notes, None, {}
        tables = self.tables()
        if operation == "entity":
            found, other, notes = explore.entity_lookup(tables, query, limit)
            return found, notes, other, {}
        if operation == "neighborhood":
            return self._neighbours(tables, query, limit, max_hops)
        if operation == "timeline":
            places = explore.chapter_positions(tables["documents"])
            chapters = tables["entities"].filter("kind = 'Chapter'").select("document_ref", F.col("entity_ref").alias("ref"))
            positions = places.join(chapters, "document_ref").select("ref", "position")
            shape = [F.col("valid_from_chapter").alias("valid_from"), F.col("valid_to_chapter").alias("valid_to")]
            items = tables["entities"].select(F.col("entity_ref").alias("ref"), F.col("name").alias("heading"), "kind", "span_ref", *shape, "narrative_time")
            links = explore.named_edges(tables["edges"].filter("kind = 'precedes'"), tables["entities"]).select(F.col("edge_ref").alias("ref"), F.concat_ws(" → ", "source_name", "target_name").alias("heading"), "kind", "span_ref", *shape, F.lit(None).cast("string").alias("narrative_time"))
            found = explore.timeline(items.unionByName(links), positions, query, target_chapter, limit)
            return found, [{"code": "TIMELINE_PROJECTION"}], None, {}
        if operation == "document":
            return explore.document_lookup(self.rows(), query, limit=limit), [], None, {}
        return explore.corpus_stats(tables), [], None, {}

    def _neighbours(self, tables: dict[str, DataFrame], query: str, limit: int, max_hops: int) -> tuple[DataFrame, list[dict], DataFrame | None, dict]:
        found, other, notes = explore.entity_lookup(tables, query, limit)
        seeds = found.select(F.col("entity_ref").alias("ref"))
        direct = explore.resolve_nodes(self.spark.createDataFrame([(query,)], "ref string"), tables).select("ref")
        if direct.take(1):
            seeds, notes = direct, []
        if any(n["code"] == "AMBIGUOUS_ENTITY" for n in notes):
            return found, notes, other, {}
        refs = tables["entities"].select(F.col("entity_ref").alias("ref")).unionByName(tables["spans"].select(F.col("span_ref").alias("ref"))).unionByName(tables["documents"].select(F.col("document_ref").alias("ref")))
        walked, omitted = explore.neighborhood_counted(tables["edges"], seeds, max_hops, refs)
        hops = walked.agg(F.count("*").alias("n"), F.max("hop").alias("hops")).first()
        return walked.limit(limit), notes, other, {"candidate_count": hops["n"], "visited_nodes": hops["n"], "max_actual_hops": hops["hops"] or 0, "omitted_estimate": max(0, hops["n"] - limit) + omitted}

    def items(self, operation: str, result: Result) -> DataFrame:
        """The result's rows as items with evidence, in order (``place``)."""
        spans = self.rows()
        order = self.spark.createDataFrame([(k, r) for k, r in enumerate(self._refs(operation, result))], "place int, ref string")
        if operation in ("search", "document"):
            extra = [c for c in ("score", "excerpt", "pieces", "trust") if c in result.rows.columns]
            found = result.rows.select(F.col("span_ref").alias("ref"), F.lit("span").alias("kind"), F.col("heading").alias("title"), "content", "document_ref", "relative_path", "start_line", "end_line", *extra)
            more = self.table("documents").select("document_ref", *(c for c in ("segments", "source_start_line") if c in self.table("documents").columns))
            found = found.join(F.broadcast(more.join(F.broadcast(found.select("document_ref").distinct()), "document_ref", "left_semi")), "document_ref")
            if "trust" in found.columns:
                found = found.withColumn("source_kind", F.col("trust"))
        elif operation == "stats":
            counts = F.to_json(F.struct(*result.rows.columns))
            found = result.rows.select(F.lit("stats").alias("ref"), F.lit("stats").alias("kind"), F.lit("stats").alias("title"), counts.alias("content"), F.lit("").alias("document_ref"), F.lit("").alias("relative_path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))
        else:
            if operation == "timeline":
                at = result.rows.select("ref", "kind", F.col("heading").alias("title"), "span_ref")
            elif operation == "entity" or "entity_ref" in result.rows.columns:
                at = result.rows.select(F.col("entity_ref").alias("ref"), "kind", F.col("name").alias("title"), "span_ref", "score", "source_kind", "confidence")
            else:
                named = explore.resolve_nodes(result.rows.select("ref"), self.tables())
                at = named.select("ref", F.col("node_kind").alias("kind"), F.col("heading").alias("title"), "span_ref").join(result.rows.select("ref", "score", "hop", "path", "via"), "ref")
            more = [c for c in ("segments", "source_start_line") if c in self.table("documents").columns]
            found = at.join(spans.drop("kind", "title", "heading", "ordinal"), "span_ref").join(self.table("documents").select("document_ref", *more), "document_ref")
        shaped = evidence.items(found, self.manifest["revision"])
        return shaped.join(F.broadcast(order), "ref").orderBy("place")

    @staticmethod
    def _refs(operation: str, result: Result) -> list[str]:
        if operation == "stats":
            return ["stats"]
        column = next(c for c in ("span_ref" if operation in ("search", "document") else "ref", "entity_ref") if c in result.rows.columns)
        return [r[0] for r in result.rows.select(column).collect()]

    def context(self, query: str, budget: int, **options: Any) -> DataFrame:  # noqa: ANN401
        """:meth:`packet` as a table of one row."""
        return self._held(("table", query, budget, repr(sorted(options.items()))), lambda: self.spark.createDataFrame([self.packet(query, budget, **options)], PACKET))

    def packet(self, query: str, budget: int, required: list[str] = (), excluded: list[str] = (), pinned: list[str] = (), target_chapter: int | None = None, entity_refs: list[str] = (), document_refs: list[str] = (), task_type: str | None = None) -> Row:
        """The packet.  Pinned references are entities and documents that should be in it; ``task_type`` is kept with the
        packet and changes nothing."""
        packets.check_request(budget, list(required), list(excluded), list(pinned), list(entity_refs), list(document_refs))
        pins = tuple(dict.fromkeys([*pinned, *entity_refs, *document_refs]))
        key = ("context", query, budget, tuple(required), tuple(excluded), pins, target_chapter, task_type)
        return self._held(key, lambda: self._packed(query, budget, list(required), list(excluded), list(pins), target_chapter).withColumn("task_type", F.lit(task_type).cast("string")).first())

    def _packed(self, query: str, budget: int, required: list[str], excluded: list[str], pins: list[str], target_chapter: int | None) -> DataFrame:
        tables = self.tables()
        places = explore.chapter_positions(tables["documents"]).select("document_ref", "position")
        result = self.explore("search", query, packets.SEARCH_LIMIT)
        found = result.rows
        if "excerpt" not in found.columns:  # the query had no terms
            found = found.withColumns({"excerpt": F.lit(""), "score": F.lit(0.0)})
        shape = ["ref", "kind", "score", "tokens", "evidence_hash", "position"]
        found = found.join(places, "document_ref", "left").select(F.col("span_ref").alias("ref"), "kind", "score", estimate_tokens(F.col("excerpt")).alias("tokens"), F.sha2("excerpt", 256).alias("evidence_hash"), "position")
        asked = list(dict.fromkeys([*required, *pins]))
        if asked:
            wanted = self.spark.createDataFrame([(r,) for r in asked], "ref string")
            nodes = explore.resolve_nodes(wanted, tables).join(tables["spans"].select("span_ref", "document_ref", F.left("content", F.lit(900)).alias("excerpt")), "span_ref").join(places, "document_ref", "left")
            direct = nodes.select("ref", F.col("node_kind").alias("kind"), F.lit(1.0).alias("score"), estimate_tokens(F.col("excerpt")).alias("tokens"), F.sha2("excerpt", 256).alias("evidence_hash"), "position")
        else:
            direct = found.limit(0)
        return packets.assemble(self._local(found.select(*shape)), self._local(direct.select(*shape)), budget, required, excluded, pins, target_chapter)


@dataclass
class Service:
    """All works under the authorised roots: paths become works, calls are timed, capped and recorded."""

    spark: SparkSession
    home: str
    roots: list[str]
    adapters: list[sources.Adapter] = field(default_factory=lambda: [sources.TextAdapter()])
    candidates: dict[str, sources.Candidate] = field(default_factory=dict)
    works: dict[str, Work] = field(default_factory=dict)
    deadline: float = DEADLINE_SECONDS
    cap: int = limits.RESPONSE_BYTES

    def recorder(self, work_ref: str) -> Recorder:
        return Recorder(self.spark, f"{self.home}/diagnostics/{work_ref.replace(':', '-')}", work_ref)

    def work(self, work_ref: str) -> Work:
        if work_ref not in self.candidates:
            raise ValueError(f"WORK_REF_NOT_FOUND: {work_ref}")
        if work_ref not in self.works:
            self.works[work_ref] = Work(self.spark, f"{self.home}/index/{work_ref.replace(':', '-')}")
        return self.works[work_ref]

    def _adapter(self, candidate: sources.Candidate) -> sources.Adapter:
        return next(a for a in self.adapters if a.name == candidate.adapter)

    def _called(self, tool: str, work_ref: str | None, given: dict, run: str | None, make: Callable[[], dict], unhurried: bool = False) -> dict:
        """One call: under the deadline (unless ``unhurried``), within the byte cap, and in the log of its work."""
        began = time.monotonic()
        try:
            out = limits.fit(tool, evidence.without_paths(timed(self.spark, f"{tool}-{threading.get_ident()}", make, None if unhurried else self.deadline)), self.cap)
        except Exception as e:
            code = str(e).partition(":")[0]
            if work_ref in self.candidates:
                self.recorder(work_ref).record(tool, "failure", given, None, 1000 * (time.monotonic() - began), code, run)
            if code in RECOVERY:
                e.add_note(f"recovery: {RECOVERY[code]}")
            raise
        if work_ref in self.candidates:
            self.recorder(work_ref).record(tool, "success", given, out, 1000 * (time.monotonic() - began), None, run, out.get("revision"))
        return out

    def resolve(self, path: str, hint: str | None = None) -> dict:
        def make() -> dict:
            found = sources.resolve(self.spark, within(self.roots, path), self.adapters, hint)
            self.candidates |= {c.work_ref: c for c in found["candidates"]}
            return found | {"candidates": [{"work_ref": c.work_ref, "adapter": c.adapter, "title": c.title, "sourcePath": c.path} for c in found["candidates"]]}

        return self._called("resolve", None, {"path": path, "adapter_hint": hint}, None, make)

    def index(self, work_ref: str, mode: str = "incremental", run: str | None = None) -> dict:
        work = self.work(work_ref)

        return self._called("index", work_ref, {"work_ref": work_ref, "mode": mode}, run, lambda: self._indexed(work_ref, mode), unhurried=True)

    def _indexed(self, work_ref: str, mode: str) -> dict:
        candidate = self.candidates[work_ref]
        documents, fingerprint = sources.load_consistent(self.spark, self._adapter(candidate), candidate)
        try:
            return {"work_ref": work_ref, **self.work(work_ref).index(documents, mode, fingerprint)}
        finally:
            documents.unpersist()

    def ensure_fresh(self, work_ref: str) -> str:
        """Index again if the sources are not as they were indexed, by a listing; what the index is then."""
        work, candidate = self.work(work_ref), self.candidates[work_ref]
        now = self._adapter(candidate).snapshot(self.spark, candidate)
        if work.source() != now:
            self._indexed(work_ref, "incremental")
        return "fresh" if work.source() == now else "stale"

    def explore(self, work_ref: str, operation: str, query: str = "", limit: int = 20, max_hops: int = 2, target_chapter: int | None = None, run: str | None = None) -> dict:
        work, freshness = self.work(work_ref), self.ensure_fresh(work_ref)

        def make() -> dict:
            result = work.explore(operation, query, limit, max_hops, target_chapter)
            results = [r["item"].asDict(True) for r in work.items(operation, result).select("item").collect()]
            return {
                "work_ref": work_ref, "revision": work.manifest["revision"], "freshness": freshness, "operation": operation, "results": results,
                "ambiguous": [r.asDict(True) for r in result.ambiguous.collect()], "truncated": False, "metrics": dict(result.metrics), "diagnostics": list(result.diagnostics),
            }

        return self._called("explore", work_ref, {"work_ref": work_ref, "operation": operation, "query": query, "limit": limit}, run, make)

    def context(self, work_ref: str, query: str, budget: int, run: str | None = None, **options: Any) -> dict:  # noqa: ANN401
        """A packet with the excerpts of its blocks; what does not fit the byte cap is omitted as ``response_limit``."""
        work, freshness = self.work(work_ref), self.ensure_fresh(work_ref)

        def make() -> dict:
            packet = work.packet(query, budget, **options)
            details = packets.block_details(work, packet, query, list(options.get("required", ())))
            kept = limits.reduce_context(details, limits.json_bytes(F.struct(*details.columns)), self.cap - 4096, ["one"]).orderBy("place").collect()
            gone = {r["ref"]: r["tokens"] for r in kept if not r["returned"]}
            blocks = [r.asDict(True) for r in details.join(F.broadcast(self.spark.createDataFrame([(r["ref"],) for r in kept if r["returned"]], "ref string")), "ref").drop("one").orderBy("place").collect()]
            omitted = [o.asDict() for o in packet["omitted"] if o["ref"] not in gone] + [{"ref": k, "reason": "response_limit", "tokens": v} for k, v in gone.items()]
            status = "truncated" if gone and packet["status"] == "complete" else packet["status"]
            return {"work_ref": work_ref, "revision": work.manifest["revision"], "freshness": freshness, "status": status, "budget_tokens": budget, "used_tokens": sum(b["tokens"] for b in blocks), "blocks": blocks, "omitted": omitted, "task_type": packet["task_type"], "estimated": True}

        return self._called("context", work_ref, {"work_ref": work_ref, "query": query, "budget_tokens": budget}, run, make)

    def diagnose(self, work_ref: str, action: str = "inspect", run: str | None = None, **options: Any) -> dict:  # noqa: ANN401
        recorder = self.recorder(self.work(work_ref) and work_ref)
        if action == "start":
            return {"diagnostic_run_ref": recorder.start_capture(**options)}
        if action == "finish":
            return evidence.without_paths(recorder.finish_capture(run or "", **options))
        if action != "inspect":
            raise ValueError(f"INVALID_DIAGNOSTIC_REQUEST: {action}")
        return limits.fit("diagnose", recorder.inspect(**options), self.cap)

    def remove(self, work_ref: str) -> bool:
        """Delete the derived data of a work, unless a capture is active."""
        done = indexing.remove_index(self.spark, self.work(work_ref).root, self.recorder(work_ref).active())
        self.works.pop(work_ref, None)
        return done
