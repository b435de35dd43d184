"""Entities, aliases, mentions, edges and evidence from spans and documents.

documents: work_ref, document_ref, relative_path, title, kind, source_ordinal.  spans: see :mod:`spans`.  Every result
has ``work_ref`` first; names never match across works.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.text import identity_hash, js_trim, normalize_name, stable_id

# What a document's kind makes of its headings, headings that name nobody, and heading markers.
KIND_OF_DOCUMENT = {"chapter": "Chapter", "outline": "OutlineNode", "state": "Fact", "foreshadow": "Foreshadow"}
NO_CHARACTER = "(?i)^(角色|人物|characters?)$"
MARKERS = {"Location": "地点|location", "Item": "物品|item", "Event": "事件|event"}
LINK = "\\[\\[([^\\[\\]\\n]{1,100})\\]\\]"
BROADCAST_NAMES, BROADCAST_NAME_CHARS = 200_000, 16 << 20


def definitions(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """One row for each heading that defines an entity."""
    rows = spans.join(documents.select("work_ref", "document_ref", F.col("kind").alias("document_kind"), "source_ordinal"), ["work_ref", "document_ref"])
    rows = rows.withColumn("heading", js_trim(F.regexp_replace("heading", "^#+\\s*", ""))).filter("heading <> ''")
    found: list[DataFrame] = []

    def take(part: DataFrame, kind: Column, name: Column, source: str, properties: Column) -> None:
        found.append(part.select("work_ref", "span_ref", "document_ref", "source_ordinal", F.col("ordinal").alias("span_ordinal"), "content", kind.alias("kind"), name.alias("name"), F.lit(source).alias("source_kind"), properties.alias("properties")))

    by_kind = F.create_map(*[F.lit(x) for pair in KIND_OF_DOCUMENT.items() for x in pair])
    take(rows.filter(F.col("document_kind").isin(*KIND_OF_DOCUMENT)), by_kind[F.col("document_kind")], F.col("heading"), "native", F.create_map(F.lit("documentKind"), F.col("document_kind")))
    none = F.create_map().cast("map<string,string>")
    take(rows.filter((F.col("document_kind") == "character") & ~F.col("heading").rlike(NO_CHARACTER)), F.lit("Character"), F.col("heading"), "native", none)
    for kind, marker in MARKERS.items():
        pattern = f"(?i)^(?:{marker})\\s*[:：]\\s*(.+)$"
        take(rows.filter(F.col("heading").rlike(pattern)), F.lit(kind), js_trim(F.regexp_extract("heading", pattern, 1)), "deterministic", F.create_map(F.lit("marker"), F.regexp_extract("heading", "^([^:：]*)", 1)))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    out = out.withColumn("normalized_name", normalize_name(F.col("name")))
    key = F.when(F.col("kind") == "Chapter", F.col("document_ref")).otherwise(F.col("normalized_name"))
    out = out.withColumn("entity_ref", stable_id("entity", F.col("work_ref"), F.col("kind"), key))
    return out.withColumns({"definition_ref": stable_id("entity-definition", F.col("entity_ref"), F.col("span_ref")), "evidence_hash": F.sha2("content", 256)}).drop("content")


def canonical_entities(defined: DataFrame) -> DataFrame:
    """The first definition of each entity, in source order."""
    first = F.min_by(F.struct("kind", "name", "normalized_name", "source_kind", "span_ref", "document_ref", "source_ordinal", "span_ordinal", "evidence_hash", "properties"), F.struct("source_ordinal", "span_ordinal", "definition_ref"))
    rows = defined.groupBy("work_ref", "entity_ref").agg(first.alias("d")).select("work_ref", "entity_ref", "d.*")
    chapter = F.when(F.col("kind") == "Chapter", F.col("entity_ref"))
    return rows.withColumns({"identity_hash": identity_hash(F.col("work_ref"), F.col("kind"), F.col("entity_ref")), "confidence": F.lit(1.0), "valid_from_chapter": chapter, "valid_to_chapter": chapter, "narrative_time": F.lit(None).cast("string")})


def aliases(entities: DataFrame) -> DataFrame:
    return entities.select("work_ref", "entity_ref", F.col("name").alias("alias"), F.col("normalized_name").alias("normalized_alias"))


def _content_hash(spans: DataFrame) -> Column:
    return F.col("content_hash") if "content_hash" in spans.columns else F.sha2("content", 256)


def alias_owners(known: DataFrame) -> DataFrame:
    """(work_ref, normalized_alias, owners, entity_ref): how many entities share an alias, and the first of them."""
    return known.groupBy("work_ref", "normalized_alias").agg(F.count("*").alias("owners"), F.min("entity_ref").alias("entity_ref"))


def orphans(edges: DataFrame, proof: DataFrame) -> DataFrame:
    """Edges that nothing is evidence of."""
    return edges.join(proof.select("edge_ref"), "edge_ref", "left_anti")


def contains_edges(spans: DataFrame) -> DataFrame:
    source, target = F.col("document_ref"), F.col("span_ref")
    return spans.select("work_ref", stable_id("edge", source, target, F.lit("contains")).alias("edge_ref"), source.alias("source_ref"), target.alias("target_ref"), F.lit("contains").alias("kind"), "span_ref", _content_hash(spans).alias("evidence_hash"), identity_hash(source, target, F.lit("contains")).alias("identity_hash"))


def occurrence_offsets(text: Column, name: Column) -> Column:
    """0-based offsets of the leftmost non-overlapping occurrences of ``name``: sums of the parts between them."""
    parts = F.split(text, F.concat(F.lit("\\Q"), name, F.lit("\\E")), -1)
    steps = F.aggregate(
        F.slice(parts, 1, F.size(parts) - 1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found")),
        lambda s, p: F.struct((s["at"] + F.length(p) + F.length(name)).cast("int").alias("at"), F.concat(s["found"], F.array((s["at"] + F.length(p)).cast("int"))).alias("found")),
    )
    return steps["found"]


def _automaton(names: list[tuple[str, str]], work_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Spans -> (work, span, name, offset): all names found in one walk of each text, greedily per name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_work: dict[str, ahocorasick.Automaton] = {}
        for work, name in names:
            by_work.setdefault(work, ahocorasick.Automaton()).add_word(name, name)
        for a in by_work.values():
            a.make_automaton()
        for batch in batches:
            rows = []
            for work, ref, text in zip(batch.column(work_col).to_pylist(), batch.column("span_ref").to_pylist(), batch.column("content").to_pylist(), strict=True):
                a = by_work.get(work)
                free: dict[str, int] = {}
                for end, name in a.iter(text) if a is not None and text else ():
                    start = end - len(name) + 1
                    if start >= free.get(name, 0):
                        free[name] = end + 1
                        rows.append((work, ref, name, start))
            cols = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int32()), strict=True)], ["work_ref", "span_ref", "name", "start_offset"])

    return run


def name_occurrences(spans: DataFrame, names: DataFrame) -> DataFrame:
    """(work_ref, span_ref, name, start_offset): each non-overlapping, case-sensitive occurrence of a work's names.

    Up to ``BROADCAST_NAMES`` names of ``BROADCAST_NAME_CHARS`` characters together go to every task as one automaton per
    work.  More are matched through their first trigram, an equi-join, and then verified in the text.
    """
    names = names.select("work_ref", "name").filter("name <> ''").distinct()
    size = names.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("name") + F.length("work_ref")), F.lit(0)).alias("chars")).first()
    few = size["n"] <= BROADCAST_NAMES and size["chars"] <= BROADCAST_NAME_CHARS
    texts = spans.select("work_ref", "span_ref", "content")
    if few:
        known = [(r["work_ref"], r["name"]) for r in names.collect()]
        return texts.mapInArrow(_automaton(known, "work_ref"), "work_ref string, span_ref string, name string, start_offset int")
    grams = F.array_distinct(F.regexp_extract_all("content", F.lit("(?s)(?=(.{1,3}))"), 1))
    seen = texts.select("work_ref", "span_ref", F.explode(F.array_distinct(F.concat(grams, F.transform(grams, lambda g: F.left(g, F.lit(2))), F.transform(grams, lambda g: F.left(g, F.lit(1)))))).alias("gram"))
    pairs = seen.join(names.withColumn("gram", F.left("name", F.lit(3))), ["work_ref", "gram"]).select("work_ref", "span_ref", "name")
    held = texts.join(pairs, ["work_ref", "span_ref"]).filter(F.contains("content", F.col("name")))
    return held.select("work_ref", "span_ref", "name", F.explode(occurrence_offsets(F.col("content"), F.col("name"))).alias("start_offset"))


def mentions(spans: DataFrame, entities: DataFrame) -> DataFrame:
    """Every occurrence of an entity's canonical name, with its evidence."""
    found = name_occurrences(spans, entities).join(entities.select("work_ref", "name", "entity_ref", "valid_from_chapter", "valid_to_chapter"), ["work_ref", "name"])
    found = found.join(spans.select("work_ref", "span_ref", "document_ref", "ordinal"), ["work_ref", "span_ref"])
    end = F.col("start_offset") + F.length("name")
    return found.withColumns({"end_offset": end, "source_kind": F.lit("deterministic"), "evidence_hash": F.sha2("name", 256), "mention_ref": stable_id("mention", F.col("span_ref"), F.col("entity_ref"), F.col("start_offset"), F.lit("deterministic"))})


def links(spans: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``[[name]]`` references: (resolved mentions, unresolved ones with a reason)."""
    parts = F.split(F.col("content"), LINK, -1)
    found = F.regexp_extract_all("content", F.lit(LINK), 1)
    at = F.transform(found, lambda x, i: F.struct(x.alias("captured"), (F.aggregate(F.slice(parts, 1, i + 1), F.lit(0), lambda s, p: s + F.length(p)) + F.aggregate(F.slice(found, 1, i), F.lit(0), lambda s, p: s + F.length(p) + 4)).alias("place")))
    rows = spans.filter(F.contains("content", F.lit("[["))).select("work_ref", "span_ref", "document_ref", "ordinal", F.explode(at).alias("r")).select("work_ref", "span_ref", "document_ref", "ordinal", "r.*")
    rows = rows.withColumn("text", js_trim(F.col("captured"))).withColumn("normalized_alias", normalize_name(F.col("text")))
    rows = rows.join(alias_owners(aliases(entities)), ["work_ref", "normalized_alias"], "left").withColumn("owners", F.coalesce("owners", F.lit(0)))
    lead = F.length("captured") - F.length(F.regexp_replace("captured", "^\\s+", ""))
    start = F.col("place") + 2 + lead
    resolved = rows.filter("owners = 1").withColumns({"start_offset": start.cast("int"), "end_offset": (start + F.length("text")).cast("int"), "source_kind": F.lit("native"), "evidence_hash": F.sha2("text", 256)})
    resolved = resolved.withColumn("mention_ref", stable_id("mention", F.col("span_ref"), F.col("entity_ref"), F.col("start_offset"), F.lit("native")))
    reason = F.when(F.col("owners") > 1, "AMBIGUOUS_ALIAS").otherwise("NO_MATCHING_ENTITY")
    unresolved = rows.filter("owners <> 1").select("work_ref", stable_id("unresolved", F.col("span_ref"), F.col("text"), F.col("place")).alias("mention_ref"), "text", "span_ref", reason.alias("reason"))
    return resolved, unresolved


def reference_edges(found: DataFrame, documents: DataFrame, kind: str) -> DataFrame:
    """appears_in (entity -> document) or mentions (document -> entity): one edge per pair, first span in source order."""
    ordered = found.join(documents.select("work_ref", "document_ref", "source_ordinal"), ["work_ref", "document_ref"])
    ends = ("entity_ref", "document_ref") if kind == "appears_in" else ("document_ref", "entity_ref")
    first = F.min_by(F.struct("span_ref", "evidence_hash", "source_kind"), F.struct("source_ordinal", "ordinal", "span_ref", "start_offset"))
    rows = ordered.groupBy("work_ref", *ends).agg(first.alias("f"), F.count("*").alias("occurrences"))
    source, target = (F.col(c) for c in ends)
    return rows.select("work_ref", stable_id("edge", source, target, F.lit(kind)).alias("edge_ref"), source.alias("source_ref"), target.alias("target_ref"), F.lit(kind).alias("kind"), "f.span_ref", "f.evidence_hash", identity_hash(source, target, F.lit(kind)).alias("identity_hash"), "occurrences")


def evidence(found: DataFrame, kind: str) -> DataFrame:
    """One evidence row for each occurrence behind an edge."""
    ends = ("entity_ref", "document_ref") if kind == "appears_in" else ("document_ref", "entity_ref")
    edge = stable_id("edge", F.col(ends[0]), F.col(ends[1]), F.lit(kind))
    return found.select("work_ref", stable_id("edge-evidence", edge, F.col("span_ref"), F.col("start_offset"), F.col("source_kind")).alias("evidence_ref"), edge.alias("edge_ref"), "span_ref", "start_offset", "end_offset", "evidence_hash", "source_kind")


def precedes_edges(entities: DataFrame, spans: DataFrame) -> DataFrame:
    """The chain of chapters of each work."""
    chapters = entities.filter("kind = 'Chapter'").join(spans.select("work_ref", "span_ref", _content_hash(spans).alias("content_hash")), ["work_ref", "span_ref"])
    order = Window.partitionBy("work_ref").orderBy("source_ordinal", "span_ordinal", "entity_ref")
    rows = chapters.withColumns({"source_ref": F.lag("entity_ref").over(order), "order": F.row_number().over(order) - 1}).filter("source_ref is not null")
    source, target = F.col("source_ref"), F.col("entity_ref")
    return rows.select("work_ref", stable_id("edge", source, target, F.lit("precedes")).alias("edge_ref"), source, target.alias("target_ref"), F.lit("precedes").alias("kind"), "span_ref", F.col("content_hash").alias("evidence_hash"), identity_hash(source, target, F.lit("precedes")).alias("identity_hash"), source.alias("valid_from_chapter"), target.alias("valid_to_chapter"), "order")


MENTION = ["work_ref", "mention_ref", "entity_ref", "span_ref", "start_offset", "end_offset", "source_kind", "evidence_hash"]


def edge_tables(documents: DataFrame, spans: DataFrame, entities: DataFrame | None, mentioned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, evidence) of documents, from their mentions; an edge without evidence does not come about.  ``entities``
    (all of the work; none: leave it out) make the chain of chapters."""
    shape = ["work_ref", "edge_ref", "source_ref", "target_ref", "kind", "span_ref", "evidence_hash", "identity_hash"]
    placed = mentioned.join(spans.select("work_ref", "span_ref", "document_ref", "ordinal"), ["work_ref", "span_ref"])
    by_name, by_link = placed.filter("source_kind = 'deterministic'"), placed.filter("source_kind = 'native'")
    edges = contains_edges(spans).select(*shape).unionByName(reference_edges(by_name, documents, "appears_in").select(*shape)).unionByName(reference_edges(by_link, documents, "mentions").select(*shape))
    none = F.lit(None).cast("string")
    edges = edges.withColumns({"valid_from_chapter": none, "valid_to_chapter": none})
    if entities is not None:
        edges = edges.unionByName(precedes_edges(entities, spans).select(*edges.columns))
    return edges, evidence(by_name, "appears_in").unionByName(evidence(by_link, "mentions"))


def build(documents: DataFrame, spans: DataFrame) -> dict[str, DataFrame]:
    """All graph tables of a set of documents."""
    defined = definitions(spans, documents)
    entities = canonical_entities(defined)
    found, (resolved, unresolved) = mentions(spans, entities), links(spans, entities)
    mentioned = found.select(*MENTION).unionByName(resolved.select(*MENTION))
    edges, proof = edge_tables(documents, spans, entities, mentioned)
    return {"documents": documents, "spans": spans, "definitions": defined, "entities": entities, "aliases": aliases(entities), "edges": edges, "unresolved": unresolved, "mentions": mentioned, "evidence": proof}
