"""Bounded reads of the graph: entity lookup, neighbourhoods, timelines, documents, statistics."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.text import contains_folded, normal_name

# Fixed values.
FAN_OUT, MOST_VISITED, MAX_HOPS, MAX_LIMIT = 64, 512, 3, 100
FAR = (1 << 53) - 1


def clamp_limit(limit: int | None) -> int:
    return max(1, min(MAX_LIMIT, int(limit if limit is not None else 20)))


def clamp_hops(hops: int | None) -> int:
    return max(0, min(MAX_HOPS, int(hops if hops is not None else 2)))


def alias_matches(aliases: DataFrame, name: str) -> DataFrame:
    """(entity_ref, score, owner_count): exact aliases score 2, partial ones 1; owners are counted before any limit."""
    wanted = normal_name(name)
    exact = F.when(F.col("normalized_alias") == wanted, 2).otherwise(1)
    matched = aliases.filter(contains_folded(F.col("normalized_alias"), wanted)).groupBy("entity_ref").agg(F.max(exact).alias("score"))
    # Two scores at most, so counts are summed before they meet the rows: no window gathers all matches of a score.
    owners = matched.groupBy("score").agg(F.count("*").alias("owner_count"))
    return matched.join(F.broadcast(owners), "score").select("entity_ref", "score", "owner_count")


def entity_lookup(tables: dict[str, DataFrame], name: str, limit: int = 20) -> tuple[DataFrame, DataFrame, list[dict]]:
    """(entities, ambiguous alternatives, diagnostics) of a name."""
    if not normal_name(name):
        return tables["entities"].limit(0), tables["definitions"].limit(0), [{"code": "NO_MATCHING_TERMS"}]
    rows = alias_matches(tables["aliases"], name).join(tables["entities"], "entity_ref").orderBy(F.desc("score"), "normalized_name", "entity_ref").limit(clamp_limit(limit))
    other = tables["definitions"].join(rows.select("entity_ref", F.col("span_ref").alias("own_span")), "entity_ref").filter("span_ref <> own_span").orderBy("source_ordinal", "span_ordinal", "definition_ref")
    best = rows.select("score", "owner_count").limit(1).collect()
    if not best:
        waiting = tables["unresolved"].filter(F.lower("text") == normal_name(name)).limit(clamp_limit(limit))
        return rows, waiting, [{"code": "UNRESOLVED_REFERENCE" if waiting.take(1) else "NO_RESULTS"}]
    shared = best[0]["score"] == 2 and best[0]["owner_count"] > 1
    return rows, other, [{"code": "AMBIGUOUS_ENTITY", "owners": best[0]["owner_count"]}] if shared else []


def adjacency(edges: DataFrame) -> DataFrame:
    """Edges from both ends, a self-loop once: owner, next_ref, direction, kind, edge_ref."""
    out = edges.select(F.col("source_ref").alias("owner"), F.col("target_ref").alias("next_ref"), F.lit("outgoing").alias("direction"), "kind", "edge_ref")
    back = edges.filter("source_ref <> target_ref").select(F.col("target_ref").alias("owner"), F.col("source_ref").alias("next_ref"), F.lit("incoming").alias("direction"), "kind", "edge_ref")
    return out.unionByName(back)


def named_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with ``source_name`` and ``target_name``; an end that is no entity has its reference for a name."""
    ends = [entities.select(F.col("entity_ref").alias(f"{x}_ref"), F.col("name").alias(f"{x}_entity")) for x in ("source", "target")]
    rows = edges.join(ends[0], "source_ref", "left").join(ends[1], "target_ref", "left")
    return rows.withColumns({f"{x}_name": F.coalesce(f"{x}_entity", f"{x}_ref") for x in ("source", "target")}).drop("source_entity", "target_entity")


def neighborhood(edges: DataFrame, seeds: DataFrame, hops: int = 2, nodes: DataFrame | None = None) -> DataFrame:
    return neighborhood_counted(edges, seeds, hops, nodes, False)[0]


def neighborhood_counted(edges: DataFrame, seeds: DataFrame, hops: int = 2, nodes: DataFrame | None = None, counted: bool = True) -> tuple[DataFrame, int]:
    """seeds(ref) -> (ref, hop, score, path, via; nodes with more edges than are followed): bounded breadth-first search,
    first discoverer wins.

    At each hop a node gives its first ``FAN_OUT`` edges by (kind, edge_ref); at most ``MOST_VISITED`` nodes are visited,
    so the frontier that joins the edge table is small at every size of graph.  ``nodes`` (ref) names what resolves.
    """
    spark, adj = edges.sparkSession, adjacency(edges)
    shape = "ref string, hop int, score double, path array<string>, via string, rank int"
    # What is visited is bounded, so it is held here between hops; each hop is one plan over the edge table.
    refs = [r["ref"] for r in seeds.select("ref").distinct().orderBy("ref").limit(MOST_VISITED).collect()]
    frontier = [(r, 0, 2.0, [r], None, k) for k, r in enumerate(refs)]
    seen = list(frontier)
    omitted: list[DataFrame] = []
    for hop in range(1, clamp_hops(hops) + 1):
        room = MOST_VISITED - len(seen)
        if not frontier or room <= 0:
            break
        owners = spark.createDataFrame([(f[0], f[3], f[5]) for f in frontier], "owner string, path array<string>, owner_rank int")
        visited = spark.createDataFrame([(f[0],) for f in seen], "next_ref string")
        near = adj.join(F.broadcast(owners), "owner").withColumn("k", F.row_number().over(Window.partitionBy("owner").orderBy("kind", "edge_ref"))).filter(F.col("k") <= FAN_OUT + 1)
        omitted.append(near.filter(F.col("k") > FAN_OUT))
        step = near.filter(F.col("k") <= FAN_OUT)
        if nodes is not None:
            step = step.join(nodes.select(F.col("ref").alias("next_ref")), "next_ref", "left_semi")
        fresh = step.join(F.broadcast(visited), "next_ref", "left_anti")
        found = fresh.groupBy("next_ref").agg(F.min_by(F.struct("path", "kind", "edge_ref", "owner_rank", "k"), F.struct("owner_rank", "k")).alias("f")).orderBy("f.owner_rank", "f.k").limit(room).collect()
        frontier = [(r["next_ref"], hop, 1.0 / (hop + 1), [*r["f"]["path"], r["f"]["kind"], r["next_ref"]], r["f"]["edge_ref"], k) for k, r in enumerate(found)]
        seen += frontier
    return spark.createDataFrame(seen, shape).drop("rank").orderBy(F.desc("score"), "ref"), sum(o.count() for o in omitted) if counted else 0


def resolve_nodes(refs: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(ref, node_kind, heading, span_ref): an entity, else a span, else a document by its first span."""
    entity = tables["entities"].select(F.col("entity_ref").alias("ref"), F.struct(F.col("kind").alias("node_kind"), F.col("name").alias("heading"), "span_ref").alias("e"))
    span = tables["spans"].select(F.col("span_ref").alias("ref"), F.struct(F.lit("span").alias("node_kind"), "heading", "span_ref").alias("s"))
    first = tables["spans"].groupBy(F.col("document_ref").alias("ref")).agg(F.min_by("span_ref", "ordinal").alias("span_ref"))
    document = first.join(tables["documents"].select(F.col("document_ref").alias("ref"), "kind", "title"), "ref").select("ref", F.struct(F.col("kind").alias("node_kind"), F.col("title").alias("heading"), "span_ref").alias("d"))
    return refs.join(entity, "ref", "left").join(span, "ref", "left").join(document, "ref", "left").select("ref", F.coalesce("e", "s", "d").alias("n")).filter("n is not null").select("ref", "n.*")


def chapter_positions(documents: DataFrame) -> DataFrame:
    """1-based place of each chapter document in its work."""
    order = Window.partitionBy("work_ref").orderBy("source_ordinal", "document_ref")
    return documents.filter("kind = 'chapter'").select("work_ref", "document_ref", F.row_number().over(order).alias("position"))


def valid_at(start: Column, end: Column, anchor: int | Column) -> Column:
    """Whether start <= anchor <= end, open ends included."""
    anchor = F.lit(max(1, anchor)) if isinstance(anchor, int) else anchor
    return (F.coalesce(start, F.lit(-1)) <= anchor) & (F.coalesce(end, F.lit(FAR)) >= anchor)


def timeline(items: DataFrame, positions: DataFrame, query: str = "", anchor: int | None = None, limit: int | None = 20) -> DataFrame:
    """items(ref, heading, valid_from, valid_to, narrative_time) in story order; positions(ref, position)."""
    at = [positions.select(F.col("ref").alias(f"valid_{x}"), F.col("position").alias(f"{x}_position")) for x in ("from", "to")]
    rows = items.filter("valid_from is not null or valid_to is not null or narrative_time is not null").join(at[0], "valid_from", "left").join(at[1], "valid_to", "left")
    start, end = (F.when(F.col(f"valid_{x}").isNotNull(), F.coalesce(f"{x}_position", F.lit(FAR))) for x in ("from", "to"))
    if anchor is not None:
        rows = rows.filter(valid_at(start, end, anchor))
    wanted = unicodedata.normalize("NFKC", query).strip().lower()
    if wanted:
        rows = rows.filter(F.contains(F.lower("heading"), F.lit(wanted)))
    rows = rows.withColumns({"from_position": F.coalesce(start, F.lit(FAR)), "to_position": F.coalesce(end, F.lit(FAR))})
    order = ["from_position", "to_position", F.coalesce("narrative_time", F.lit("")), "ref"]
    return rows.orderBy(*order) if limit is None else rows.orderBy(*order).limit(clamp_limit(limit))


def document_lookup(rows: DataFrame, needle: str, path: str = "relative_path", title: str = "title", order: list[str] | None = None, limit: int = 20) -> DataFrame:
    """Rows whose path or title holds ``needle`` literally."""
    test = contains_folded(F.col(path), needle) | contains_folded(F.col(title), needle)
    return rows.filter(test).orderBy(*(order or ["source_ordinal", "ordinal", "span_ref"])).limit(clamp_limit(limit))


def corpus_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """One row of counts, and the counts by layer and kind as JSON."""
    from loomtext.operators.context import layer_counts

    row = None
    for name in ("documents", "spans", "entities", "edges"):
        one = tables[name].agg(F.count("*").alias(name))
        row = one if row is None else row.crossJoin(one)
    layers = layer_counts(tables["documents"]).agg(F.to_json(F.array_sort(F.collect_list(F.struct("layer", "count")))).alias("layers"))
    return row.crossJoin(layers)
