"""Token-budgeted context: layers, duplicate folding, anchors, greedy filling, what was left out and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.text import estimate_tokens
from loomtext.operators import explore

# The layer and priority of each kind, document kinds as entity kinds, the default.
PROFILES = {
    "Character": ("L1", 0), "Fact": ("L1", 1), "Foreshadow": ("L1", 2), "Chapter": ("L2", 0), "Event": ("L2", 1), "OutlineNode": ("L2", 2), "Location": ("L3", 0), "Item": ("L3", 1),
}
DOCUMENT_KINDS = {"character": "Character", "state": "Fact", "foreshadow": "Foreshadow", "chapter": "Chapter", "outline": "OutlineNode"}
DEFAULT = ("L3", 9)
LAYERS = ("L1", "L2", "L3")
MAX_REFS, MAX_REF_LENGTH, MAX_BUDGET, SEARCH_LIMIT = 128, 256, 1_000_000, 12


def profile(kind: Column, required: Column) -> Column:
    """struct(layer, priority) of a kind; required rows are layer L0."""
    known = {**PROFILES, **{k: PROFILES[v] for k, v in DOCUMENT_KINDS.items()}}
    by_kind = F.create_map(*[F.lit(x) if isinstance(x, str) else F.struct(F.lit(x[0]).alias("layer"), F.lit(x[1]).alias("priority")) for pair in known.items() for x in pair])
    made = lambda layer, priority: F.struct(F.lit(layer).alias("layer"), F.lit(priority).alias("priority"))
    return F.when(required, made("L0", 0)).otherwise(F.coalesce(F.element_at(by_kind, kind), made(*DEFAULT)))


def layer_counts(documents: DataFrame) -> DataFrame:
    """(layer, count) of documents by layer; every layer has a row."""
    spark = documents.sparkSession
    counted = documents.groupBy("kind").agg(F.count("*").alias("n")).select(profile(F.col("kind"), F.lit(False))["layer"].alias("layer"), "n").groupBy("layer").agg(F.sum("n").alias("n"))
    return spark.createDataFrame([(x,) for x in LAYERS], "layer string").join(F.broadcast(counted), "layer", "left").select("layer", F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def token_totals(rows: DataFrame, group: list[str], text: Column) -> DataFrame:
    """(group, tokens, rows): estimated tokens of the texts of each group."""
    return rows.groupBy(*group).agg(F.sum(estimate_tokens(text)).alias("tokens"), F.count("*").alias("rows"))


def fold_duplicates(rows: DataFrame, group: list[str], hash_col: str, order: list[Column | str]) -> DataFrame:
    """``rows`` with ``duplicate``: all but the first of each evidence hash in its group."""
    return rows.withColumn("duplicate", F.row_number().over(Window.partitionBy(*group, hash_col).orderBy(*order)) > 1)


def greedy_fill(items: Column, budget: Column | int) -> Column:
    """array<struct<ref, tokens>> in fill order -> struct(used, refs): an item that does not fit is skipped, later ones may fit."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("refs"))
    return F.aggregate(
        items, start,
        lambda s, x: F.when(s["used"] + x["tokens"] <= budget, F.struct((s["used"] + x["tokens"]).cast("long").alias("used"), F.concat(s["refs"], F.array(x["ref"])).alias("refs"))).otherwise(s),
    )


def check_request(budget: float, *lists: list[str]) -> None:
    if any(len(x) > MAX_REFS or any(len(r) > MAX_REF_LENGTH for r in x) for x in lists):
        raise ValueError("CONTEXT_REFS_TOO_LARGE: at most 128 references of at most 256 characters")
    if not 1 <= budget <= MAX_BUDGET:
        raise ValueError("BUDGET_OUT_OF_RANGE: the budget must be between 1 and 1000000 tokens")


def anchor_order(position: Column, target: int | None) -> tuple[Column, Column]:
    """(class, distance): the target chapter, earlier ones by nearness, later ones by nearness, then everything else."""
    if target is None:
        return F.lit(0), F.lit(0)
    t = F.lit(target)
    cls = F.when(position.isNull(), 3).when(position == t, 0).when(position < t, 1).otherwise(2)
    return cls, F.when(position.isNull(), 0).otherwise(F.abs(position - t))


def assemble(found: DataFrame, direct: DataFrame, budget: int, required: list[str] = (), excluded: list[str] = (), pinned: list[str] = (), target: int | None = None) -> DataFrame:
    """The packet, one row: status, used_tokens, blocks, omitted.

    found: search results; direct: nodes resolved for required and pinned references that search did not bring.  Both:
    ref, kind, score, tokens, evidence_hash, position.  They are bounded (12 results, 3 x 128 references).
    """
    check_request(budget, list(required), list(excluded), list(pinned))
    none = F.array().cast("array<string>")
    among = lambda refs: F.array_contains(F.array(*[F.lit(r) for r in refs]) if refs else none, F.col("ref"))
    rows = found.withColumn("from_search", F.lit(True)).unionByName(direct.withColumn("from_search", F.lit(False)))
    rows = rows.withColumns({"required": among(required), "dropped": among(excluded) & ~among(required)})
    live = fold_duplicates(rows.filter("from_search and not dropped"), [], "evidence_hash", [F.desc("required"), F.desc("score"), "ref"])
    kept = live.filter("not duplicate").drop("duplicate")
    more = rows.filter("not from_search and not dropped").join(kept.select("ref"), "ref", "left_anti")
    pool = kept.unionByName(more).withColumns({"profile": profile(F.col("kind"), F.col("required")), "pin": ~F.col("from_search") & ~F.col("required")})
    cls, far = anchor_order(F.col("position"), target)
    key = F.struct((~F.col("required")).alias("a"), F.col("profile.layer").alias("b"), (~F.col("pin")).alias("c"), cls.alias("d"), far.alias("e"), (-F.col("score")).alias("f"), F.col("profile.priority").alias("g"), F.col("ref").alias("ref"))
    item = F.struct(key.alias("k"), F.col("ref"), F.col("tokens"), F.col("required"), F.col("profile.layer").alias("layer"))
    packed = pool.agg(F.array_sort(F.collect_list(item)).alias("items"), F.coalesce(F.sum(F.when(F.col("required"), F.col("tokens"))), F.lit(0)).alias("least"))
    fits = F.col("least") <= budget
    filled = packed.withColumn("fill", F.when(fits, greedy_fill(F.col("items"), budget)).otherwise(F.struct(F.lit(0).cast("long").alias("used"), none.alias("refs"))))
    out = lambda x, reason: F.struct(x["ref"].alias("ref"), reason.alias("reason"), x["tokens"].cast("long").alias("tokens"))
    left = F.transform(F.filter("items", lambda x: ~F.array_contains("fill.refs", x["ref"])), lambda x: out(x, F.when(~fits & x["required"], "required_minimum_exceeds_budget").otherwise("budget_limit")))
    gone = live.filter("duplicate").join(more.select("ref"), "ref", "left_anti").select(F.struct("ref", F.lit("duplicate_evidence").alias("reason"), F.col("tokens").cast("long").alias("tokens")).alias("o"))
    gone = gone.unionByName(rows.filter("dropped").select(F.struct("ref", F.lit("excluded").alias("reason"), F.col("tokens").cast("long").alias("tokens")).alias("o")))
    known = rows.select("ref")
    spark = found.sparkSession
    asked = spark.createDataFrame([(r,) for r in dict.fromkeys([*required, *(p for p in pinned if p not in excluded)])], "ref string")
    gone = gone.unionByName(asked.join(known, "ref", "left_anti").select(F.struct("ref", F.lit("not_found").alias("reason"), F.lit(0).cast("long").alias("tokens")).alias("o")))
    rest = gone.agg(F.array_sort(F.collect_list("o")).alias("rest"))
    both = filled.crossJoin(rest)  # one row each
    omitted = F.concat(left, F.col("rest"))
    status = F.when(~fits, "budget_unsatisfiable").when(F.size(omitted) > 0, "truncated").otherwise("complete")
    return both.select(status.alias("status"), F.lit(budget).alias("budget_tokens"), F.col("fill.used").alias("used_tokens"), F.col("fill.refs").alias("blocks"), omitted.alias("omitted"))


def block_details(work, packet, query: str, required: list[str]) -> DataFrame:  # noqa: ANN001
    """(one, place, ref, kind, layer, required, tokens, excerpt, evidence_hash, relative_path, start_line, end_line) of the
    blocks of a packet; a bounded number of rows."""
    spark, refs = work.spark, list(packet["blocks"])
    wanted = spark.createDataFrame([(k, r, r in required) for k, r in enumerate(refs)], "place int, ref string, required boolean")
    shown = work.explore("search", query, SEARCH_LIMIT).rows
    columns = ["ref", "kind", "excerpt", "relative_path", "start_line", "end_line"]
    found = shown.select(F.col("span_ref").alias("ref"), *columns[1:]) if "excerpt" in shown.columns else spark.createDataFrame([], "ref string, kind string, excerpt string, relative_path string, start_line int, end_line int")
    rest = wanted.select("ref").join(found.select("ref"), "ref", "left_anti")
    spans = work.rows().drop("kind", "title", "heading")
    direct = explore.resolve_nodes(rest, work.tables()).select("ref", F.col("node_kind").alias("kind"), "span_ref").join(spans, "span_ref").select("ref", "kind", F.left("content", F.lit(900)).alias("excerpt"), *columns[3:])
    rows = wanted.join(found.unionByName(direct), "ref")
    layer = profile(F.col("kind"), F.col("required"))["layer"]
    return rows.select(F.lit(1).alias("one"), "place", "ref", "kind", layer.alias("layer"), "required", estimate_tokens(F.col("excerpt")).alias("tokens"), "excerpt", F.sha2("excerpt", 256).alias("evidence_hash"), *columns[3:])
