"""Retrieval quality: gold references, ranks, recall, splits, ablation, calibration."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTOFFS = (5, 10, 20, 50)
# Fixed values of the ablation rule.
RECALL_DROP, MRR_DROP = 0.02, 0.05


AUTOMATON_QUOTES, AUTOMATON_CHARS = 100_000, 16 << 20


def _held_quotes(quotes: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ahocorasick.Automaton()
        for q in quotes:
            found.add_word(q, q)
        found.make_automaton()
        for batch in batches:
            rows = [(ref, q) for ref, text in zip(batch.column("span_ref").to_pylist(), batch.column("content").to_pylist(), strict=True) for q in sorted({q for _, q in found.iter(text or "")})]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], batch.schema.field("span_ref").type), pa.array([q for _, q in rows], pa.string())], ["span_ref", "quote"])

    return run


def held_quotes(spans: DataFrame, quotes: DataFrame, probe: int = 16) -> DataFrame:
    """(span_ref, quote) for each row of ``spans`` whose content holds a quote; quotes(quote: distinct, not empty).

    Up to ``AUTOMATON_QUOTES`` quotes of ``AUTOMATON_CHARS`` characters together are looked for in one walk of each text.
    More meet the spans on their first ``probe`` characters, an equi-join, before the full text is compared; quotes shorter
    than that meet on all the characters they have.
    """
    size = quotes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("quote")), F.lit(0)).alias("chars")).first()
    if not size["n"]:
        return quotes.join(spans.select("span_ref").limit(0)).select("span_ref", "quote")
    if size["n"] <= AUTOMATON_QUOTES and size["chars"] <= AUTOMATON_CHARS:
        kind = spans.schema["span_ref"].dataType.simpleString()
        known = sorted(r["quote"] for r in quotes.select("quote").collect())
        return spans.select("span_ref", "content").mapInArrow(_held_quotes(known), f"span_ref {kind}, quote string")
    widths = [r["w"] for r in quotes.select(F.least(F.length("quote"), F.lit(probe)).alias("w")).distinct().collect()]  # at most ``probe`` values
    grams = F.array_distinct(F.flatten(F.array(*[F.transform(F.regexp_extract_all("content", F.lit(f"(?s)(?=(.{{{w}}}))"), 1), lambda g: F.xxhash64(g)) for w in sorted(widths)])))
    seen = spans.select("span_ref", F.explode(grams).alias("gram"))
    wanted = quotes.select("quote", F.xxhash64(F.left("quote", F.lit(probe))).alias("gram"))
    pairs = seen.join(wanted, "gram").select("span_ref", "quote").distinct()
    return pairs.join(spans.select("span_ref", "content"), "span_ref").filter(F.contains("content", F.col("quote"))).select("span_ref", "quote")


def gold_references(spans: DataFrame, quotes: DataFrame, probe: int = 16) -> DataFrame:
    """(fact, span_ref) where the span's content holds a quote of the fact.  quotes(fact, quote); see :func:`held_quotes`."""
    given = quotes.filter(F.length("quote") > 0)
    found = held_quotes(spans, given.select("quote").distinct(), probe)
    return found.join(given, "quote").select("fact", "span_ref").distinct()


def gold_ranks(results: DataFrame, gold: DataFrame, facts: DataFrame) -> DataFrame:
    """facts with ``rank``: the first result (fact, span_ref, rank) that is gold, or null."""
    best = results.join(gold, ["fact", "span_ref"]).groupBy("fact").agg(F.min("rank").alias("rank"))
    return facts.join(best, "fact", "left")


def recall_mrr(ranks: DataFrame, group: list[str] = ()) -> DataFrame:
    """Recall at the cutoffs and the mean reciprocal rank."""
    hit = [F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in CUTOFFS]
    return ranks.groupBy(*group).agg(F.count("*").alias("facts"), *hit, F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))).alias("mrr"))


def holdout(chapters: DataFrame, head: int = 3, tail: int = 2, least: int = 6) -> DataFrame:
    """chapters(volume, chapter) with ``held_out``: the first three and last two of each volume, all of a short one."""
    w = Window.partitionBy("volume")
    up, down, n = F.row_number().over(w.orderBy("chapter")), F.row_number().over(w.orderBy(F.desc("chapter"))), F.count("*").over(w)
    return chapters.withColumn("held_out", (n < least) | (up <= head) | (down <= tail))


def territories(headings: DataFrame, group: list[str], order: list[str], number: str) -> DataFrame:
    """headings with ``volume``: a new one when number 1 follows a number above 1."""
    w = Window.partitionBy(*group).orderBy(*order)
    restart = F.when((F.col(number) == 1) & (F.lag(number).over(w) > 1), 1).otherwise(0)
    return headings.withColumn("restart", restart).withColumn("volume", 1 + F.sum("restart").over(w)).drop("restart")


def ablation(metrics: DataFrame) -> DataFrame:
    """metrics(variant, recall_5, mrr) with ``verdict``: KEEP if the factor's absence costs enough."""
    base = metrics.filter("variant = 'baseline'").select(F.col("recall_5").alias("b_recall"), F.col("mrr").alias("b_mrr"))
    costs = (F.col("b_recall") - F.col("recall_5") > RECALL_DROP) | ((F.col("b_mrr") > 0) & ((F.col("b_mrr") - F.col("mrr")) / F.col("b_mrr") > MRR_DROP))
    return metrics.crossJoin(F.broadcast(base)).select("variant", "recall_5", "mrr", F.when(costs, "KEEP").otherwise("DROP").alias("verdict"))  # one base row


def calibration_winner(metrics: DataFrame) -> DataFrame:
    """The best of metrics(top_k, terms, weight, recall_5, mrr) that loses nothing against its baseline row."""
    order = [F.desc("recall_5"), F.desc("mrr"), "top_k", "terms", "weight"]
    return metrics.filter("recall_5 >= base_recall_5 and mrr >= base_mrr").orderBy(*order).limit(1)


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


Search = Callable[[DataFrame, "dict | None", frozenset], DataFrame]


def run_tasks(tasks: DataFrame, search: Search, config: dict | None = None, disabled: frozenset[str] = frozenset()) -> DataFrame:
    """tasks(fact, query) -> (fact, span_ref, rank, excerpt): all tasks of one setting in one plan.

    search: (queries(query_id, query), config, disabled factors) -> ranked rows by query_id, such as ``search_many``.
    """
    found = search(tasks.select(F.col("fact").alias("query_id"), "query"), config, disabled)
    return found.select(F.col("query_id").alias("fact"), "span_ref", "rank", "excerpt")


def measured(tasks: DataFrame, gold: DataFrame, search: Search, config: dict | None = None, disabled: frozenset[str] = frozenset()) -> DataFrame:
    """One row: recall at the cutoffs and the mean reciprocal rank of a search over tasks (fact, query) with ``gold``."""
    return recall_mrr(gold_ranks(run_tasks(tasks, search, config, disabled).select("fact", "span_ref", "rank"), gold, tasks.select("fact")))


def _labelled(rows: list[tuple[dict, DataFrame]]) -> DataFrame:
    out = None
    for label, df in rows:
        one = df.select(*[F.lit(v).alias(k) for k, v in label.items()], *df.columns)
        out = one if out is None else out.unionByName(one)
    return out


def calibrate(tasks: DataFrame, gold: DataFrame, search: Search, grid: dict[str, tuple]) -> DataFrame:
    """(top_k, terms, weight, recall_5, mrr, base_recall_5, base_mrr) of every setting of ``grid``, searched for real: a
    plan for each setting, whatever the number of tasks."""
    base = measured(tasks, gold, search).select(F.col("recall_5").alias("base_recall_5"), F.col("mrr").alias("base_mrr"))
    settings = [{"top_k": k, "terms": t, "weight": w} for k, t, w in itertools.product(grid["top_k"], grid["terms"], grid["weight"])]
    rows = _labelled([(c, measured(tasks, gold, search, c).select("recall_5", "mrr")) for c in settings])
    return rows.crossJoin(F.broadcast(base))  # one base row


def ablate(tasks: DataFrame, gold: DataFrame, search: Search, factors: tuple[str, ...]) -> DataFrame:
    """(variant, recall_5, mrr) without each factor in turn, and the baseline, searched for real."""
    return _labelled([({"variant": name}, measured(tasks, gold, search, None, frozenset([name]) - {"baseline"}).select("recall_5", "mrr")) for name in ("baseline", *factors)])


def fixture_report(tasks: DataFrame, results: DataFrame, corpus_tokens: int) -> DataFrame:
    """tasks(fact, expect) and results(fact, excerpt, tokens) -> tasks, recall, evidence coverage, token reduction."""
    shown = results.groupBy("fact").agg(F.collect_list("excerpt").alias("excerpts"), F.sum("tokens").alias("tokens"))
    rows = tasks.join(shown, "fact", "left").withColumn("covered", F.coalesce(exposure(F.col("excerpts"), F.array("expect")), F.lit(False)))
    return rows.agg(F.count("*").alias("tasks"), F.avg(F.col("excerpts").isNotNull().cast("double")).alias("recall"), F.avg(F.col("covered").cast("double")).alias("coverage"), (1 - F.avg(F.coalesce("tokens", F.lit(0))) / F.lit(max(1, corpus_tokens))).alias("reduction"))


def exposure(excerpts: Column, quotes: Column) -> Column:
    """Whether any excerpt shows any quote."""
    return F.exists(excerpts, lambda e: F.exists(quotes, lambda q: F.contains(e, q)))


def exposed(quotes: DataFrame, shown: DataFrame) -> DataFrame:
    """quotes(fact, quote), shown(fact, excerpt) -> (fact, exposed): whether any excerpt of a fact shows one of its quotes."""
    wanted = quotes.groupBy("fact").agg(F.collect_set("quote").alias("quotes"))
    hit = shown.join(wanted, "fact").withColumn("hit", exposure(F.array("excerpt"), F.col("quotes"))).groupBy("fact").agg(F.max("hit").alias("hit"))
    return wanted.select("fact").join(hit, "fact", "left").select("fact", F.coalesce("hit", F.lit(False)).alias("exposed"))
