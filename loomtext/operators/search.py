"""Ranked search: query analysis, bounded candidates, factor scores, pseudo-relevance feedback, evidence windows."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomtext.functions.text import contains_folded, utf16_size, utf16_slice
from loomtext.operators.fulltext import add_bm25, indexed_bm25, short_spans

# Phrases that a question may hold and that are no terms; words that feedback never adds; the grid.
STOP_PHRASES = (
    "让我们先 请告诉我 我想知道 帮我查找 她在故事中 他在故事中 它在故事中 使用了什么 做了什么 发生了什么 这个角色 这个人物 去了哪里 来自哪里 以及 探索 检索 查找 告诉我 "
    "她是谁 他是谁 它是谁 是什么 是谁 在哪里 为什么 怎么样 如何 请问"
).split()
FEEDBACK_STOP = set("and are for from into is that the this was were with 一个 一种 以及 但是 因为 所以 他们 她们 它们 没有 可以".split())
GRID = {"top_k": (5, 8, 12), "terms": (4, 6, 8), "weight": (0.15, 0.25, 0.35)}
PRODUCTION = {"top_k": 12, "terms": 8, "weight": 0.35}
MAX_TERMS, FEEDBACK_POOL = 48, 128
FEW_SPANS, ASKED, POOL_TASKS = 200_000, 256, 4
STABLE = ["source_ordinal", "ordinal", "span_ref"]
EXCERPT, WINDOWS, SEPARATOR = 900, 3, "\n…\n"
FACTORS = ("coverage", "alias", "proximity", "heading", "bm25Term", "ftsMerge", "trust")
_TOKEN = re.compile(r"[a-z0-9][a-z0-9_'-]*|[㐀-鿿]+")


def _grams(token: str) -> Iterable[str]:
    for size in (3, 2, 4):
        yield from (token[i : i + size] for i in range(len(token) - size + 1))


def _is_han(token: str) -> bool:
    return "㐀" <= token[0] <= "鿿"


def analyze_query(query: str) -> list[str]:
    """Distinct search terms of a query, in order, at most ``MAX_TERMS``."""
    text = unicodedata.normalize("NFKC", query).lower()
    for phrase in STOP_PHRASES:
        text = text.replace(phrase, " ")
    terms: dict[str, None] = {}
    for token in _TOKEN.findall(text):
        if not _is_han(token):
            terms[token] = None
        elif len(token) > 4:
            terms.update(dict.fromkeys(_grams(token)))
        elif len(token) > 1:
            terms[token] = None
    return list(terms)[:MAX_TERMS]


def query_terms(c: Column) -> Column:
    """The same for Latin text in a column: token order, distinct, bounded."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9][a-z0-9_'-]*)"), 1)), 1, MAX_TERMS)


def alias_terms(terms: list[str]) -> list[str]:
    """Familiar forms of two- and three-character names that are not terms already."""
    made: dict[str, None] = {}
    for t in terms:
        if len(t) in (2, 3) and all(_is_han(c) for c in t):
            made.update(dict.fromkeys([p + t[-1] for p in "阿小老"] + ([t[1:]] if len(t) == 3 else [])))
    return [a for a in made if a not in terms]


def proximity(content: str, terms: list[str]) -> float:
    """1 / (1 + least spread / 200) over the terms' places; a lone term is 1, and a term without a place makes it 0."""
    if len(terms) < 2:
        return float(len(terms))
    places = [np.array([m.start() for m in re.finditer(re.escape(t), content)]) for t in terms]
    if not all(map(len, places)):
        return 0.0
    anchors = np.concatenate(places)
    low = high = anchors
    for p in places:  # of each term, the place nearest to every anchor; of two as near, the first
        at = np.searchsorted(p, anchors)
        before, after = p[np.maximum(at - 1, 0)], p[np.minimum(at, len(p) - 1)]
        near = np.where(np.abs(before - anchors) <= np.abs(after - anchors), before, after)
        low, high = np.minimum(low, near), np.maximum(high, near)
    return float(1 / (1 + (high - low).min() / 200))


def evidence_windows(content: str, terms: list[str], width: int = EXCERPT) -> list[tuple[int, int]]:
    """All of a short text; else up to three windows around the terms, best covered first, in text order (UTF-16 units)."""
    size = utf16_size(content)
    if size <= width:
        return [(0, size)]
    places = {t: [m.start() for m in re.finditer(re.escape(t), content, re.IGNORECASE)] for t in terms}
    anchors = [x for p in places.values() for x in p]
    if not anchors:
        return [(0, width)]
    chunk = (width - len(SEPARATOR) * (WINDOWS - 1)) // WINDOWS
    ranked = []
    for a in anchors:
        start = max(0, min(size - chunk, a - chunk // 2))
        near = [min(inside, key=lambda x: (abs(x - a), x)) for p in places.values() if (inside := [x for x in p if start <= x < start + chunk])]
        ranked.append((-len(near), max(near) - min(near) if near else chunk, start))
    chosen: list[int] = []
    for _, _, start in sorted(ranked):
        if len(chosen) < WINDOWS and all(abs(start - c) >= chunk for c in chosen):
            chosen.append(start)
    while len(chosen) < WINDOWS:
        spare = (size - chunk) * len(chosen) // (WINDOWS - 1)
        if any(abs(spare - c) < chunk / 2 for c in chosen):
            break
        chosen.append(spare)
    return [(s, s + chunk) for s in sorted(chosen)]


def excerpt_of(content: str, windows: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int, int, int]]]:
    """The windows joined, and of each its place in the excerpt and its first and last line (from 0) in the content."""
    parts, pieces, at = [], [], 0
    for k, (start, end) in enumerate(windows):
        text = utf16_slice(content, start, end)
        at += len(SEPARATOR) if k else 0
        before = utf16_slice(content, 0, start).count("\n")
        if text:
            pieces.append((at, at + utf16_size(text), before, before + text[:-1].count("\n")))
        at += utf16_size(text)
        parts.append(text)
    return SEPARATOR.join(parts), pieces


def evidence_window(content: str, terms: list[str], width: int = EXCERPT) -> str:
    return excerpt_of(content, evidence_windows(content, terms, width))[0]


EXCERPT_TYPE = "struct<excerpt:string,pieces:array<struct<excerpt_start:int,excerpt_end:int,from_line:int,to_line:int>>>"


def excerpt_column(content: Column, *terms: Column) -> Column:
    """(excerpt, pieces) of a bounded set of rows; ``terms``: arrays of what it should show (none: the beginning)."""

    @F.pandas_udf(EXCERPT_TYPE)
    def made(text: pd.Series, wanted: pd.Series) -> pd.DataFrame:
        rows = [excerpt_of(t, evidence_windows(t, list(w)) if len(w) else [(0, min(EXCERPT, utf16_size(t)))]) for t, w in zip(text, wanted, strict=True)]
        return pd.DataFrame({"excerpt": [e for e, _ in rows], "pieces": [[dict(zip(("excerpt_start", "excerpt_end", "from_line", "to_line"), p, strict=True)) for p in ps] for _, ps in rows]})

    return made(content, F.concat(*terms) if terms else F.array().cast("array<string>"))


def _any_folded(terms: list[str]) -> Column:
    test = F.lit(False)
    for t in terms:
        test = test | contains_folded(F.col("heading"), t) | contains_folded(F.col("content"), t)
    return test


@dataclass(frozen=True)
class Index:
    """What a revision holds for search: postings with places, document frequencies, totals.  A ``posted`` term carries
    the size and the order of its span, so choosing rows reads no other table."""

    postings: DataFrame
    terms: DataFrame
    count: int
    average: float
    known: dict = field(default_factory=dict)  # what was asked before, by arguments; the last ``ASKED`` of them

    def _once(self, key: tuple, make: Callable[[], Any]) -> Any:  # noqa: ANN401
        if key not in self.known:
            self.known[key] = make()
            while len(self.known) > ASKED:
                self.known.pop(next(iter(self.known)))
        return self.known[key]

    def best(self, phrases: list[str], cap: int) -> list[tuple[str, float]]:
        """(span_ref, bm25) of the ``cap`` best spans; no text is read.  In a large index, places are compared only where
        the rarest trigram stands."""
        frequency = self.frequencies if self.count > FEW_SPANS else None

        def make() -> list[tuple[str, float]]:
            rows = indexed_bm25(self.postings, self.count, self.average, phrases, frequency)
            return [(r["span_ref"], r["bm25"]) for r in rows.orderBy(F.desc("bm25"), *STABLE).limit(cap).select("span_ref", "bm25").collect()]

        return self._once(("best", tuple(phrases), cap), make)

    def short(self, terms: list[str], cap: int) -> list[str]:
        """The first ``cap`` spans, in source order, that hold a term of one or two characters; no text is read."""
        return self._once(("short", tuple(terms), cap), lambda: [r["span_ref"] for r in short_spans(self.postings, terms).orderBy(*STABLE).limit(cap).select("span_ref").collect()])

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """Spans that hold each trigram."""
        make = lambda: {r["term"]: r["df"] for r in self.terms.filter(F.col("term").isin(*terms)).groupBy("term").agg(F.sum("df").alias("df")).collect()}
        return self._once(("frequencies", tuple(terms)), make) if terms else {}


def candidates(spans: DataFrame, terms: list[str], aliases: list[str], expansion: list[str], limit: int, merge: bool = True, index: Index | None = None) -> DataFrame:
    """The bounded candidate set of one pass, each row once, with its ``bm25`` (null unless an original phrase found it).

    With an index, phrases are found and ranked in it, and only the rows chosen (at most 512) are read from ``spans``.
    """
    most, fewer = min(512, max(64, 12 * limit)), min(256, max(64, 4 * limit))
    unranked = F.lit(None).cast("double").alias("bm25")

    def scanned(found: list[str], cap: int) -> DataFrame:
        return spans.filter(_any_folded(found)).orderBy(*STABLE).limit(cap).select("*", unranked)

    def phrases(found: list[str], cap: int, scored: bool) -> DataFrame:
        if not merge:
            return scanned(found, cap)
        rows = add_bm25(spans, found).orderBy(F.desc("bm25"), *STABLE).limit(cap)
        return rows if scored else rows.withColumn("bm25", unranked)

    long_terms, long_expansion = [t for t in terms if len(t) >= 3], [t for t in expansion if len(t) >= 3]
    short, short_expansion = [t for t in [*terms, *aliases] if len(t) < 3], [t for t in expansion if len(t) == 2]
    if index is not None and merge:
        return _indexed(spans, index, (long_terms, most), (long_expansion, fewer), (short, fewer), (short_expansion, fewer))
    parts = []
    if long_expansion:
        parts.append(phrases(long_expansion, fewer, False))
    if long_terms:
        parts.append(phrases(long_terms, most, True))
    if short:
        parts.append(scanned(short, fewer))
    if not parts and not short_expansion:
        return spans.limit(0).select("*", unranked)
    pool = merged(parts) if parts else None
    if short_expansion and (pool is None or not long_terms or pool.count() < most):
        extra = scanned(short_expansion, fewer)
        pool = extra if pool is None else merged([pool, extra])
    return pool


def _indexed(spans: DataFrame, index: Index, terms: tuple[list[str], int], expansion: tuple[list[str], int], short: tuple[list[str], int], short_expansion: tuple[list[str], int]) -> DataFrame:
    """The candidates by the index, each a list of terms and its cap: references are chosen there (at most 1,280 of them),
    then their rows are read, once."""
    chosen: dict[str, float | None] = {}
    if expansion[0]:
        chosen |= dict.fromkeys((r for r, _ in index.best(*expansion)), None)
    if terms[0]:
        chosen |= dict(index.best(*terms))
    if short[0]:
        chosen |= {r: chosen.get(r) for r in index.short(*short)}
    if short_expansion[0] and (not terms[0] or len(chosen) < terms[1]):
        chosen |= {r: chosen.get(r) for r in index.short(*short_expansion)}
    marks = spans.sparkSession.createDataFrame(list(chosen.items()), "span_ref string, bm25 double")
    found = spans.filter(F.col("span_ref").isin(*chosen)).join(F.broadcast(marks), "span_ref").select(*spans.columns, "bm25")
    return found.repartition(POOL_TASKS)  # few rows from many files: a few tasks score them


def merged(parts: list[DataFrame]) -> DataFrame:
    """Candidates of all sources, each span once: a row that an original phrase found (with ``bm25``) goes before others."""
    pool = parts[0]
    for p in parts[1:]:
        pool = pool.unionByName(p)
    order = Window.partitionBy("span_ref").orderBy(F.desc_nulls_last("bm25"))
    return pool.withColumn("k", F.row_number().over(order)).filter("k = 1").drop("k")


EXPANSION = "array<struct<term:string,weight:double>>"


@F.pandas_udf(DoubleType())
def _near(text: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([proximity(t.lower(), [*x, *y]) for t, x, y in zip(text, a, b, strict=True)], dtype="float64")


def factored(pool: DataFrame, terms: Column, aliases: Column, expansion: Column, weight: float, disabled: frozenset[str] = frozenset()) -> DataFrame:
    """Candidates with what they match, ``score``, its factors and ``trust``.

    terms, aliases: arrays of strings; expansion: array of (term, weight); they may differ from row to row.
    """
    heading, content = F.lower(F.col("heading")), F.lower(F.col("content"))

    def matched(wanted: Column) -> Column:
        return F.filter(wanted, lambda t: F.contains(heading, t) | F.contains(content, t))

    on = {f: f not in disabled for f in FACTORS}
    found = F.filter(expansion, lambda e: F.contains(heading, e["term"]) | F.contains(content, e["term"]))
    rows = pool.withColumns({"matched": matched(terms), "alias_matched": matched(aliases), "found": found, "heaviest": F.array_max(F.transform(expansion, lambda e: e["weight"]))})
    some = F.size("matched") > 0
    length = F.aggregate("matched", F.lit(0), lambda s, t: s + F.length(t))
    best = F.coalesce(F.array_max(F.transform("found", lambda e: e["weight"])), F.lit(0.0))
    factors = {
        "coverage": F.least(F.lit(1.0), length / F.lit(12.0)) * 4 if on["coverage"] else F.lit(0.0),
        "alias": F.least(F.lit(0.75), F.size("alias_matched") * F.lit(0.5)) if on["alias"] else F.lit(0.0),
        "proximity": _near("content", "matched", "alias_matched") if on["proximity"] else F.lit(0.0),
        "in_heading": F.size(F.filter("matched", lambda t: F.contains(heading, t))) * F.lit(0.5) if on["heading"] else F.lit(0.0),
        "rank_term": F.least(F.lit(1.0), F.coalesce("bm25", F.lit(0.0)) / 10) if on["bm25Term"] else F.lit(0.0),
        "trust_bonus": F.when(some, 0.25).otherwise(0.0) if on["trust"] else F.lit(0.0),
        "expansion": best * F.when(F.col("heaviest") != 0, F.lit(float(weight)) / F.col("heaviest")).otherwise(0.0),
    }
    rows = rows.withColumns(factors)
    total = F.lit(0.0)
    for name in factors:
        total = total + F.col(name)
    rows = rows.withColumns({"score": total, "trust": F.when(some, "deterministic").otherwise("heuristic"), "expansion_matched": F.transform("found", lambda e: e["term"])})
    return rows.drop("found", "heaviest")


def with_excerpt(rows: DataFrame) -> DataFrame:
    """Chosen rows with ``excerpt`` and its pieces, around what they match."""
    return rows.withColumn("x", excerpt_column(F.col("content"), F.col("matched"), F.col("alias_matched"), F.col("expansion_matched"))).select(*rows.columns, "x.excerpt", "x.pieces")


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(t) for t in values]) if values else F.array().cast("array<string>")


def score(pool: DataFrame, terms: list[str], aliases: list[str], expansion: list[tuple[str, float]], weight: float, limit: int, disabled: frozenset[str] = frozenset()) -> DataFrame:
    """Candidates with ``score``, its factors, ``trust`` and ``excerpt``; best first."""
    weighed = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(float(w)).alias("weight")) for t, w in expansion]) if expansion else F.array().cast(EXPANSION)
    rows = factored(pool, _strings(terms), _strings(aliases), weighed, weight, disabled)
    return with_excerpt(rows.orderBy(F.desc("score"), "relative_path", "start_line", "span_ref").limit(limit))


def feedback_terms(text: Column) -> Column:
    """Distinct Latin terms of a source that feedback may add."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9][a-z0-9_'-]*)"), 1))
    return F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(*sorted(w for w in FEEDBACK_STOP if w.isascii())))


def feedback_tokens(text: str) -> set[str]:
    out: set[str] = set()
    for token in _TOKEN.findall(unicodedata.normalize("NFKC", text).lower()):
        grams = _grams(token) if _is_han(token) and len(token) > 4 else [token] if len(token) > 1 else []
        out.update(g for g in grams if g not in FEEDBACK_STOP)
    return out


def cooccurrence(sources: DataFrame, terms: Column, group: list[str] = ()) -> DataFrame:
    """sources(rank, ...) -> (group, term, sources, cooccurrence): terms of at least two sources, weighted by rank."""
    each = sources.select(*group, "rank", F.explode(F.array_distinct(terms)).alias("term"))
    ranks = F.array_sort(F.collect_list("rank"))  # of the few best; added up in order, so the sum is always the same
    return each.groupBy(*group, "term").agg(F.count("*").alias("sources"), F.aggregate(ranks, F.lit(0.0), lambda t, r: t + F.lit(1.0) / r).alias("cooccurrence")).filter("sources >= 2")


def known_aliases(aliases: DataFrame, terms: list[str]) -> set[str]:
    """Of a bounded list of ``terms``, those that are aliases."""
    wanted = aliases.sparkSession.createDataFrame([(t,) for t in terms], "normalized_alias string")
    return {r["normalized_alias"] for r in wanted.join(aliases.select("normalized_alias"), "normalized_alias", "left_semi").collect()} if terms else set()


def derive_feedback(sources: list[tuple[str, str]], original: list[str], aliases: DataFrame | None, spans: DataFrame, config: dict = PRODUCTION, index: Index | None = None) -> list[tuple[str, float]]:
    """(term, weight) added by the best ``top_k`` results: terms of at least two of them, by rank and rarity.

    aliases(normalized_alias): names that are never added; only the terms in question are looked up in it.
    """
    validate_feedback(config)
    skip = {unicodedata.normalize("NFKC", t).lower() for t in original}
    seen: dict[str, list[float]] = {}
    for rank, (heading, excerpt) in enumerate(sources[: config["top_k"]]):
        for t in feedback_tokens(f"{heading}\n{excerpt}") - skip:
            seen.setdefault(t, []).append(1 / (rank + 1))
    if aliases is not None:
        for t in known_aliases(aliases, sorted(t for t, w in seen.items() if len(w) >= 2)):
            del seen[t]
    pool = sorted(((t, sum(w)) for t, w in seen.items() if len(w) >= 2), key=lambda x: (-x[1], x[0]))[:FEEDBACK_POOL]
    if not pool:
        return []
    exact = [t for t, _ in pool if len(t) == 3]
    if index is not None:
        total, found = index.count, index.frequencies(exact)
        df = {t: found.get(t, 0) for t in exact}
    else:
        low_h, low_c = F.lower("heading"), F.lower("content")
        counted = spans.agg(F.count("*").alias("n"), *[F.count_if(F.contains(low_h, F.lit(t)) | F.contains(low_c, F.lit(t))).alias(f"t{k}") for k, t in enumerate(exact)]).first()
        total, df = counted["n"], {t: counted[f"t{k}"] for k, t in enumerate(exact)}
    ranked = [(t, w * (math.log((total + 1) / (df.get(t, total) + 1)) + 1)) for t, w in pool]
    return sorted(ranked, key=lambda x: (-x[1], x[0]))[: config["terms"]]


def validate_feedback(config: dict) -> None:
    if any(config.get(k) not in allowed for k, allowed in GRID.items()):
        raise ValueError("INVALID_SEARCH_EXPERIMENT: feedback settings must belong to the calibration grid")


def search(spans: DataFrame, query: str, limit: int = 20, config: dict | None = PRODUCTION, aliases: DataFrame | None = None, disabled: frozenset[str] = frozenset(), index: Index | None = None) -> tuple[DataFrame, list[dict]]:
    """(ranked rows, diagnostics).  With ``config`` a second pass adds feedback terms from the first.

    spans needs span_ref, relative_path, start_line, source_ordinal, ordinal, heading, content.  Between the passes the
    driver sees at most ``top_k`` excerpts; everything else stays in the two plans.
    """
    terms = analyze_query(query)
    if not terms:
        return spans.limit(0), [{"code": "NO_MATCHING_TERMS"}]
    near = [] if "alias" in disabled else alias_terms(terms)
    notes = [{"code": "QUERY_ANALYZED", "terms": len(terms)}]

    def one_pass(expansion: list[tuple[str, float]], keep: int) -> DataFrame:
        pool = candidates(spans, terms, near, [t for t, _ in expansion], keep, "ftsMerge" not in disabled, index)
        return score(pool, terms, near, expansion, config["weight"] if config else 0.0, keep, disabled)

    first = one_pass([], max(limit, config["top_k"]) if config else limit)
    if not config:
        return first, notes
    best = [(r["heading"], r["excerpt"]) for r in first.select("heading", "excerpt").limit(config["top_k"]).collect()]
    added = derive_feedback(best, terms, aliases, spans, config, index)
    if not added:
        return first.limit(limit), [*notes, {"code": "PRF_NO_EXPANSION"}, *([] if best else [{"code": "NO_RESULTS"}])]
    return one_pass(added, limit), [*notes, {"code": "PRF_EXPANDED", "terms": [t for t, _ in added]}]
