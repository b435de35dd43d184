"""Items, queries and terms that are many, common, short or empty, against DuckDB and row-at-a-time versions."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from loomtext.operators import batch_search, evaluate, fulltext, search
from loomtext.plans import catalogue


def _tables(spark, folder, texts, items):
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def _sql(folder, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return c.sql(catalogue.oracle_sql()[name]).fetchall()


def test_phrase_candidates_of_short_empty_and_common_items(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "THEN", "thesis", "ab", "Ä", "q"]) for _ in range(rng.randint(0, 40))) for _ in range(40)] + [None, "", "a"]
    items = [(0, "the then"), (1, ""), (2, "ä"), (3, "AB"), (4, None), (5, "the then"), (6, "nowhere"), (6, "thesis THE")]
    folder = _tables(spark, tmp_path, texts, items)
    want = sorted(_sql(folder, "joi11_phrase_candidates"))
    for most in (evaluate.AUTOMATON_QUOTES, 0):
        monkeypatch.setattr(evaluate, "AUTOMATON_QUOTES", most)
        got = sorted((r["item_id"], r["doc_id"]) for r in catalogue.queries()["joi11_phrase_candidates"](spark, folder).select("item_id", "doc_id").collect())
        assert got == want and {i for i, _ in got} == {0, 1, 2, 3, 5, 6}


def test_phrases_meet_postings_on_their_rarest_trigram(spark):
    """A phrase of many common trigrams pairs only with spans of its rarest one, and loses none that hold it."""
    texts = ["the thesis then"] * 30 + ["the thesis then zebra"] * 2 + ["zebu"]
    rows = spark.createDataFrame([("w", f"s{i}", "", t, i, 0) for i, t in enumerate(texts)], "work_ref string, span_ref string, heading string, content string, source_ordinal int, ordinal int")
    phrases = spark.createDataFrame([("thesis then zebra",), ("the xylem",), ("then",)], "phrase string")
    found = fulltext.phrase_candidates(fulltext.postings(rows), phrases)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "have" not in plan  # no row for each trigram that a phrase and a span share
    got = found.groupBy("phrase").agg(F.count("*").alias("n")).collect()
    assert {(r["phrase"], r["n"]) for r in got} == {("thesis then zebra", 2), ("then", 32)}


def test_many_phrases_are_walked(spark, monkeypatch):
    """Searches of many phrases give the rows of one search each, without reading a posting, in blocks and groups of any size."""
    rng = random.Random(21)
    words = [a + b for a in ("am", "ber", "ce", "du", "em", "fjo") for b in ("ra", "ne", "dle", "ko", "sti", "x")] + ["ab", "q", "aa", "aaaa"]
    made = [(f"s{i:03}", f"p{i % 7}.md", rng.choice(words), " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), i % 40, i // 40, 1) for i in range(90)]
    rows = spark.createDataFrame(made, "span_ref string, relative_path string, heading string, content string, source_ordinal int, ordinal int, start_line int").withColumn("work_ref", F.lit("w")).repartition(3).cache()
    posted = fulltext.postings(rows, places=True).cache()
    total = rows.agg(F.count("*").alias("n"), F.avg(fulltext.trigram_count(F.col("heading")) + fulltext.trigram_count(F.col("content"))).alias("a")).first()
    index = search.Index(posted, fulltext.document_frequency(posted), total["n"], total["a"])
    asked = [" ".join(rng.sample(words, rng.randint(1, 12))) for _ in range(9)] + ["q", "aa aaa", "?", "zzz"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    shape = lambda r: (r["query_id"], r["rank"], r["span_ref"], round(r["score"], 9), r["excerpt"], r["trust"])
    for config, limit in ((None, 3), (search.PRODUCTION, 5)):
        monkeypatch.setattr(batch_search, "FEW_PHRASES", 10**6)
        want = sorted(map(shape, batch_search.search_many(queries, rows, index, limit, config).collect()))
        monkeypatch.setattr(batch_search, "FEW_PHRASES", 0)
        monkeypatch.setattr(batch_search, "BLOCK_ROWS", 40)
        monkeypatch.setattr(batch_search, "_posted", None)
        unread = search.Index(posted.filter(F.raise_error(F.lit("postings were read")).isNotNull()), index.terms, index.count, index.average)
        got = sorted(map(shape, batch_search.search_many(queries, rows, unread, limit, config).collect()))
        assert got == want and {r[0] for r in got} >= set(range(9))
        monkeypatch.undo()


def test_walks_keep_what_can_be_chosen(spark, monkeypatch):
    """More spans than the caps, in several batches of each task: the best by weight and the first of those that weigh alike."""
    monkeypatch.setattr(batch_search, "WALKED", 50)
    monkeypatch.setattr(batch_search, "GROUP", 2)
    monkeypatch.setattr(batch_search, "FEW_PHRASES", 0)
    rng = random.Random(4)
    made = [(f"s{i:04}", f"p{i:04}.md", "", "amber " * rng.randint(0, 3) + "brook " * rng.randint(0, 2) + rng.choice(["", "ab", "q"]), i, 0, 1) for i in range(900)]
    rows = spark.createDataFrame(made, "span_ref string, relative_path string, heading string, content string, source_ordinal int, ordinal int, start_line int").withColumn("work_ref", F.lit("w")).repartition(2)
    total = rows.agg(F.count("*").alias("n"), F.avg(fulltext.trigram_count(F.col("content"))).alias("a")).first()
    index = search.Index(fulltext.postings(rows, places=True), None, total["n"], total["a"])
    asked = ["amber brook", "amber", "ab", "brook q", "q ab"]
    none = F.array().cast(search.EXPANSION)
    queries = batch_search.analysed(spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")).withColumn("expansion", none)
    got = {(r["query_id"], r["span_ref"], r["bm25"] and round(r["bm25"], 9)) for r in batch_search.candidates(queries, rows, index, 5).collect()}
    want = set()
    for k, q in enumerate(asked):
        pool = search.candidates(rows, search.analyze_query(q), [], [], 5)
        want |= {(k, r["span_ref"], r["bm25"] and round(r["bm25"], 9)) for r in pool.collect()}
    assert got == want


def test_packed_places_are_the_places(spark):
    rows = spark.createDataFrame([("w", f"s{i}", "Ab" * (i % 3), "abc 林 😀😀 " * (i % 5) + "x" * (300 * (i == 7)), i, 0) for i in range(12)], "work_ref string, span_ref string, heading string, content string, source_ordinal int, ordinal int")
    shape = lambda df: sorted((r["span_ref"], r["term"], r["tf"], list(r["in_heading"]), list(r["in_content"])) for r in df.collect())
    assert shape(fulltext.unpacked(fulltext.postings(rows, places=True, packed=True))) == shape(fulltext.postings(rows, places=True))


def test_rows_are_sorted_alike_both_ways():
    rng = np.random.default_rng(5)
    for signs, n in ((4, 5000), (0x10FFFF, 3000), (9, 0)):
        doc, code = np.sort(rng.integers(0, 50, n)), sum(rng.integers(0, signs, n) << s for s in (42, 21, 0))
        order = np.lexsort((code, doc))
        for got, want in zip(fulltext._sorted_rows(doc, code), (doc[order], code[order], order), strict=True):
            assert np.array_equal(got, want)


def test_published_index_is_counted_only_when_asked(spark, tmp_path, monkeypatch):
    """Of an index that a query publishes, only the postings are written, with places as bytes."""
    folder, made = _tables(spark, tmp_path, ["the thanedble", "anea quäu"], [(0, "x")]), []
    settled = catalogue.storage.settled
    monkeypatch.setattr(catalogue.storage, "settled", lambda df: made.append(df.schema) or settled(df))
    index = catalogue.published_index(spark, folder)
    assert [s["in_content"].dataType.simpleString() for s in made] == ["binary"]
    assert index.frequencies(["ane", "the", "zzz"]) == {"ane": 2, "the": 1}
