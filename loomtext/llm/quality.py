"""Quality rules from line frequencies across documents; DataFrame functions only.

Lines are normalised (lower case, single spaces) and hashed.  For each host and line the *distinct* documents that
carry it are counted, copies of one text counting once.  A line is above the limit of its host when more than
``max(MIN_DOCS, SHARE * distinct documents of the host)`` documents carry it; such a line is removed from all of them
but its first carrier (least id).  A document left with under ``MIN_KEPT`` of its words is depleted and rejected.
The limit is a share of the host, so it means the same at every size of corpus; the first carrier keeps its lines, so a
group of near copies never disappears altogether.

Cases: a null or empty text has no words and fails the base rules; a null host is the host ``''``; a null id is an id
like any other (and comes first); repeated rows are one distinct document and get equal results; ties in the first
carrier go to the lesser text hash; columns other than id, host and text are not read; an empty table gives an empty
result.  Whole texts are used; a row is worked on alone until the line counts, which are summed before they move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import content_key, materialise

MIN_DOCS = 20
SHARE = 0.01
MIN_KEPT = 0.3
# Fixed values of the base rules.
MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps use several times: a generator keeps Catalyst from evaluating them at each use."""
    made = F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()])))
    return df.select("*", made)


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " ", -1), lambda w: w != "")


def base_rules(docs: DataFrame) -> DataFrame:
    """docs(id, host, text) -> id, host, th, tl and the base measures."""
    text = F.coalesce(F.col("text"), F.lit(""))
    line = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    df = _once(docs.select("id", "host", *content_key(), text.alias("text")), words=F.transform(word_array(F.col("text")), lambda w: F.xxhash64(w)), lines=line)
    df = df.select(
        "id", "host", "th", "tl", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    count = F.col("n_words").cast("int") - (WINDOW - 1)
    shifted = F.arrays_zip(*[F.slice("words", k + 1, count).alias(f"w{k}") for k in range(WINDOW)])
    hashes = F.transform(shifted, lambda z: F.xxhash64(*[z[f"w{k}"] for k in range(WINDOW)]))
    df = _once(df, windows=F.when(count > 1, hashes).otherwise(F.array().cast("array<bigint>"))).drop("words")
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = _once(df, placed=F.when(again, placed)).drop("windows")
    pairs = F.zip_with(
        F.slice("placed", 1, F.size("placed") - 1), F.slice("placed", 2, F.size("placed") - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    df = _once(df, at=F.when(F.col("placed").isNotNull(), F.array_sort(F.array_distinct(F.flatten(pairs))))).drop("placed")
    steps = F.zip_with("at", F.concat(F.slice("at", 2, F.size("at")), F.array(F.element_at("at", -1) + WINDOW)), lambda a, b: F.least(F.lit(WINDOW), b - a))
    repeats = F.when(F.col("at").isNotNull(), F.aggregate(steps, F.lit(0), lambda s, x: s + x)).otherwise(0).cast("long")
    df = df.withColumn("n_repeat_words", repeats).drop("at")
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _normal(line: Column) -> Column:
    """(hash of the normalised line, its words)."""
    words = word_array(F.lower(line))
    return F.struct(F.xxhash64(F.array_join(words, " ")).alias("line"), F.size(words).alias("words"))


def removed_lines(docs: DataFrame) -> DataFrame:
    """docs(id, host, text) -> host, th, tl, removed_words, removed (line hashes), for texts that lose lines."""
    keyed = docs.select("id", "host", *content_key(), F.explode(F.transform(F.split("text", "\n", -1), _normal)).alias("l"))
    # Written out once: the counts and the removal both read it, and texts are cut into lines only once.
    carried, _ = materialise(keyed.filter("l.words > 0").groupBy("host", F.col("l.line").alias("line"), "th", "tl").agg(F.min("id").alias("id"), F.max("l.words").alias("words"), F.count("*").alias("copies")))
    hosts = docs.select("host", *content_key()).distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    # ``copies`` counts lines of all rows with the text; a row's own lines are recovered from the rows.
    rows = docs.select("host", *content_key()).groupBy("host", "th", "tl").agg(F.count("*").alias("rows"))
    often = carried.groupBy("host", "line").agg(F.count("*").alias("docs")).filter(F.col("docs") > MIN_DOCS)
    # Written out, so that both sides of the next join are dealt for it, and a line that very many carry can be split.
    often, _ = materialise(often.join(hosts, "host").filter(F.col("docs") > SHARE * F.col("host_docs")).select("host", "line"))
    hit = carried.join(often, ["host", "line"])
    first, _ = materialise(hit.groupBy("host", "line").agg(F.min(F.struct("id", "th", "tl")).alias("first")).select("host", "line", F.col("first.th").alias("first_th"), F.col("first.tl").alias("first_tl")))
    lost = hit.join(first, ["host", "line"]).filter((F.col("th") != F.col("first_th")) | (F.col("tl") != F.col("first_tl")))
    by_text = lost.groupBy("host", "th", "tl").agg(F.sum(F.col("words") * F.col("copies")).alias("all_words"), F.collect_set("line").alias("removed"))
    return by_text.join(rows, ["host", "th", "tl"]).select("host", "th", "tl", (F.col("all_words") / F.col("rows")).cast("long").alias("removed_words"), "removed")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """id, th, tl, the base measures, base_failed, removed_words, removed (hashes of removed lines), kept."""
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    df = base_rules(docs).join(removed_lines(docs), ["host", "th", "tl"], "left")
    lost = F.coalesce("removed_words", F.lit(0))
    depleted = (lost > 0) & (F.col("n_words") - lost < MIN_KEPT * F.col("n_words"))
    return df.select(
        F.col("id").alias(id_col), "host", "th", "tl", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        lost.alias("removed_words"), "removed", (~F.col("base_failed") & ~depleted).alias("kept"),
    )


def clean_text(text: Column, removed: Column) -> Column:
    """``text`` without the lines whose hashes are in ``removed``."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains(removed, _normal(x)["line"]))
    return F.when(removed.isNull(), text).otherwise(F.array_join(lines, "\n"))


def keep_good(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (as they are) that the rules keep."""
    host, text = F.coalesce(F.col("source").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    kept = quality_rules(docs).filter("kept").select("host", "th", "tl").distinct()
    tagged = docs.select(F.struct("*").alias("row"), host.alias("host"), *content_key())
    return tagged.join(kept, ["host", "th", "tl"], "left_semi").select("row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, k) AS c
  FROM (SELECT rid, p, array_to_string(list_slice(ws, p, p + 4), chr(1)) AS k
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS p FROM w WHERE len(ws) >= 5))),
rep AS (SELECT rid, count(DISTINCT q) AS n_repeat_words FROM (SELECT rid, unnest(range(p, p + 5)) AS q FROM win WHERE c > 1) GROUP BY rid),
l AS (SELECT rid, doc_id, host, text, line, n, len(n) AS nw FROM (
        SELECT rid, doc_id, host, text, line, list_filter(string_split_regex(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS n
        FROM (SELECT rid, doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d)) WHERE len(n) > 0),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY rid),
h AS (SELECT host, count(DISTINCT text) AS host_docs FROM d GROUP BY host),
o AS (SELECT l.host, n, arg_min(text, doc_id) AS keeper FROM l GROUP BY l.host, n
      HAVING count(DISTINCT text) > 20 AND count(DISTINCT text) > 0.01 * (SELECT host_docs FROM h WHERE h.host = l.host)),
lost AS (SELECT rid, sum(nw) AS lost FROM l JOIN o ON l.host = o.host AND l.n = o.n AND l.text <> o.keeper GROUP BY rid),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
      FROM w LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN lost USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (lost > 0 AND n_words - lost < 0.3 * n_words) AS kept
FROM m
"""
