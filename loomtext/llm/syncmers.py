"""Document fingerprints from closed syncmers; DataFrame functions only.

A text is a row of units: a letter of a script without cases (Han, kana, Arabic and the like) by itself, and other runs
without blanks in pieces of at most ``PIECE`` code points, A-Z lower-cased.  Of all runs of ``K`` units those are anchors
whose least inner run of ``S`` units (by hash) stands at their beginning or end.  Whether a run is an anchor follows from
its own units alone, so an edit moves only the anchors it touches, and at most ``K - S`` runs lie between two anchors.
The fingerprint holds every anchor of the text, in order: one hexadecimal digit for the distance from the anchor before,
seven for the hash.  Its length follows the text; nothing is sampled.

Likeness is positional.  Anchors of one hash that follow each other in the common order of both fingerprints are a
candidate pair; it counts if its displacement is nought or that of another pair as well, so chance agreements of single
phrases do not count, while a passage that was moved as a whole does.  The likeness is the share of all anchors of both
that are in a pair that counts: 1 for equal fingerprints, 0 where one is empty and the other not.

The next document is found without a sort of the whole table in one task: ids are cut into ranges, the texts go once to
their range, and each range also gets the first document of the range after it.

Cases: a null text is empty and has an empty fingerprint, as has one of blanks; a text of fewer than ``K`` units has one
anchor, of all its units; documents stand in descending order of the id, repeated ids by the hash of the text, null ids
last, and each row of a repeated document is a document; one document alone is its own next; an id is a number; other
columns are not read; an empty table stays empty; whole texts are used, in time that follows their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.llm.common import content_key, partitions

K, S = 5, 2
PIECE = 8
UNIT = r"\p{Lo}|[^\s\p{Lo}]{1,%d}" % PIECE
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH_BITS, PLACE_BITS = 28, 28
RANGES_A_PARTITION = 4


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps use several times: a generator keeps Catalyst from evaluating them at each use."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def _from(array: Column, k: int) -> Column:
    """The array from its element number k (from 0)."""
    return F.slice(array, k + 1, F.greatest(F.size(array) - k, F.lit(0)))


def with_anchors(df: DataFrame, text_col: str, into: str) -> DataFrame:
    """``df`` with the anchors of a text as an array of numbers: hash, then place (28 bits each), in order of place."""
    u, s = f"_{into}_units", f"_{into}_inner"
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    df = once(df, **{u: F.transform(F.regexp_extract_all(low, F.lit(UNIT), F.lit(0)), lambda x: F.xxhash64(x))})
    df = once(df, **{s: F.zip_with(F.slice(u, 1, F.greatest(F.size(u) - 1, F.lit(0))), _from(F.col(u), 1), lambda a, b: F.xxhash64(a, b))})
    runs = F.size(u) - (K - 1)
    inner = F.arrays_zip(*[F.slice(s, k + 1, F.greatest(runs, F.lit(0))).alias(f"s{k}") for k in range(K - S + 1)])

    def anchor(z: Column, i: Column) -> Column:
        at = [z[f"s{k}"] for k in range(K - S + 1)]
        code = F.shiftrightunsigned(F.xxhash64(at[0], at[2], at[3]), 64 - HASH_BITS)
        return F.when(F.least(*at) == F.least(at[0], at[-1]), F.shiftleft(code, PLACE_BITS) + i)

    some = F.filter(F.transform(inner, anchor), lambda x: x.isNotNull())
    whole = F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.array_join(F.col(u).cast("array<string>"), " ")), 64 - HASH_BITS), PLACE_BITS)
    found = F.when(runs > 0, some).when(F.size(u) > 0, F.array(whole)).otherwise(F.array().cast("array<bigint>"))
    return once(df, **{into: found}).drop(u, s)


def _place(anchor: Column) -> Column:
    return anchor.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def fingerprint(anchors: Column) -> Column:
    """The string form: eight hexadecimal digits an anchor, in order."""
    before = F.concat(F.array(F.lit(-1).cast("bigint")), F.transform(anchors, _place))
    digits = F.zip_with(anchors, F.slice(before, 1, F.size(anchors)), lambda x, b: F.hex(F.shiftleft(_place(x) - b, HASH_BITS) + F.shiftrightunsigned(x, PLACE_BITS)))
    return F.lower(F.array_join(digits, ""))


def with_likeness(df: DataFrame, a: str, b: str, into: str) -> DataFrame:
    """``df`` with the likeness (0 to 1) of two arrays of anchors."""
    both, pairs, at = f"_{into}_both", f"_{into}_pairs", f"_{into}_at"
    one = F.lit(1).cast("bigint")
    merged = F.sort_array(F.concat(F.transform(a, lambda x: F.shiftleft(x, 1)), F.transform(b, lambda x: F.shiftleft(x, 1) + one)))
    df = once(df, **{both: F.when(F.col(a) != F.col(b), merged).otherwise(F.array().cast("array<bigint>"))})
    # The displacement of each neighbouring pair of one hash and two sides, with the place of the pair: displacement in
    # the upper half, so that sorting puts equal ones together.
    offset, low = 1 << PLACE_BITS, 1 << 31

    def displacement(x: Column, y: Column) -> Column:
        same = (F.shiftright(x, PLACE_BITS + 1) == F.shiftright(y, PLACE_BITS + 1)) & (x.bitwiseXOR(y).bitwiseAND(one) == 1)
        d = (_place(F.shiftright(y, 1)) - _place(F.shiftright(x, 1))) * F.when(x.bitwiseAND(one) == 0, 1).otherwise(-1)
        return F.when(same, d + offset)

    shifted = F.zip_with(F.slice(both, 1, F.greatest(F.size(both) - 1, F.lit(0))), _from(F.col(both), 1), displacement)
    numbered = F.filter(F.transform(shifted, lambda d, i: d * low + i), lambda x: x.isNotNull())
    df = once(df, **{pairs: F.sort_array(numbered)})
    top = lambda x: F.shiftright(x, 31)
    nothing = F.array(F.lit(-1).cast("bigint"))
    around = F.arrays_zip(F.col(pairs).alias("x"), F.concat(nothing, F.slice(pairs, 1, F.greatest(F.size(pairs) - 1, F.lit(0)))).alias("p"), F.concat(_from(F.col(pairs), 1), nothing).alias("n"))
    counts = F.filter(around, lambda z: (top(z["x"]) == offset) | (top(z["x"]) == top(z["p"])) | (top(z["x"]) == top(z["n"])))
    places = F.sort_array(F.transform(counts, lambda z: z["x"].bitwiseAND(F.lit(low - 1))))
    df = once(df, **{at: F.when(F.size(pairs) > 0, places).otherwise(F.array().cast("array<bigint>"))})
    # A pair covers two neighbouring anchors; pairs that share one cover it once.
    steps = F.zip_with(at, F.concat(_from(F.col(at), 1), F.array(F.lit(1 << 40).cast("bigint"))), lambda x, y: F.least(F.lit(2), y - x))
    covered = F.when(F.size(at) > 0, F.aggregate(steps, F.lit(0).cast("bigint"), lambda t, x: t + x)).otherwise(0)
    total = F.size(a) + F.size(b)
    return df.withColumn(into, F.when(F.col(a) == F.col(b), 1.0).otherwise(covered / total)).drop(both, pairs, at)


def with_next(docs: DataFrame) -> DataFrame:
    """docs(id, text) -> id, text, the columns of :func:`with_anchors` as ``anchors``, next_text, next_anchors.

    ``next`` is the row after each in descending order of id; after the last comes the first.
    """
    spark = docs.sparkSession
    ranges = RANGES_A_PARTITION * partitions(spark)
    cuts = docs.agg(F.percentile_approx("id", [k / ranges for k in range(1, ranges)], 10 * ranges).alias("c")).first()["c"] or []
    edges = F.lit(sorted(set(cuts))) if cuts else F.array().cast("array<bigint>")
    ranged = docs.withColumn("range_no", F.size(F.filter(edges, lambda c: c < F.col("id"))))
    ranged = ranged.withColumn("range_no", F.when(F.col("id").isNull(), -1).otherwise(F.col("range_no")))
    order = [F.col("guest"), F.desc_nulls_last("id"), "th", "tl"]
    # The first id of every range, and the range before which it comes: a row for each range.
    firsts = ranged.groupBy("range_no").agg(F.max("id").alias("id"))
    down = Window.orderBy(F.desc("range_no"))
    to = F.coalesce(F.lag("range_no").over(down), F.min("range_no").over(Window.partitionBy()))
    seams = F.broadcast(firsts.select(F.col("id").alias("first_id"), to.alias("to")))
    keyed = docs.select("id", "text", *content_key())
    leading = keyed.join(seams, F.col("id").eqNullSafe(F.col("first_id"))).groupBy("to").agg(F.min_by(F.struct("id", "text", "th", "tl"), F.struct("th", "tl")).alias("r"))
    guests = leading.select("r.id", "r.text", "r.th", "r.tl", F.col("to").alias("range_no"), F.lit(True).alias("guest"))
    own = ranged.select("id", "text", *content_key(), "range_no", F.lit(False).alias("guest"))
    rows = own.unionByName(guests).repartition("range_no")
    rows = with_anchors(rows, "text", "anchors")
    w = Window.partitionBy("range_no").orderBy(*order)
    rows = rows.withColumn("next_text", F.lead("text").over(w)).withColumn("next_anchors", F.lead("anchors").over(w))
    return rows.filter(~F.col("guest")).select("id", "text", "anchors", "next_text", "next_anchors")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, anchors, fingerprint of every text."""
    rows = with_anchors(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")), "text", "anchors")
    return rows.select(id_col, "anchors", fingerprint(F.col("anchors")).alias("fingerprint"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text, its edited text (the last third replaced by as much of the beginning of the next) and their likeness."""
    rows = with_next(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))
    rows = once(rows, n_chars=F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = once(rows, edited_text=F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third)))
    rows = with_anchors(rows, "edited_text", "edited_anchors")
    rows = with_likeness(rows, "anchors", "edited_anchors", "near_edited")
    return with_likeness(rows, "anchors", "next_anchors", "near_next").withColumnRenamed("id", id_col)


def op13_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        fingerprint(F.col("anchors")).alias("fingerprint"), fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"), "near_edited", "near_next",
    )
