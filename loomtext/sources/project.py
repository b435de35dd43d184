"""Structured projects: a marker file, books, and files whose place states their kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.numerals import chapter_of_col
from loomtext.functions.text import normalize_name, stable_id
from loomtext.sources.text_files import decode_text, markdown_title

# The places of a book's files.
PLACES = {
    "story/outline/story_frame.md": "outline", "story/story_bible.md": "outline", "story/outline/volume_map.md": "outline", "story/volume_outline.md": "outline",
    "story/current_state.md": "state", "story/pending_hooks.md": "foreshadow", "story/book_rules.md": "document", "story/character_matrix.md": "character",
}
LEGACY_CHARACTERS = "story/character_matrix.md"
ROLE = "(?i)^story/roles/(主要角色|次要角色|major|minor)/([^/]+\\.md)$"


def books(files: DataFrame, marker: str) -> DataFrame:
    """files(relative_path, content) of a project root that holds ``marker`` -> (book, title, work_ref)."""
    has = files.filter(F.col("relative_path") == marker).limit(1).count()
    found = files.filter(F.col("relative_path").rlike("^books/[^/]+/book\\.json$") & F.lit(bool(has)))
    book = F.regexp_extract("relative_path", "^books/([^/]+)/", 1)
    return found.select(book.alias("book"), F.coalesce(F.get_json_object(F.col("content").cast("string"), "$.title"), book).alias("title"), stable_id("work", F.lit("project"), book).alias("work_ref"))


def documents(files: DataFrame, marker: str) -> DataFrame:
    """Documents of all books: fixed places, roles, chapters; the old character file only where a book has no roles."""
    rows = files.withColumn("book", F.regexp_extract("relative_path", "^books/([^/]+)/", 1)).filter("book <> ''")
    rows = rows.withColumn("inner", F.regexp_replace("relative_path", "^books/[^/]+/", ""))
    fixed = F.create_map(*[F.lit(x) for pair in PLACES.items() for x in pair])
    kind = F.coalesce(F.element_at(fixed, F.col("inner")), F.when(F.col("inner").rlike("(?i)^story/roles/.+\\.md$"), "character").when(F.col("inner").rlike("(?i)^chapters/.+\\.md$"), "chapter"))
    rows = rows.withColumn("kind", kind).filter("kind is not null").withColumn("text", decode_text(F.col("content"))).join(F.broadcast(books(files, marker).select("book", "work_ref")), "book")
    tier = F.lower(F.regexp_extract("inner", ROLE, 1))
    is_role = F.col("inner").rlike(ROLE)
    rows = rows.withColumns(
        {
            "role": F.when(is_role, F.concat_ws(":", F.when(tier.isin("主要角色", "major"), "major").otherwise("minor"), normalize_name(F.regexp_extract("inner", ROLE, 2)))).otherwise(F.col("inner")),
            "second": F.when(is_role & tier.isin("major", "minor"), 1).otherwise(0),
        }
    )
    by_role = Window.partitionBy("work_ref", "role")
    same = rows.withColumns({"least": F.min("text").over(by_role), "most": F.max("text").over(by_role), "k": F.row_number().over(by_role.orderBy("second", "inner"))})
    checked = same.withColumn("text", F.when(F.col("least") == F.col("most"), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("ROLE_ALIAS_CONFLICT: "), F.col("role")))))
    one = checked.filter("k = 1")
    roles = F.count_if((F.col("kind") == "character") & (F.col("inner") != LEGACY_CHARACTERS)).over(Window.partitionBy("work_ref"))
    one = one.withColumn("roles", roles).filter((F.col("inner") != LEGACY_CHARACTERS) | (F.col("roles") == 0))
    order = Window.partitionBy("work_ref").orderBy(F.collate("inner", "UNICODE"))
    return one.select(
        "work_ref", stable_id("doc", F.col("work_ref"), F.col("inner")).alias("document_ref"), F.col("inner").alias("relative_path"), markdown_title(F.col("text"), F.col("inner")).alias("title"), "kind", F.col("text").alias("content"),
        F.when(F.col("kind") == "chapter", chapter_of_col(F.regexp_extract("inner", "([^/]*)$", 1))).alias("chapter_number"), F.lit(1).alias("source_start_line"), (F.row_number().over(order) - 1).alias("source_ordinal"),
    )
