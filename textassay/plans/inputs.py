"""The given tables as labelled corpora.

A document's first line is its title and its language its class. Documents hold
no entities, so the dirty form is derived the way the corruption arises: special
characters are escaped and the ampersand of each entity becomes a space. Pages
hold intact entities; some of them lose their ampersand the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textassay.functions.repair import repair
from textassay.functions.text import body_lines, build_text, class_name, title_line
from textassay.session import spread

LANGUAGES = {1: "en", 2: "fr", 3: "de", 4: "es"}
# The ampersand goes first: the others introduce none.
NAMED_ESCAPES = (("&", "amp"), ('"', "quot"))
NUMERIC_ESCAPES = "$%'*|éóèñçüêäößíÉÈÑÓÇÄÊÜÖÍ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def as_corpus(documents: DataFrame) -> DataFrame:
    """doc_id, label, class_name, source, title, description, text."""
    label = F.lit(None).cast("int")
    for value, lang in LANGUAGES.items():
        label = F.when(F.col("lang") == lang, value).otherwise(label)
    fields = documents.select(
        "doc_id", label.alias("label"), "source",
        title_line(F.col("text")).alias("title"), body_lines(F.col("text")).alias("description"),
    )
    return fields.withColumns({
        "text": build_text(F.col("title"), F.col("description")),
        "class_name": class_name(F.col("label"), LANGUAGES),
    })


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    return as_corpus(table(spark, folder, "documents"))


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a quality judgement, which is their label: 0 or 1."""
    marks = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return corpus(spark, folder).drop("label", "class_name").join(marks, "doc_id")


def drop_ampersands(text: Column) -> Column:
    """Escape special characters, with a space where each ampersand was."""
    for char, name in NAMED_ESCAPES:
        text = F.replace(text, F.lit(char), F.lit(f" {name};"))
    for char in NUMERIC_ESCAPES:
        text = F.replace(text, F.lit(char), F.lit(f" #{ord(char)};"))
    return text


def glue_ampersands(text: Column) -> Column:
    """Each run of ampersands becomes one bare entity, with no space before it."""
    return F.regexp_replace(text, "&+", "amp;")


def glued_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus with ampersands glued to the word before."""
    return corpus(spark, folder).withColumn("text", glue_ampersands(F.col("text")))


def with_dirty(rows: DataFrame) -> DataFrame:
    """``text`` in its dirty form, ``repaired`` and ``original``."""
    return rows.withColumnRenamed("text", "original").withColumn(
        "text", drop_ampersands(F.col("original"))
    ).withColumn("repaired", repair(F.col("text")))


def dirty_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus with ``text`` in its dirty form, ``repaired`` and ``original``."""
    return with_dirty(corpus(spark, folder))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as a corpus: class from the lang attribute, text partly stripped of ampersands.

    ``&amp;`` and ``&quot;`` become bare everywhere, ``&middot;`` becomes a bare
    number on plain-http pages, ``&copy;`` stays intact.
    """
    html = F.regexp_replace("html", "&(amp|quot);", " $1;")
    html = F.when(F.startswith("url", F.lit("http:")), F.replace(html, F.lit("&middot;"), F.lit(" #183;"))).otherwise(html)
    return table(spark, folder, "pages").select(
        F.col("page_id").alias("doc_id"), F.regexp_extract("html", 'lang="(..)"', 1).alias("class_name"),
        html.alias("text"), "html",
    )


def escaped_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of plain-http sites hold escaped markup, all others none. ``label`` tells which."""
    escaped = F.replace(F.replace("html", F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    plain = F.regexp_replace("html", "<[^>]*>", " ")
    text = F.when(F.startswith("url", F.lit("http:")), escaped).otherwise(plain)
    return table(spark, folder, "pages").select(
        F.col("page_id").alias("doc_id"), F.regexp_extract("html", 'lang="(..)"', 1).alias("class_name"), text.alias("text"),
        F.startswith("url", F.lit("http:")).cast("int").alias("label"),
    )
