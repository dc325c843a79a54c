"""Directory names and the labels source, topic and vigintile, as expressions.

A directory is ``<source>[-<topic>[-<vigintile>]]``. Missing parts are ``-`` for the topic and the empty string for the
vigintile, as the directory catalog has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sources whose directories carry a topic, and the prefix of their group names.
TOPIC_SOURCES = {"common_crawl": "cc:", "olmocr_science_pdfs": "pdf:", "stack_edu": "code:"}

MAX_DIRECTORIES = 100_000  # bound of the directory catalog that the driver reads


def directory(path: Column) -> Column:
    """``data/<dir>/<file>`` -> ``<dir>``."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def parse_dir(name: Column) -> Column:
    """Directory name -> struct(source, topic, vigintile)."""
    numbered = name.rlike(r"-\d+$")
    head = F.regexp_replace(name, r"-\d+$", "")
    known = F.regexp_extract(name, f"^({'|'.join(TOPIC_SOURCES)})-", 1)
    source = F.when(numbered, F.regexp_extract(head, r"^[^-]*", 0)).when(known != "", known).otherwise(name)
    topic = (
        F.when(numbered, F.regexp_extract(head, r"^[^-]*-?(.*)$", 1))
        .when(known != "", F.regexp_replace(name, f"^({'|'.join(TOPIC_SOURCES)})-", ""))
        .otherwise("-")
    )
    vigintile = F.when(numbered, F.right(F.regexp_extract(name, r"-(\d+)$", 1), F.lit(2))).otherwise("")
    return F.struct(source.alias("source"), topic.alias("topic"), vigintile.alias("vigintile"))


def group_name(source: Column, topic: Column) -> Column:
    """``cc:``, ``pdf:`` or ``code:`` and the topic for the sources that have topics, else the source."""
    out = source
    for known, prefix in TOPIC_SOURCES.items():
        out = F.when(source == known, F.concat(F.lit(prefix), topic)).otherwise(out)
    return out


def source_of(name: Column) -> Column:
    """A directory name without its ``-00NN``."""
    return F.regexp_replace(name, r"-\d{4}$", "")


def _plain(label: Column) -> Column:
    """Case, white space, hyphens and underscores folded."""
    return F.regexp_replace(F.regexp_replace(F.lower(label), r"[\s_-]+", "_"), "^_+|_+$", "")


def canonical(df: DataFrame, catalog: DataFrame, source: str = "source", topic: str = "topic", vigintile: str | None = "vigintile") -> DataFrame:
    """Replace the label columns of ``df`` by the canonical form of the directory catalog (``doc_counts``).

    A label may differ in case, white space and hyphens; the source may be a whole directory name, which then gives the
    missing topic and vigintile. Without topic the result is ``-``, without vigintile the empty string. A source that the
    catalog lacks keeps its folded form, a topic that it lacks is trimmed, a null source stays null. The catalog's
    directories (at most MAX_DIRECTORIES, a property of the corpus layout, not of the number of documents) are read by the
    driver; the rows are labelled by expressions and one broadcast join with the catalog's topics.
    """
    spark = df.sparkSession
    names = catalog.select(parse_dir(directory(F.col("file_path"))).alias("d")).select("d.source", "d.topic").distinct().limit(MAX_DIRECTORIES + 1).collect()
    if len(names) > MAX_DIRECTORIES:
        raise ValueError(f"the directory catalog has over {MAX_DIRECTORIES} sources and topics")
    fold = lambda text: "_".join(p for p in text.lower().replace("-", "_").replace(" ", "_").split("_") if p)
    sources = {fold(r.source): r.source for r in names if r.source}
    topics = sorted({(r.source, fold(r.topic), r.topic) for r in names if r.source and fold(r.topic)})
    keys = "|".join(sorted(sources, key=len, reverse=True)) or "(?!)"
    folded = _plain(F.col(source))
    match = f"^({keys})(?:_(.*))?$"
    found = F.regexp_extract(folded, match, 1)
    named = F.lit(None).cast("string")
    for key, name in sources.items():
        named = F.when(found == key, F.lit(name)).otherwise(named)
    rest = F.regexp_extract(folded, match, 2)
    own = F.nullif(_plain(F.col(topic)), F.lit(""))
    work = df.withColumns(
        {
            "__source": F.when(found != "", named).otherwise(folded),
            "__topic": F.coalesce(own, F.nullif(F.regexp_replace(rest, r"_?\d+$", ""), F.lit(""))),
            "__raw": F.nullif(F.trim(F.col(topic)), F.lit("-")),
        }
        | ({"__vig": F.coalesce(F.nullif(F.regexp_extract(F.col(vigintile), r"(\d+)\s*$", 1), F.lit("")), F.regexp_extract(rest, r"_(\d+)$", 1), F.lit(""))} if vigintile else {})
    )
    if topics:
        lookup = spark.createDataFrame(topics, "__source string, __topic string, __name string")
        work = work.join(F.broadcast(lookup), ["__source", "__topic"], "left")
    else:
        work = work.withColumn("__name", F.lit(None).cast("string"))
    out = {source: F.col("__source"), topic: F.coalesce("__name", F.nullif("__raw", F.lit("")), "__topic", F.lit("-"))}
    if vigintile:
        out[vigintile] = F.when(F.col("__vig") != "", F.lpad(F.right(F.col("__vig"), F.lit(2)), 2, "0")).otherwise("")
    return work.withColumns(out).select(*df.columns)
