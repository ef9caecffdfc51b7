"""Quality rules on cross-document line frequency.

Lines are normalised (A-Z and other letters lower-cased, digits to 0, white
space to single blanks) and hashed. For every host (here: source) and line the
distinct documents that hold it are counted, copies of a text once. Lines above
the limit are removed, and a document that keeps too few words is rejected.

The limit of a host is max(min_docs, ceil(share * documents)). Since each
document counts once per line, a host has at most 1 / share times its mean
number of lines per document above the limit, so the hashes of a host fit in
one row. Everything is built-in expressions; counts are summed in the map tasks
before any shuffle, so a line or host with a third of all rows costs no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.llm.words import WORD
from panelscope.sources.durable import durable

MIN_DOCS = 10
SHARE_PERCENT = 2
MIN_WORDS = 20
MIN_LEFT_PERCENT = 30
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    """The words in order. Splitting at one character is much faster than matching a pattern."""
    text = F.coalesce(text, F.lit(""))
    for space in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def lines_of(text: Column) -> Column:
    """The lines between line feeds that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD))


def normal(line: Column) -> Column:
    """Single blanks stay as they are, so that the pattern matches rarely."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(line, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " "))), "[1-9]", "0")


def line_hash(line: Column) -> Column:
    return F.xxhash64(normal(line))


def frequent_lines(docs: DataFrame, host: str = "source", text: str = "text", min_docs: int = MIN_DOCS, share_percent: int = SHARE_PERCENT) -> DataFrame:
    """host, frequent: the hashes above the limit, one row for each host that has any.

    A null host is a host of its own; null and empty texts have no lines but
    count as documents of the host. Rows with equal host and text are one
    document.
    """
    # one row per distinct text of a host, known by its hash, so that no text is shuffled
    slim = docs.select(F.col(host).alias("host"), F.xxhash64(F.col(text)).alias("doc"), F.array_distinct(F.transform(lines_of(F.col(text)), line_hash)).alias("lines"))
    slim = durable(slim.groupBy("host", "doc").agg(F.any_value("lines").alias("lines")))
    limits = slim.groupBy("host").agg(F.greatest(F.lit(min_docs), F.ceil(F.count(F.lit(1)) * share_percent / 100)).cast("long").alias("limit"))
    counts = slim.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs"))
    over = counts.filter(F.col("docs") > min_docs).alias("a").join(limits.alias("b"), F.col("a.host").eqNullSafe(F.col("b.host"))).filter("docs > limit")
    return durable(over.groupBy("a.host").agg(F.sort_array(F.collect_list("line")).alias("frequent")))


def with_window_hashes(rows: DataFrame) -> DataFrame:
    """Turns ``words`` into ``hashes``, one for each window of eight words, by doubling windows of one, two and four."""
    rows = rows.withColumn("hashes", F.transform("words", lambda x: F.xxhash64(x)))
    for step in (1, 2, 4):
        rows = rows.withColumn("hashes", F.transform("hashes", lambda x, i: F.xxhash64(x, F.get("hashes", i + step))))  # noqa: B023
    return rows.withColumn("hashes", F.slice("hashes", 1, F.greatest(F.lit(0), F.size("words") - (WINDOW - 1)))).drop("words")


def with_repeat_words(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in windows found twice or more, first included.

    ``hashes`` has the windows' hashes by position. Only rows with an equal
    pair sort (hash, position): there a window repeats if a neighbour has its
    hash, and the union of the repeating windows is measured. Each array is a
    column of its own; inside another's lambda it would be made anew for
    every element.
    """
    twice = F.size(F.array_distinct("hashes")) < F.size("hashes")
    rows = rows.withColumn("pairs", F.when(twice, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda i: F.get("pairs", i)["h"]
    rows = rows.withColumn("starts", F.sort_array(F.transform(F.filter("pairs", lambda p, i: (near(i + 1) == p["h"]) | (near(i - 1) == p["h"])), lambda p: p["i"])))
    gap = lambda i: F.coalesce(F.get("starts", i + 1) - F.get("starts", i), F.lit(WINDOW))
    rows = rows.withColumn("spans", F.transform("starts", lambda x, i: F.least(F.lit(WINDOW), gap(i))))
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x)
    return rows.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("hashes", "pairs", "starts", "spans")


def rules(docs: DataFrame, frequent: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", min_words: int = MIN_WORDS, min_left_percent: int = MIN_LEFT_PERCENT) -> DataFrame:
    """All columns of ``docs`` as ``doc``, the base measures, base_failed, kept and cleaned.

    ``cleaned`` is the text without frequent lines. A document is rejected if
    it fails the base rules or if it loses lines and keeps fewer than
    ``min_words`` words or ``min_left_percent`` of its words. Null and empty
    texts have no words and are rejected by the base rules.
    """
    body = F.coalesce(F.col(f"doc.{text}"), F.lit(""))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    out = out.alias("a").join(frequent.alias("b"), F.col(f"a.doc.{host}").eqNullSafe(F.col("b.host")), "left").select("doc", "frequent")
    out = out.withColumn("words", words_of(body)).withColumn("lines", lines_of(body))
    out = out.select(
        "doc",
        "lines",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "words",
        F.when(F.col("frequent").isNotNull(), F.filter("lines", lambda x: F.array_contains("frequent", line_hash(x)))).alias("gone"),
    )
    out = with_repeat_words(with_window_hashes(out))
    lost = F.coalesce(F.aggregate("gone", F.lit(0).cast("long"), lambda n, x: n + F.regexp_count(x, F.lit(WORD))), F.lit(0).cast("long"))
    out = out.withColumn("left", F.col("n_words") - lost)
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    depleted = (F.col("left") < F.col("n_words")) & ((F.col("left") < min_words) | (100 * F.col("left") < min_left_percent * F.col("n_words")))
    # a filter on a column that is not deterministic stays above the projections; moved below them it would
    # put the arrays into each other's lambdas, where they are made anew for every element
    out = out.withColumn("kept", ~F.col("base_failed") & ~depleted & (F.monotonically_increasing_id() >= 0))
    cleaned = F.when(F.coalesce(F.size("gone"), F.lit(0)) > 0, F.array_join(F.filter(F.split(body, "\n", -1), lambda x: ~F.array_contains("gone", x)), "\n")).otherwise(F.col(f"doc.{text}"))
    return out.select("doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("n_words") - F.col("left")).alias("n_frequent_words"), "base_failed", "kept", cleaned.alias("cleaned"))


def line_rules(docs: DataFrame, **options) -> DataFrame:
    """``frequent_lines`` and ``rules`` with default limits."""
    return rules(docs, frequent_lines(docs, **{k: v for k, v in options.items() if k in ("host", "text", "min_docs", "share_percent")}), **{k: v for k, v in options.items() if k in ("key", "host", "text", "min_words", "min_left_percent")})


def corpus_rules(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", min_docs: int = MIN_DOCS, min_words: int = MIN_WORDS, min_left_percent: int = MIN_LEFT_PERCENT) -> DataFrame:
    """All columns of ``docs`` as ``doc``, kept and cleaned, by one limit for hosts of any size.

    A line is frequent where more than ``min_docs`` distinct texts of its host
    hold it; the one with the smallest id among those that pass the base rules
    keeps it, so that of a group of near copies one stays. Rules and odd texts
    as in ``rules``. The lines to remove are
    found by joins on host and line and kept for each text, so a host may have
    any number of them. Base rules are judged once for each distinct text.
    """
    site, content = F.col(host), F.col(text)
    doc = F.xxhash64(site.isNull(), site, content.isNull(), content)
    place = lambda line: F.xxhash64(site.isNull(), site, normal(line))
    slim = docs.select(doc.alias("doc"), F.col(key).alias("id"), F.array_distinct(F.transform(lines_of(content), place)).alias("lines"), words_of(content).alias("words"))
    slim = with_repeat_words(with_window_hashes(slim.withColumn("n_words", F.size("words").cast("long"))))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    slim = slim.select("doc", "id", "lines", "n_words", failed.alias("base_failed")).groupBy("doc")
    slim = durable(slim.agg(F.min("id").alias("id"), F.any_value("lines").alias("lines"), F.any_value("n_words").alias("n_words"), F.any_value("base_failed").alias("base_failed")))
    lines = slim.select(F.explode("lines").alias("line"), "doc", "id", "base_failed")
    # tables are written and joined by merging, so that there is one plan at every size and Spark splits a hot line
    frequent = durable(lines.groupBy("line").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > min_docs).select("line"))
    held = durable(lines.join(frequent.hint("merge"), "line"))
    # held by texts that pass the base rules first; null ids last, as in ``recurring_lines``
    first = durable(held.groupBy("line").agg(F.min(F.struct("base_failed", F.col("id").isNull().alias("last"), "id", "doc")).alias("first")).select("line", F.col("first.doc").alias("first")))
    held = held.join(first.hint("merge"), "line").filter("doc != first")
    gone = held.groupBy("doc").agg(F.collect_list("line").alias("gone"))
    judged = durable(slim.filter(~F.col("base_failed")).select("doc", "n_words").join(gone.hint("merge"), "doc", "left"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), doc.alias("doc")).join(judged.hint("merge"), "doc", "left")
    parts = F.split(F.col(f"row.{text}"), "\n", -1)
    site = F.col(f"row.{host}")
    lost_line = lambda x: x.rlike(WORD) & F.array_contains("gone", place(x))
    lost = F.aggregate(F.filter(parts, lost_line), F.lit(0).cast("long"), lambda n, x: n + F.regexp_count(x, F.lit(WORD)))
    left = F.col("n_words") - F.when(F.col("gone").isNotNull(), lost).otherwise(F.lit(0).cast("long"))
    enough = (left == F.col("n_words")) | ((left >= min_words) & (100 * left >= min_left_percent * F.col("n_words")))
    cleaned = F.when(F.col("gone").isNull(), F.col(f"row.{text}")).otherwise(F.array_join(F.filter(parts, lambda x: ~lost_line(x)), "\n"))
    return rows.select(F.col("row").alias("doc"), F.coalesce(enough, F.lit(False)).alias("kept"), cleaned.alias("cleaned"))
