"""Line dedup by a log-template tree of fixed depth.

A line goes down the tree by its number of tokens and its leading tokens;
tokens with a digit count as variable from the start. In a leaf, a position
whose most frequent token covers enough of the leaf's documents is constant,
the others are variable fields. A line that agrees with enough constants has
the leaf's template. The other lines are parted by their most frequent token
that is not constant and tried again, several times, so that a leaf can hold
several templates; a line that agrees with none is a template of its own. Templates that
recur in at least ``min_docs`` documents (copies of a text are one document)
are dropped; their first line, by document id and position, stays.

Only hashes of lines are shuffled. Tokens are looked at for distinct lines in
leaves that recur at all, so a hot line is one row there, and counts are
summed in the map tasks. Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.llm.line_rules import words_of
from panelscope.llm.words import WORD
from panelscope.sources.durable import count_rows, durable

MIN_DOCS = 10
LEADING = 3
CONSTANT_PERCENT = 60
AGREE_PERCENT = 70
TURNS = 8  # templates are looked for so often in a leaf


def tokens_of(line: Column) -> Column:
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", "<*>")).otherwise(line)
    return words_of(F.lower(masked))


def row_key(key: str, text: str) -> Column:
    """Rows with equal id and text are treated alike; rows that share only an id are not."""
    return F.xxhash64(F.col(key), F.col(text))


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = docs.select(row_key(key, text).alias("row"), F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("doc"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line_no", "line"))
    rows = rows.filter(F.col("line").rlike(WORD)).withColumn("tokens", tokens_of(F.col("line"))).drop("line")
    leaf = F.xxhash64(F.size("tokens"), F.slice("tokens", 1, LEADING))
    return rows.withColumn("leaf", leaf).withColumn("same", F.xxhash64("tokens"))


def _templates(kinds: DataFrame, min_docs: int) -> DataFrame:
    """leaf, same, template of the distinct lines that agree with a template of their leaf.

    Each turn makes one template for each group of lines, at first the leaf.
    Lines that do not agree are parted by the most frequent token that is not
    constant and tried again, so a leaf can hold several templates. A group
    ends where it has fewer documents than recur, or nothing parts it.
    """
    rest, fitted = kinds.withColumn("group", F.col("leaf")), None
    for _ in range(TURNS):
        field = rest.select("group", "docs", F.posexplode("tokens").alias("place", "token")).groupBy("group", "place", "token").agg(F.sum("docs").alias("docs"))
        field = field.groupBy("group", "place").agg(F.max(F.struct("docs", "token")).alias("top"), F.sum("docs").alias("all"))
        is_constant = F.col("top.docs") * 100 >= F.col("all") * CONSTANT_PERCENT
        fields = F.sort_array(F.collect_list(F.struct("place", F.when(is_constant, F.col("top.token")).alias("token"))))
        mark = F.max(F.when(~is_constant & (F.col("top.docs") >= min_docs), F.struct(F.col("top.docs").alias("docs"), F.col("place"), F.col("top.token").alias("token"))))
        template = field.groupBy("group").agg(fields.alias("fields"), mark.alias("mark"), F.max("all").alias("all"))
        agree = F.size(F.filter(F.zip_with("tokens", F.col("fields.token"), lambda a, b: a == b), lambda x: x))
        fits = agree * 100 >= F.size("tokens") * AGREE_PERCENT
        part = F.xxhash64("group", F.coalesce(F.get("tokens", F.col("mark.place")) == F.col("mark.token"), F.lit(False)))
        judged = durable(rest.join(template, "group").select("leaf", "same", "tokens", "docs", "all", fits.alias("fits"), F.when(fits, F.xxhash64("group", F.lit("leaf"))).otherwise(part).alias("group")))
        now = judged.filter("fits").select("leaf", "same", F.col("group").alias("template"))
        fitted = now if fitted is None else fitted.union(now)
        others = judged.filter("not fits").select("leaf", "same", "tokens", "docs", "all", "group")
        groups = others.groupBy("group").agg(F.sum("docs").alias("n"), F.count(F.lit(1)).alias("kinds"), F.max("all").alias("all"))
        groups = durable(groups.filter((F.col("n") >= min_docs) & (F.col("n") < F.col("all")) & (F.col("kinds") > 1)).select("group"))
        if not count_rows(groups):
            break
        rest = durable(others.drop("all").join(groups, "group", "left_semi"))
    return fitted


def recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """row, gone: the numbers of the lines to drop, one row for each text that loses any."""
    lines = _lines(docs, key, text)
    slim = durable(lines.drop("tokens"))
    leaves = slim.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("a"), F.max("doc").alias("b"))
    leaves = durable(leaves.filter((F.col("n") >= min_docs) & (F.col("a") != F.col("b"))).select("leaf"))
    slim = durable(slim.join(leaves, "leaf", "left_semi"))
    # distinct lines of these leaves, with the documents that hold them
    counts = slim.groupBy("leaf", "same").agg(F.count_distinct("doc").alias("docs"))
    kinds = lines.select("leaf", "same", "tokens").join(leaves, "leaf", "left_semi").groupBy("leaf", "same").agg(F.any_value("tokens").alias("tokens"))
    kinds = durable(kinds.join(counts, ["leaf", "same"]))
    fitted = _templates(kinds, min_docs)
    # written, so that Spark splits the next join where a line is hot
    kinds = durable(kinds.select("leaf", "same").join(fitted, ["leaf", "same"], "left").select("leaf", "same", F.coalesce("template", F.xxhash64("leaf", "same")).alias("template")))
    placed = durable(slim.join(kinds, ["leaf", "same"]).select("template", "doc", "row", "doc_id", "line_no"))
    recurring = placed.groupBy("template").agg(F.count_distinct("doc").alias("docs"), F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line_no", "row")).alias("first")).filter(F.col("docs") >= min_docs)
    # written, so that both sides of the next join are plain shuffles, which Spark splits where a template is hot
    recurring = durable(recurring.select("template", "first"))
    first = (F.col("row") == F.col("first.row")) & (F.col("line_no") == F.col("first.line_no"))
    gone = placed.join(recurring, "template").filter(~first)
    return durable(gone.groupBy("row").agg(F.sort_array(F.collect_set("line_no")).alias("gone")))


def drop_recurring(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of ``docs`` as ``doc``, n_lines, n_dropped, cleaned (the text without the dropped lines).

    Lines are what lies between line feeds; lines without a word belong to no
    template and stay. A null text stays null with 0 lines, an empty text is
    one line without a word and counts 0. Repeated rows lose the same lines,
    and the first line of a template stays in each of them. Other columns are
    passed through whatever their names.
    """
    gone = recurring_lines(docs, key, text, min_docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row_key(key, text).alias("row"))
    # ``gone`` grows with the documents, so it is no table to broadcast: one plan at every size
    rows = rows.join(gone.hint("merge"), "row", "left")
    parts = F.split(F.col(f"doc.{text}"), "\n", -1)
    counted = F.coalesce(F.size(F.filter(parts, lambda x: x.rlike(WORD))), F.lit(0)).cast("long")
    cleaned = F.when(F.col("gone").isNull(), F.col(f"doc.{text}")).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("gone", i)), "\n"))
    return rows.select("doc", F.when(F.col(f"doc.{text}").isNull(), 0).otherwise(counted).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), cleaned.alias("cleaned"))
