"""Line deduplication by a log-template tree, with DataFrame operations only.

A line's leaf in the tree is its number of tokens and its first `depth` tokens, where a token with
a digit counts as variable. In leaves that lines of at least `min_docs` different texts reach, a
token that fewer lines share at its position is variable too; a line with its variable tokens
blanked is its template. A template with enough constant tokens that occurs in at least `min_docs`
different texts recurs, and its lines are dropped. `keep_first=True` spares them in one document, the
one with the least id; copies of that document lose them too, unless `keep_copies=True` spares those as
well, so that copies stay copies for a later stage. Lines that are the
same byte for byte recur in `min_docs` texts whatever their share of digits, and those of at least
`long_tokens` tokens from the second different text on.

Copies of a text count once, so a copied document is not taken for a template. Identical lines are
counted before tokens are spread, so a line that a third of all documents share is one row there;
what follows are counts with partial sums and plain joins, which AQE splits. Lines travel as digests;
the texts of the lines in leaves that enough texts reach are looked up by digest, and documents are
shuffled once, to their list of dropped lines.

Edge cases: null text stays null and has no lines; lines without tokens are never dropped; lines
are what stands between "\\n"; the kept lines are joined by "\\n", so a text without dropped lines
is unchanged; a text may become empty; repeated rows are treated alike; null ids never keep a
template; columns named n_lines, n_dropped are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind
from .textkit import fresh_name, saved

BLANK_RUN = "[\\x20\\x09-\\x0D]+"
VARIABLE = "<*>"
BROADCAST_KEYS = 200_000


def tokens_of(line: Column) -> Column:
    return F.filter(F.split(line, BLANK_RUN), lambda t: t != "")


def masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(VARIABLE)).otherwise(token)


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def leaf_lines(docs: DataFrame, id_col: str, text_col: str, depth: int) -> DataFrame:
    """text_key, doc_id, line_no, line_key, leaf, n_tokens of all lines that have a token."""
    # digest and split first: the text itself is not carried through the explode
    split = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.split(F.col(text_col), "\n").alias("lines"))
    lines = split.select("doc_id", "text_key", F.posexplode("lines").alias("line_no", "line")).where(F.col("line").rlike("[^\\x20\\x09-\\x0D]"))
    # the leading tokens come from the line's start alone; the count needs no array of tokens
    head = F.split(F.regexp_replace("line", "^" + BLANK_RUN, ""), BLANK_RUN, depth + 1)
    counted = lines.withColumn("n_tokens", F.regexp_count("line", F.lit("[^\\x20\\x09-\\x0D]+")))
    lead = [F.coalesce(masked(F.get(head, F.lit(k))), F.lit("")) for k in range(depth)]
    return counted.select("text_key", "doc_id", "line_no", text_key(F.col("line")).alias("line_key"), F.xxhash64("n_tokens", *lead).alias("leaf"), "n_tokens")


def texts_of(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """line_key, line of the wanted line_keys."""
    lines = docs.select(F.explode(F.split(F.col(text_col), "\n")).alias("line")).select(text_key(F.col("line")).alias("line_key"), "line")
    if wanted.count() <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    return lines.join(wanted, "line_key", "left_semi").groupBy("line_key").agg(F.first("line").alias("line"))


def recurring_lines(docs: DataFrame, *, id_col: str, text_col: str, min_docs: int, depth: int, constant: float, keep_first: bool, long_tokens: int) -> DataFrame:
    """text_key, first_id, dropped (line numbers that all rows of the text lose), first_only (those that all but first_id lose)."""
    # a text's copies give the same lines: one row each
    lines = saved(leaf_lines(docs, id_col, text_col, depth).groupBy("text_key", "line_no", "line_key", "leaf", "n_tokens").agg(F.min("doc_id").alias("doc_id")))
    reached = lines.groupBy("leaf", "text_key").agg(F.lit(1).alias("one")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("leaf")
    held = saved(lines.join(reached, "leaf").drop("n_tokens"))
    counts = held.groupBy("leaf", "line_key").agg(F.count(F.lit(1)).alias("n"))
    unique = counts.join(texts_of(docs, text_col, saved(counts.select("line_key"))), "line_key")
    placed = unique.select("leaf", "line_key", "n", F.posexplode(tokens_of(F.col("line"))).alias("pos", "token")).withColumn("token", masked(F.col("token")))
    support = placed.groupBy("leaf", "pos", "token").agg(F.sum("n").alias("support")).where((F.col("support") >= min_docs) & (F.col("token") != VARIABLE)).select("leaf", "pos", "token", F.lit(True).alias("is_constant"))
    marked = placed.join(support, ["leaf", "pos", "token"], "left")
    shown = F.when(F.col("is_constant"), F.col("token")).otherwise(F.lit(VARIABLE))
    templates = (
        marked.groupBy("leaf", "line_key")
        .agg(
            F.bit_xor(F.xxhash64("pos", shown)).alias("t1"),
            F.bit_xor(F.xxhash64(shown, "pos", F.lit("second"))).alias("t2"),
            F.count("is_constant").alias("n_constant"),
            F.count(F.lit(1)).alias("n_tokens"),
        )
        .where(F.col("n_constant") >= constant * F.col("n_tokens"))
        .select("leaf", "line_key", "t1", "t2")
    )
    lined = held.select("leaf", "line_key", "text_key", "line_no", "doc_id").join(templates, ["leaf", "line_key"])
    counted = (
        lined.groupBy("leaf", "t1", "t2", "text_key")
        .agg(F.min("doc_id").alias("doc_id"))
        .groupBy("leaf", "t1", "t2")
        .agg(F.count(F.lit(1)).alias("texts"), F.min("doc_id").alias("keeper"))
        .where(F.col("texts") >= min_docs)
        .select("leaf", "t1", "t2", "keeper")
    )
    lost = lined.join(counted, ["leaf", "t1", "t2"]).select("text_key", "line_no", "doc_id", "keeper")
    identical = (
        held.groupBy("line_key", "text_key")
        .agg(F.min("doc_id").alias("doc_id"))
        .groupBy("line_key")
        .agg(F.count(F.lit(1)).alias("texts"), F.min("doc_id").alias("keeper"))
        .where(F.col("texts") >= min_docs)
        .select("line_key", "keeper")
    )
    lost = lost.unionByName(held.join(identical, "line_key").select("text_key", "line_no", "doc_id", "keeper"))
    # two different texts have two different hashes: no list of texts is needed
    long = lines.where(F.col("n_tokens") >= long_tokens)
    own = F.xxhash64("text_key")
    verbatim = long.groupBy("line_key").agg(F.min(own).alias("low"), F.max(own).alias("high"), F.min("doc_id").alias("keeper")).where("low < high").select("line_key", "keeper")
    lost = lost.unionByName(long.join(verbatim, "line_key").select("text_key", "line_no", "doc_id", "keeper"))
    # doc_id is the least of the text's copies: only it can be the keeper
    kept = F.coalesce(F.col("doc_id") == F.col("keeper"), F.lit(False)) & F.lit(keep_first)
    return lost.groupBy("text_key").agg(
        F.min("doc_id").alias("first_id"),
        F.collect_set(F.when(~kept, F.col("line_no"))).alias("dropped"),
        F.collect_set(F.when(kept, F.col("line_no"))).alias("first_only"),
    )


def drop_recurring_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    depth: int = 4,
    constant: float = 0.5,
    keep_first: bool = False,
    keep_copies: bool = False,
    long_tokens: int = 20,
) -> DataFrame:
    """`docs` with the text's recurring lines taken out, n_lines and n_dropped appended."""
    lost = recurring_lines(docs, id_col=id_col, text_col=text_col, min_docs=min_docs, depth=depth, constant=constant, keep_first=keep_first, long_tokens=long_tokens)
    passed = [c for c in docs.columns if c.lower() not in {"n_lines", "n_dropped"}]
    key, found = fresh_name(docs, "text_key"), fresh_name(docs, "lost")
    base = docs.select(*[F.col(f"`{c}`") for c in passed], text_key(F.col(text_col)).alias(key))
    joined = base.join(lost.select(F.col("text_key").alias(key), F.struct("first_id", "dropped", "first_only").alias(found)), key, "left")
    copy = F.coalesce(F.col(id_col) != F.col(f"{found}.first_id"), F.lit(True)) & F.lit(not keep_copies)
    dropped = F.array_sort(F.when(copy, F.array_union(f"{found}.dropped", f"{found}.first_only")).otherwise(F.col(f"{found}.dropped")))
    joined = joined.withColumn(found, F.when(F.col(found).isNotNull(), dropped))
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.coalesce(F.size(F.split(F.col(text_col), "\n")), F.lit(0))).cast("long")
    n_dropped = F.coalesce(F.size(found), F.lit(0)).cast("long")
    n_dropped = F.when(F.col(found).isNull(), F.lit(0).cast("long")).otherwise(n_dropped)
    text = F.when(F.col(found).isNull(), F.col(text_col)).otherwise(without_lines(F.col(text_col), F.col(found)))
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in passed], n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def without_lines(text: Column, dropped: Column) -> Column:
    """The text without the lines at the sorted places `dropped`: the stretches between them, joined."""

    def cut(lines: Column) -> Column:
        ends = F.concat(dropped, F.array(F.size(lines)))
        starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda i: i + 1))
        return F.array_join(F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a))), "\n")

    return bind(F.split(text, "\n"), cut)
