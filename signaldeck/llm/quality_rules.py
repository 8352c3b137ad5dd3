"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are trimmed, lower-cased and hashed.  A line that more than ``max_share`` of a
host's distinct texts hold (and at least ``min_docs`` of them) is boilerplate there and is
removed; a document left with less than ``min_left`` of its word characters is depleted.
Counts go by (host, line, text) first, so that copies count once and a hot host or line is
combined before it meets in one place.  At most (lines per text) / ``max_share`` lines of
a host can be over the limit, so one row per host carries them to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signaldeck.llm.common import narrow, tables

MAX_SHARE = 0.1
MIN_DOCS = 20
MIN_LEFT = 0.3
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

_SPACE = "[\\x20\\x09-\\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "[#*$%&|<>]"


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.lower(F.btrim(line, F.lit(_SPACES))))


def _filled(lines: Column) -> Column:
    return F.filter(lines, lambda x: F.length(F.btrim(x, F.lit(_SPACES))) > 0)


def _chars(words: Column) -> Column:
    return F.char_length(F.array_join(words, "")).cast("bigint")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def measures(df: DataFrame, text_column: str = "text") -> DataFrame:
    """Rows of (doc, over), with ``text`` (never null), its lines and the counts of the base rules."""
    df = df.select("doc", "over", F.coalesce(F.col("doc")[text_column], F.lit("")).alias("text"))
    df = df.withColumn("words", _words(F.col("text"))).withColumn("lines", F.split("text", "\n"))
    n = F.size("words")
    gram = lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    df = df.select(
        "doc",
        "over",
        "text",
        "lines",
        _filled(F.col("lines")).alias("filled"),
        n.cast("bigint").alias("n_words"),
        _chars(F.col("words")).alias("word_chars"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", _SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), gram)).otherwise(F.expr("cast(array() as array<bigint>)")).alias("grams"),
    )
    # Only texts with a repeated window sort theirs: equal windows are neighbours then.
    df = df.withColumn(
        "sorted_grams",
        F.when(
            F.size("grams") > F.size(F.array_distinct("grams")),
            F.array_sort(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
        ).otherwise(F.expr("cast(array() as array<struct<g: bigint, i: int>>)")),
    )
    at = lambda j: F.get("sorted_grams", j)["g"]
    df = df.withColumn(
        "repeated",
        F.array_sort(
            F.transform(
                F.filter("sorted_grams", lambda p, j: p["g"].eqNullSafe(at(j - 1)) | p["g"].eqNullSafe(at(j + 1))),
                lambda p: p["i"],
            )
        ),
    )
    step = lambda s, j: F.least(F.lit(3), F.coalesce(F.get("repeated", j + 1) - s, F.lit(3)))
    return df.select(
        "doc",
        "over",
        "text",
        "lines",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("filled") - F.size(F.array_distinct("filled"))).cast("bigint").alias("n_dup_lines"),
        F.aggregate(F.transform("repeated", step), F.lit(0), lambda a, x: a + x).cast("bigint").alias("n_repeat_words"),
    )


def frequent_lines(
    docs: DataFrame, text_column: str, host_column: str, max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS
) -> DataFrame:
    """Host and the hashes of its lines over the limit; one row for each host that has any."""
    texts = narrow(docs, host_column, text_column).toDF("host", "text").where(F.col("text").isNotNull())
    lines = texts.select(
        "host",
        F.xxhash64("text").alias("content"),
        F.explode(F.array_distinct(F.transform(_filled(F.split("text", "\n")), _line_hash))).alias("line"),
    )
    per_line = lines.distinct().groupBy("host", "line").agg(F.count("*").alias("n"))
    per_host = texts.select("host", F.xxhash64("text").alias("content")).distinct()
    per_host = per_host.groupBy("host").agg(F.count("*").alias("of"))
    over = per_line.where(F.col("n") >= min_docs).withColumnRenamed("host", "h")
    over = over.join(per_host, F.col("h").eqNullSafe(F.col("host"))).where(F.col("n") > F.lit(max_share) * F.col("of"))
    return over.groupBy(F.col("h").alias("limit_host")).agg(F.collect_set("line").alias("over"))


def quality_rules(
    docs: DataFrame,
    text_column: str = "text",
    host_column: str = "source",
    max_share: float = MAX_SHARE,
    min_docs: int = MIN_DOCS,
    min_left: float = MIN_LEFT,
    min_words: int = MIN_WORDS,
    max_repeated_percent: int = MAX_REPEATED_PERCENT,
) -> DataFrame:
    """Each row as struct ``doc``, the counts, ``base_failed``, ``kept_text``, ``n_removed_lines`` and ``kept``.

    A null text is empty: it has no words and fails the base rules.  Rows without a host
    form one host of their own.  Repeated rows are judged alike and count once in line
    frequencies.  Lines without a word are never removed.  An empty table gives no rows.
    Every column of a row stays inside ``doc``, so that no name can clash.
    """
    # Written first, so that Spark knows its size before it chooses how to join it.
    limits = tables(docs.sparkSession).save(frequent_lines(docs, text_column, host_column, max_share, min_docs))
    df = docs.select(F.struct("*").alias("doc"))
    df = df.join(limits, df["doc"][host_column].eqNullSafe(limits["limit_host"]), "left").select("doc", "over")
    df = measures(df, text_column)
    stays = lambda x: (F.length(F.btrim(x, F.lit(_SPACES))) == 0) | ~F.array_contains("over", _line_hash(x))
    df = df.withColumn("kept_lines", F.when(F.col("over").isNull(), F.col("lines")).otherwise(F.filter("lines", stays)))
    removed = F.size("lines") - F.size("kept_lines")
    df = df.withColumn("n_removed_lines", removed.cast("bigint"))
    df = df.withColumn("kept_text", F.when(F.col("n_removed_lines") == 0, F.col("text")).otherwise(F.array_join("kept_lines", "\n")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated_percent * F.col("n_words"))
    left = F.when(F.col("n_removed_lines") == 0, F.col("word_chars")).otherwise(_chars(_words(F.col("kept_text"))))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_lines", "kept_text"]
    verdict = ~failed & (left >= F.lit(min_left) * F.col("word_chars"))
    # Behind a generator, so that a filter on the verdict doesn't compute everything below a second time.
    row = F.struct(*counts, failed.alias("base_failed"), verdict.alias("kept"))
    return df.select("doc", F.inline(F.array(row)))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts, base rules and verdict of every document."""
    judged = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines"
    )


#: CTE ``judged`` over a relation ``docs_in`` (doc_id, text, source): the rules in SQL.
JUDGED_SQL = r"""
qr_docs AS (
    SELECT doc_id, source, coalesce(text, '') AS text, text IS NULL AS no_text,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
        string_split(coalesce(text, ''), chr(10)) AS lines
    FROM docs_in
),
qr_lines AS (
    SELECT doc_id, source, text, lower(trim(u.line, E' \t\n\x0b\x0c\r')) AS line
    FROM qr_docs, unnest(lines) AS u(line) WHERE NOT no_text
),
qr_hosts AS (SELECT source, count(DISTINCT text) AS of FROM qr_docs WHERE NOT no_text GROUP BY source),
qr_over AS (
    SELECT l.source, l.line FROM
        (SELECT source, line, count(DISTINCT text) AS n FROM qr_lines WHERE line <> '' GROUP BY source, line) l
        JOIN qr_hosts h ON l.source IS NOT DISTINCT FROM h.source
    WHERE l.n >= 20 AND l.n > 0.1 * h.of
),
qr_limits AS (SELECT source, list(line) AS over FROM qr_over GROUP BY source),
qr_grams AS (
    SELECT doc_id, g.i AS i, words[g.i] AS a, words[g.i + 1] AS b, words[g.i + 2] AS c
    FROM qr_docs, unnest(range(1, len(words) - 1)) AS g(i)
),
qr_repeated AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM qr_grams) WHERE n > 1
),
qr_covered AS (
    SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
    FROM qr_repeated, unnest([0, 1, 2]) AS o(k) GROUP BY doc_id
),
qr_counts AS (
    SELECT d.doc_id, d.source, d.text, d.lines,
        len(words)::BIGINT AS n_words,
        coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(list_filter(lines, lambda x: trim(x, E' \t\n\x0b\x0c\r') <> ''))
            - len(list_distinct(list_filter(lines, lambda x: trim(x, E' \t\n\x0b\x0c\r') <> ''))))::BIGINT AS n_dup_lines,
        coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words,
        list_filter(lines, lambda x: lower(trim(x, E' \t\n\x0b\x0c\r')) = ''
            OR NOT coalesce(list_contains(l.over, lower(trim(x, E' \t\n\x0b\x0c\r'))), false)) AS kept_lines
    FROM qr_docs d LEFT JOIN qr_covered r USING (doc_id)
    LEFT JOIN qr_limits l ON l.source IS NOT DISTINCT FROM d.source
),
judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        (len(lines) - len(kept_lines))::BIGINT AS n_removed_lines,
        array_to_string(kept_lines, chr(10)) AS kept_text,
        NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND
            length(regexp_replace(array_to_string(kept_lines, chr(10)), '[\x20\x09-\x0D]+', '', 'g')) >= 0.3 * word_chars AS kept
    FROM qr_counts
)
"""

ORACLE_SQL = (
    "WITH docs_in AS (SELECT doc_id, text, source FROM documents), "
    + JUDGED_SQL
    + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_lines FROM judged"
)
