"""Quality rules: per-document measures and cross-document line frequency.

A line is normalised (lower case, digits to 0, white space collapsed) and
hashed; per host the distinct documents that hold it are counted.  Lines above
the host's limit are boilerplate and are removed from the text.  A document is rejected when boilerplate makes
up more than ``depleted_share`` of its words.  Identical texts of a host count
as one document, so groups of exact copies don't deplete each other.

Everything is DataFrame expressions; the only rows shuffled are
(host, line hash, text hash), combined before each exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, fresh, let, n_words, table, words

SYMBOLS = "#*$%&|<>"
#: A line is boilerplate from this many documents of a host on ...
MIN_DOCS = 10
#: ... and from this share of the host's documents on.
HOST_SHARE = 0.02
DEPLETED_SHARE = 0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def with_word_lines(text: Column) -> Column:
    """The \\n-split lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD))


def repeated_window_words(text: Column, width: int = 5) -> Column:
    """Words that lie in a ``width``-word window found at least twice in the text."""

    def covered(s: Column) -> Column:
        def same(x: Column, other: Column) -> Column:
            return F.coalesce(other.getField("h") == x.getField("h"), F.lit(False))

        flagged = F.transform(
            s,
            lambda x, j: F.struct(
                x.getField("i").alias("i"),
                (same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1))).alias("twice"),
            ),
        )
        starts = F.sort_array(F.transform(F.filter(flagged, lambda x: x.getField("twice")), lambda x: x.getField("i")))
        return let(
            starts,
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width)))),
                F.lit(0),
                lambda a, b: a + b,
            ),
        )

    def from_hashes(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered, covered))

    def from_words(w: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]),
        )
        return F.when(F.size(w) < width, F.lit(0)).otherwise(let(hashes, from_hashes))

    return let(words(text), from_words)


def base_measures(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    lines = with_word_lines(t)
    return {
        "n_words": n_words(t),
        "word_chars": F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_window_words(t).cast("long"),
    }


def normalised(line: Column) -> Column:
    # White space is made one blank first, so that indents and carriage returns are trimmed too.
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(line, r"[ \t-\r]+", " ")), "[0-9]", "0"))


def without_lines(lines: Column, gone: Column) -> Column:
    """The text of ``lines`` without those at the positions ``gone``; the others keep their order."""

    def rest(x: Column) -> Column:
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone), lambda i: F.get(x, i)), "\n")

    return let(lines, rest)


def line_frequency(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    min_docs: int = MIN_DOCS,
    host_share: float = HOST_SHARE,
    depleted_share: float = DEPLETED_SHARE,
) -> DataFrame:
    """``docs`` with the base measures, ``base_failed``, ``clean_text``, ``removed_words`` and ``kept``.

    clean_text: the text without its boilerplate lines.  removed_words: the words it lost by that.

    Documents of a host with the same text count once (n_texts and host_texts, not documents).
    Null text: no words, so ``base_failed``.  Null host: a host of its own.
    Repeated rows get equal results.  An empty table gives an empty result.
    Texts and lines of any length are taken whole; a line counts once a text, however often it stands there.
    Columns of ``docs`` that have the name of a result column are replaced.
    """
    of_host, t1, t2, gone = map(fresh, ("host", "text1", "text2", "gone"))
    keys = {
        of_host: F.coalesce(F.concat(F.lit("h"), F.col(host)), F.lit("")),
        t1: F.xxhash64(F.coalesce(F.col(text), F.lit(""))),
        t2: F.hash(F.coalesce(F.col(text), F.lit(""))),
    }
    keyed = docs.withColumns(keys)
    # Positions count all lines; those without a word are never boilerplate.
    all_lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    lines = (
        keyed.select(*keys, F.posexplode(F.transform(all_lines, lambda x: F.when(x.rlike(WORD), F.struct(F.xxhash64(normalised(x)).alias("line"), n_words(x).alias("n"))))).alias("pos", "x"))
        .filter("x IS NOT NULL").select(*keys, "pos", "x.line", "x.n")
    )
    copies = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    hosts = copies.groupBy(of_host).agg(F.count(F.lit(1)).alias("host_texts"))
    common = (
        lines.groupBy(of_host, "line")
        .agg(F.countDistinct(t1, t2).alias("n_texts"))
        .filter(F.col("n_texts") >= min_docs)
        .join(hosts, of_host)
        .filter(F.col("n_texts") >= host_share * F.col("host_texts"))
        .select(of_host, "line")
    )
    removed = lines.join(common, [of_host, "line"]).groupBy(*keys).agg(F.collect_set(F.struct("pos", "n")).alias(gone))
    measures = base_measures(F.col(text))
    out = keyed.withColumns(measures).join(removed, list(keys), "left")
    out = out.withColumn("clean_text", F.when(F.col(gone).isNull(), F.col(text)).otherwise(without_lines(all_lines, F.col(f"{gone}.pos"))))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # The words of the lines that go; so a caller who doesn't want clean_text moves no text.
    lost = F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.aggregate(gone, F.lit(0).cast("long"), lambda a, x: a + x.getField("n"))).cast("long")
    return (
        out.withColumns({"base_failed": base_failed, "removed_words": lost})
        .withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= depleted_share * F.col("n_words")))
        .drop(*keys, gone)
    )


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_frequency(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept"
    )


OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce('h' || source, '') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
win AS (
  SELECT doc_id, i, list_slice(w, i, i + 4) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win), range(0, 5) r(k)
  WHERE c >= 2 GROUP BY 1),
line AS (
  SELECT doc_id, host, text, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS n,
         lower(regexp_replace(trim(regexp_replace(x, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), '[0-9]', '0', 'g')) AS x
  FROM (SELECT doc_id, host, text, unnest(l) AS x FROM d)),
hosts AS (SELECT host, count(DISTINCT text) AS host_docs FROM d GROUP BY 1),
common AS (
  SELECT host, x FROM (SELECT host, x, count(DISTINCT text) AS n_docs FROM line GROUP BY 1, 2) JOIN hosts USING (host)
  WHERE n_docs >= {MIN_DOCS} AND n_docs >= {HOST_SHARE} * host_docs),
lost AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS removed_words FROM line JOIN common USING (host, x) GROUP BY 1),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
         AND removed_words <= {DEPLETED_SHARE} * n_words AS kept
FROM m
"""

QUERIES = {"op3_line_frequency": op3_line_frequency}
ORACLES = {"op3_line_frequency": OP3_SQL}
