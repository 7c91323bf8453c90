"""Quality rules with host verdicts: DataFrame functions only.

Each document is measured within its row. Rule failures are counted by host, a host's failure rate is shrunk towards
the rate of all hosts with a beta prior that is fitted to the hosts themselves (method of moments), and the verdict of
the host goes back to its documents. The measures are written once, so the texts are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, row_of, text_of

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: The rules beside the base: a document fails one if the condition holds.
RULES = {
    "symbols": "10 * n_symbols > word_chars",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 14 * n_words",
}
MAX_RATE = 0.5


def _split(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACE, " " * len(SPACE)), " "), "")


def _covered(sorted_windows: Column, size: int) -> Column:
    """Words in windows found twice or more, from (window, position) in order: the union of their spans."""
    n = F.size(sorted_windows)
    same = lambda i, j: F.get(sorted_windows, i)["w"] == F.get(sorted_windows, j)["w"]
    again = F.filter(sorted_windows, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
    at = F.sort_array(F.transform(again, lambda x: x["at"]))
    return F.when(n > 0, at)


def measure(docs: DataFrame, text: str = "text", window: int = 3) -> DataFrame:
    """``docs`` without ``text`` and with MEASURES and n_lines (long). A null or empty text has zero of everything.

    Words are runs of characters other than ASCII white space; a duplicate line is one with a word that equals an
    earlier line; repeated words are those in windows of ``window`` words that the text has twice or more.
    """
    frame = docs.select(row_of(docs, text, *MEASURES, "n_lines"), text_of(f"`{text}`").alias("text"))
    return _measured(frame, ["row"], window).select("row.*", *MEASURES, "n_lines")


def _measured(df: DataFrame, kept: list[str], window: int = 3) -> DataFrame:
    """The columns ``kept`` and the measures of the column ``text``."""
    t = F.col("text")
    df = df.select(
        *kept,
        _split(t).alias("words"),
        F.length(F.translate(t, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0).alias("lines"),
    )
    words = F.col("words")
    last = F.size(words) - window
    pieces = lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(window)])
    found = F.when(last >= 0, F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(pieces(i).alias("w"), i.alias("at")))))
    own = ["word_chars", "n_symbols"]
    df = df.select(*kept, *own, F.size(words).cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), found.alias("found"))
    own += ["n_words", "n_lines", "n_dup_lines"]
    df = df.select(*kept, *own, _covered(F.col("found"), window).alias("at"))
    at = F.col("at")
    spans = F.transform(at, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - x, F.lit(window))))
    total = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select(*kept, *own, F.coalesce(total, F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def host_verdicts(measured: DataFrame, host: str, max_rate: float = MAX_RATE) -> DataFrame:
    """By host: n_docs, n_failed, host_rate (shrunk) and host_ok. Rows of a null host belong to no host.

    Prior: with m the mean and v the variance of the hosts' raw rates, a + b = m (1 - m) / v - 1 (at least 1; without
    spread, or with one host, 1e6), a = m (a + b). A host is refused if (failed + a) / (docs + a + b) > max_rate.
    """
    by = measured.where(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    by = cut(by)
    m, v = by.agg(F.avg(rate), F.var_pop(rate)).first()  # two numbers
    ab = max(m * (1 - m) / v - 1, 1.0) if v and v > 1e-12 else 1e6
    shrunk = by.withColumn("host_rate", (F.col("n_failed") + F.lit((m or 0.0) * ab)) / (F.col("n_docs") + F.lit(ab)))
    return shrunk.select(host, "n_docs", "n_failed", F.round("host_rate", 9).alias("host_rate"), (F.round("host_rate", 9) <= max_rate).alias("host_ok"))


def quality(docs: DataFrame, host: str = "source", text: str = "text", max_rate: float = MAX_RATE) -> DataFrame:
    """``docs`` without ``text``, with the measures, base_failed, failed (base or any rule), host_rate and kept.

    kept is false where base_failed, else whether the host is accepted; a document of null host is judged alone.
    Extra columns stay, whatever their names; columns named like a result are replaced. Repeated rows are measured and counted each;
    an empty table gives none.
    """
    added = [*MEASURES, "n_lines", "base_failed", "failed", "host_rate", "kept"]
    df = docs.select(row_of(docs, text, *added), F.col(f"`{host}`").alias("host"), text_of(f"`{text}`").alias("text"))
    df = _measured(df, ["row", "host"])
    any_rule = F.lit(False)
    for rule in RULES.values():
        any_rule = any_rule | F.expr(rule)
    df = cut(df.withColumn("base_failed", base_failed()).withColumn("failed", F.col("base_failed") | any_rule))
    hosts = cut(host_verdicts(df, "host", max_rate).select("host", "host_rate", "host_ok"))
    out = df.join(hosts, "host", "left")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))).select("row.*", *added)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", *MEASURES, "base_failed", "kept", "failed", F.round("host_rate", 6).alias("host_rate"))


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '') AS words
  FROM documents),
l AS (
  SELECT *, list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '') AS lines,
    CASE WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) ELSE [] END AS shingles
  FROM w),
k AS (SELECT row_number() OVER () AS rid, * FROM l),
s AS (SELECT rid, unnest(shingles) AS sh, unnest(range(1, len(shingles) + 1)) AS pos FROM k),
r AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, sh) AS n FROM s) WHERE n > 1),
g AS (SELECT rid, least(3, coalesce(lead(pos) OVER (PARTITION BY rid ORDER BY pos) - pos, 3)) AS gain FROM r),
c AS (SELECT rid, sum(gain) AS n FROM g GROUP BY rid),
m AS (
  SELECT doc_id, source, len(words)::BIGINT AS n_words, length(list_aggregate(words, 'string_agg', ''))::BIGINT AS word_chars0,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM k LEFT JOIN c USING (rid)),
b AS (SELECT * EXCLUDE (word_chars0), coalesce(word_chars0, 0) AS word_chars, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m),
f AS (SELECT *, (base_failed OR 10 * n_symbols > word_chars OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 2 * n_words OR word_chars > 14 * n_words) AS failed FROM b),
h AS (SELECT source, count(*) AS nd, sum(failed::INT) AS nf FROM f WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT avg(nf / nd) AS m, var_pop(nf / nd) AS v FROM h),
q AS (SELECT m, CASE WHEN v > 1e-12 THEN greatest(m * (1 - m) / v - 1, 1.0) ELSE 1e6 END AS ab FROM p),
o AS (SELECT source, round((nf + m * ab) / (nd + ab), 9) AS rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed,
  (NOT base_failed AND coalesce(rate <= 0.5, true)) AS kept, round(rate, 6) AS host_rate
FROM f LEFT JOIN o USING (source)
"""
