"""Chat formatting from an event log: DataFrame functions only.

The log holds, for each conversation, events in sequence: ``start`` opens a message (role, text), ``delta`` adds text to
it, ``edit`` replaces its text, ``regenerate`` empties it and drops the messages that came after it. Events are dealt by
conversation, folded into final messages with windows, and rendered with a template. A conversation is rendered as one text, so it is
folded in one task. Texts are escaped so that no text
can hold a mark of the template; the way back is exact.

Rendered turn: ``<turn ROLE>`` line end, text, ``</turn>`` line end. In texts ``\\`` is ``\\0``, ``<`` is ``\\1``; in roles also
``>`` is ``\\2`` and a line end is ``\\3``. So ``<`` opens marks only, and the marks are replaced back one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

TEXT_ESCAPES = [("\\", "\\0"), ("<", "\\1")]
ROLE_ESCAPES = [*TEXT_ESCAPES, (">", "\\2"), ("\n", "\\3")]
CLOSE = "</turn>\n"


def escape(c: Column, pairs: list[tuple[str, str]] = TEXT_ESCAPES) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column, pairs: list[tuple[str, str]] = TEXT_ESCAPES) -> Column:
    for a, b in reversed(pairs):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, at, role, text) of the log (conv_id, seq, kind, message_id, role, text).

    Null texts are empty; events of one sequence number are taken by message, kind and text, so ties have one order.
    A message stands where it was first named; its role is the first one given. Its text is that of the last edit or
    regeneration (empty), with the deltas after that. A regeneration drops messages first named between the message
    and itself. Events of other kinds are refused by an error when they are read. Other columns of the log are left out, equal
    events count each, and an empty log gives no messages.
    """
    known = F.col("kind").isin("start", "delta", "edit", "regenerate")
    e = events.select(
        "conv_id", "seq", F.when(known, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown event kind: "), F.coalesce("kind", F.lit("null"))))).alias("kind"),
        "message_id", "role", F.coalesce("text", F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("seq", "message_id", "kind", "role", "text")
    e = e.withColumn("n", F.row_number().over(order))
    own = Window.partitionBy("conv_id", "message_id")
    e = e.withColumn("at", F.min("n").over(own)).withColumn("base", F.max(F.when(F.col("kind") != "delta", F.col("n"))).over(own))
    # A regeneration at n drops what was first named after its message and before n: for each message, the latest later regeneration of an earlier one.
    again = Window.partitionBy("conv_id").orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("dropped", F.min(F.when(F.col("kind") == "regenerate", F.col("at"))).over(again) < F.col("at"))
    e = e.withColumn("dropped", F.max(F.when(F.col("n") == F.col("at"), F.coalesce("dropped", F.lit(False)))).over(own))
    live = e.where(~F.col("dropped") & (F.col("base").isNull() | (F.col("n") >= F.col("base")) | (F.col("n") == F.col("at"))))
    piece = F.when(F.col("base").isNull() | ((F.col("n") >= F.col("base")) & (F.col("kind") != "regenerate")), F.col("text")).otherwise(F.lit(""))
    parts = live.groupBy("conv_id", "message_id", "at").agg(F.sort_array(F.collect_list(F.struct("n", "role", piece.alias("text")))).alias("p"))
    role = F.filter(F.col("p.role"), lambda x: x.isNotNull())
    return parts.select("conv_id", "at", F.coalesce(F.get(role, 0), F.lit("")).alias("role"), F.concat_ws("", "p.text").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask): the text of each conversation, and the loss mask as (start, length) in UTF-8 bytes.

    The mask covers the escaped texts of assistant turns, without their marks. A conversation without turns has no row.
    """
    turn = F.concat(F.lit("<turn "), escape(F.col("role"), ROLE_ESCAPES), F.lit(">\n"))
    m = messages.withColumn("head", turn).withColumn("body", escape(F.col("text")))
    m = m.withColumn("bytes", F.octet_length("head") + F.octet_length("body") + len(CLOSE))
    before = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("start", F.coalesce(F.sum("bytes").over(before), F.lit(0)) + F.octet_length("head"))
    span = F.when(F.col("role") == "assistant", F.struct(F.col("start").cast("long").alias("start"), F.octet_length("body").cast("long").alias("length")))
    rows = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", F.concat("head", "body", F.lit(CLOSE)).alias("text"), span.alias("span")))).alias("t"))
    return rows.select("conv_id", F.concat_ws("", "t.text").alias("formatted"), F.array_compact("t.span").alias("mask"))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a rendered conversation."""
    turns = F.split(formatted, CLOSE, -1)
    body = lambda x: F.substring_index(x, ">\n", 1)
    return F.transform(
        F.slice(turns, 1, F.size(turns) - 1),
        lambda x: F.struct(
            unescape(F.substr(body(x), F.lit(7)), ROLE_ESCAPES).alias("role"),
            unescape(F.substr(x, F.length(body(x)) + 3)).alias("text"),
        ),
    )


def masked(formatted: Column, mask: Column) -> Column:
    """The unescaped texts under the mask."""
    raw = F.encode(formatted, "UTF-8")
    return F.transform(mask, lambda s: unescape(F.decode(F.substr(raw, (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8")))


def formatted(events: DataFrame) -> DataFrame:
    return render(fold(events))


def log_of(messages: DataFrame) -> DataFrame:
    """A log that folds to ``messages`` (conv_id, message_id, role, text), which follow each other by message_id from 1 on.

    The text of a message comes in two deltas. By turns it comes at once; or after a draft that an edit replaces by its first half; or
    after a draft and a follow-up message that a regeneration throws away; or an edit is the last to come.
    """
    m, text = F.col("message_id"), F.col("text")
    half = (F.length(text) / 2).cast("int")
    head, tail = F.substr(text, F.lit(1), half), F.substr(text, half + 1)
    nobody = F.lit(None).cast("string")

    def events(*steps: tuple) -> Column:
        of = lambda kind, what, stray=False: (kind, what, -m if stray else m)
        made = [of(*x) for x in (("start", F.lit("")), *steps)]
        return F.array(*[F.struct((m * 10 + i).alias("seq"), F.lit(k).alias("kind"), who.alias("message_id"), (F.lit("stray") if k == "start" and i else F.col("role") if k == "start" else nobody).alias("role"), what.alias("text")) for i, (k, what, who) in enumerate(made)])

    draft = F.lit("a <draft> that goes")
    plain = events(("delta", head), ("delta", tail))
    edited = events(("delta", draft), ("edit", head), ("delta", tail))
    again = events(("delta", draft), ("start", F.lit("and"), True), ("delta", draft, True), ("regenerate", draft), ("delta", head), ("delta", tail))
    late = events(("delta", tail), ("delta", draft), ("edit", text))
    turn = m % 4
    log = F.when(turn == 0, plain).when(turn == 1, edited).when(turn == 2, again).otherwise(late)
    return messages.select("conv_id", F.explode(log).alias("e")).select("conv_id", "e.*")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(["user", "assistant"])])).alias("r")).select("conv_id", "r.*")
    rows = rows.unionByName(extra)
    # Every row is a message of its own, rows of one turn too.
    each = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    out = formatted(log_of(rows.withColumn("message_id", F.row_number().over(each).cast("long")).select("conv_id", "message_id", "role", F.coalesce("text", F.lit("")).alias("text"))))
    out = out.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("mask")).alias("loss"))
    told = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return out.select("conv_id", "formatted", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(told, "UTF-8"), 256).alias("turns_sha256"), F.concat_ws("", "loss").alias("loss")).select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (
  SELECT *, replace(replace(text, '\', '\0'), '<', '\1') AS body,
    replace(replace(replace(replace(role, '\', '\0'), '<', '\1'), '>', '\2'), chr(10), '\3') AS r2 FROM r),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    sum(length(r2) + length(body) + 16) AS formatted_chars
  FROM f GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(told) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars
FROM g
"""
