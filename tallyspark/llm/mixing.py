"""Mixing sources to target weights by hierarchical budgets.

The corpus is a tree domain - language - source. The budget of tokens goes down it by the weights of the nodes. A child that
has less than its share gets what it has, and what is left over goes to its siblings by their weights; only if all of
them are full does it reach the children of the ancestor above. That is: at each node, the children share the node's
budget at one level per weight, each no more than it has. A leaf takes whole epochs while its budget lasts, and
of the last one the documents in the order of a seeded hash up to the budget.

The order is never laid out in one task: the place where a budget ends is found by its hash, digit by digit. The tokens of each range of
hashes are added up, the range where the budget ends is cut into RADIX smaller ones, and only when it holds no more than
RANGE_ROWS documents is it looked at one by one, equal rows as one with their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read, row_of

SPACE = " \t\n\x0b\x0c\r"
LEVELS = ["domain", "language", "source"]
#: Ranges that one is cut into, and rows of a range that is not cut again.
RADIX = 1024
RANGE_ROWS = 1000
SALTS = 16
HASHES = 1 << 32


def words(text: str = "text") -> Column:
    """Tokens of a document: its words."""
    spaced = F.translate(F.coalesce(F.col(text), F.lit("")), SPACE, " " * len(SPACE))
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")


def _share(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """``nodes`` (parent, child, weight, has, budget of the parent) with the child's budget.

    Children are taken from the one with the least tokens per unit of weight on. All before it full, the level is what is
    left for each unit of weight; the child gets that or what it has.
    """
    order = [(F.col("has") / F.col("weight")).asc(), F.col(child).asc()]
    by = Window.partitionBy(*parent)
    before = by.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    n = nodes.withColumn("full", F.coalesce(F.sum("has").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # The first child that isn't full sets the level for itself and all after it.
    level = (F.col("budget") - F.col("full")) / F.col("open")
    whole = by.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = n.withColumn("level", F.first(F.when(level * F.col("weight") <= F.col("has"), level), ignorenulls=True).over(whole))
    own = F.least(F.col("has"), F.greatest(F.col("level"), F.lit(0.0)) * F.col("weight"))
    return n.withColumn("own", F.when(F.col("level").isNull(), F.col("has")).otherwise(own)).drop("full", "open", "level")


def budgets(leaves: DataFrame, total: float, weights: dict[str, dict[str, float]], max_epochs: int) -> DataFrame:
    """(domain, language, source, tokens, rows, budget): each leaf's tokens to take, from the columns before it.

    ``weights`` has, by level, the weight of a node by its name; others weigh 1. A leaf can give its tokens
    ``max_epochs`` times. Nodes without tokens get nothing. Budgets are rounded to whole tokens.
    """
    leaf = leaves.withColumn("has", F.col("tokens").cast("double") * max_epochs)
    done = None
    for depth, name in enumerate(LEVELS):
        above = LEVELS[:depth]
        nodes = leaf.groupBy(*above, name).agg(F.sum("has").alias("has"), F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows"))
        w = F.lit(1.0)
        for node, x in weights.get(name, {}).items():
            w = F.when(F.col(name) == node, F.lit(float(x))).otherwise(w)
        nodes = nodes.withColumn("weight", w).where("weight > 0")
        if done is None:
            nodes = nodes.withColumn("budget", F.lit(float(total)))
        else:
            up = done.select(*[F.col(c).alias(f"up_{c}") for c in above], F.col("own").alias("budget"))
            on = None
            for c in above:
                eq = F.col(c).eqNullSafe(F.col(f"up_{c}"))
                on = eq if on is None else on & eq
            nodes = nodes.join(up, on).drop(*[f"up_{c}" for c in above])
        done = cut(_share(nodes, above or [F.lit(0)], name))
    return done.select(*LEVELS, "tokens", "rows", F.round("own").cast("long").alias("budget"))


def mix(docs: DataFrame, total: float | None = None, share: float = 0.8, weights: dict[str, dict[str, float]] | None = None, max_epochs: int = 2, seed: str = "mix", id_col: str = "doc_id", text: str = "text", language: str = "lang", source: str = "source", domain: Column | None = None, keep_text: bool = True) -> DataFrame:
    """Rows of ``docs`` with domain, n_tokens and epoch (0, 1, ...), as often as the budgets of their leaves take them.

    The budget is ``total`` tokens, or ``share`` of those there are. ``domain`` is a column of ``docs``; without it all
    is one domain. Null names count as the name ''. Documents without words are never taken. In an epoch the documents
    of a leaf stand in the order of md5(seed, epoch, id), equal ids by the hashes of their text and of their row; a document is taken if
    the budget isn't used up before it, so a leaf exceeds its budget by less than one document. Of rows that are equal in all
    columns, as many are taken as the budget reaches. An empty table gives none; extra columns stay, but columns named like a
    result are replaced. Without ``keep_text`` the text is left out and ``docs`` is read once.
    """
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    added = ["n_tokens", "epoch", "domain", *([] if keep_text else [text])]
    d = docs.select(
        row_of(docs, *added), words(f"`{text}`").alias("n"), name(domain if domain is not None else F.lit("all")).alias("domain"), name(F.col(f"`{language}`")).alias("language"),
        name(F.col(f"`{source}`")).alias("source"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text}`").alias("t"), F.xxhash64(*[f"`{c}`" for c in docs.columns]).alias("r"),
        (F.length(F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), SPACE, "")) > 0).alias("worded"),
    )
    d = d.where("worded").drop("worded").withColumn("salt", F.pmod(F.xxhash64("id", "t"), F.lit(SALTS)).cast("int"))
    if not keep_text:
        d = cut(d)
    slim = cut(d.drop("row")) if keep_text else d.drop("row")
    leaves = cut(slim.groupBy(*LEVELS).agg(F.sum("n").alias("tokens"), F.count("*").alias("rows")))
    there = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = budgets(leaves, total if total is not None else share * there, weights or {}, max_epochs)
    plan = plan.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    plan = plan.withColumn("left", F.col("budget") - F.col("epoch") * F.col("tokens")).where("left > 0")
    plan = cut(plan.select(*LEVELS, "epoch", "left", (F.col("left") >= F.col("tokens")).alias("whole"), "rows"))
    leaf = [*LEVELS, "epoch"]
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    in_order = lambda rows, p: _salted(rows, p).withColumn("key", key).withColumn("hash", F.conv(F.substring("key", 1, 8), 16, 10).cast("long"))
    # Where the budget ends: first the range of hashes, then the document.
    ends = plan.where("not whole").select(*leaf, "left", F.lit(0).cast("long").alias("low"), F.lit(HASHES).alias("high"), "rows")
    large = f"rows > {RANGE_ROWS} and high - low > 1"
    while not ends.where(large).isEmpty():
        step = F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low")) / RADIX)).cast("long")
        there = in_order(slim, ends.where(large).drop("rows").withColumn("step", step)).where("hash >= low and hash < high")
        sums = there.groupBy(*leaf, "left", "low", "high", "step", F.floor((F.col("hash") - F.col("low")) / F.col("step")).cast("long").alias("slot")).agg(F.sum("n").alias("sum"), F.count("*").alias("rows"))
        before = F.coalesce(F.sum("sum").over(Window.partitionBy(*leaf).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        begin = F.col("low") + F.col("slot") * F.col("step")
        hit = sums.withColumn("before", before).where("before < left and before + sum >= left")
        narrow = hit.select(*leaf, (F.col("left") - F.col("before")).alias("left"), begin.alias("low"), F.least("high", begin + F.col("step")).alias("high"), "rows")
        ends = cut(narrow.unionAll(ends.where(f"not ({large})")))
    place = F.struct("key", "id", "t", "r")
    last = in_order(slim, ends.drop("rows")).where("hash >= low and hash < high")
    last = last.groupBy(*leaf, "left", "low", "high", place.alias("place")).agg(F.count("*").alias("copies"), F.min("n").alias("n"))
    so_far = F.coalesce(F.sum(F.col("n") * F.col("copies")).over(Window.partitionBy(*leaf).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = last.withColumn("so_far", so_far).where("so_far < left").withColumn("take", F.least("copies", F.ceil((F.col("left") - F.col("so_far")) / F.col("n"))))
    last = last.groupBy(*leaf, "low").agg(F.max("place").alias("last"), F.max_by("take", "place").alias("take"), F.max_by("copies", "place").alias("copies"))
    ends = cut(plan.drop("left", "rows").join(last, leaf, "left"))
    taken = in_order(d, ends)
    taken = taken.where(F.col("whole") | (F.col("hash") < F.col("low")) | (place < F.col("last")) | ((place == F.col("last")) & (F.col("take") == F.col("copies"))))
    taken = taken.select("row", "domain", "n", "epoch")
    if not ends.where("take < copies").isEmpty():  # a budget ends among equal rows
        some = in_order(d, ends.where("take < copies")).where(place == F.col("last"))
        some = some.groupBy(*leaf).agg(F.first("row").alias("row"), F.first("n").alias("n"), F.first("take").alias("take"))
        taken = taken.unionAll(some.select("row", "domain", "n", F.col("epoch"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("take").cast("long")))).select("row", "domain", "n", "epoch"))
    return taken.select("row.*", "domain", F.col("n").alias("n_tokens"), "epoch")


def _salted(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with the plan of their leaf. One leaf may hold a third of the rows, so its rows are dealt over SALTS keys."""
    many = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(many, [*LEVELS, "salt"])


#: What op3 aims at: domains are the sources' numbers modulo four.
WEIGHTS = {"domain": {"d0": 2.0, "d1": 1.0, "d2": 1.0, "d3": 1.0}, "language": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}}
DOMAIN = "concat('d', try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 4)"


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found = mix(docs, share=0.8, weights=WEIGHTS, max_epochs=2, domain=F.expr(DOMAIN), keep_text=False)
    return found.select("doc_id", "epoch", "n_tokens", "domain", "lang", "source")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(source, '') AS s, coalesce(lang, '') AS l,
    coalesce('d' || (try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4), '') AS dom,
    len(list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> ''))::BIGINT AS n
  FROM documents),
leaf AS (SELECT dom, l, s, sum(n) AS t, 2.0::DOUBLE * sum(n) AS has FROM d WHERE n > 0 GROUP BY ALL),
tot AS (SELECT 0.8::DOUBLE * sum(t) AS total FROM leaf),
n1 AS (SELECT dom, sum(has) AS has, CASE dom WHEN 'd0' THEN 2.0 ELSE 1.0 END::DOUBLE AS w, any_value(total) AS b FROM leaf, tot GROUP BY dom),
f1 AS (SELECT *, row_number() OVER o AS k, (b - coalesce(sum(has) OVER p, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS lv FROM n1
  WINDOW o AS (ORDER BY has / w, dom), p AS (ORDER BY has / w, dom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g1 AS (SELECT *, (SELECT arg_min(lv, k) FROM f1 x WHERE lv * w <= has) AS level FROM f1),
o1 AS (SELECT dom, CASE WHEN level IS NULL THEN has ELSE least(has, greatest(level, 0) * w) END AS own FROM g1),
n2 AS (SELECT dom, l, sum(has) AS has, CASE l WHEN 'en' THEN 4.0 WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 ELSE 1.0 END::DOUBLE AS w, any_value(own) AS b FROM leaf JOIN o1 USING (dom) GROUP BY dom, l),
f2 AS (SELECT *, row_number() OVER o AS k, (b - coalesce(sum(has) OVER p, 0)) / (sum(w) OVER (PARTITION BY dom) - coalesce(sum(w) OVER p, 0)) AS lv FROM n2
  WINDOW o AS (PARTITION BY dom ORDER BY has / w, l), p AS (PARTITION BY dom ORDER BY has / w, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v2 AS (SELECT dom, arg_min(lv, k) AS level FROM f2 WHERE lv * w <= has GROUP BY dom),
o2 AS (SELECT dom, l, CASE WHEN level IS NULL THEN has ELSE least(has, greatest(level, 0) * w) END AS own FROM f2 LEFT JOIN v2 USING (dom)),
n3 AS (SELECT dom, l, s, has, t, 1.0::DOUBLE AS w, own AS b FROM leaf JOIN o2 USING (dom, l)),
f3 AS (SELECT *, row_number() OVER o AS k, (b - coalesce(sum(has) OVER p, 0)) / (sum(w) OVER (PARTITION BY dom, l) - coalesce(sum(w) OVER p, 0)) AS lv FROM n3
  WINDOW o AS (PARTITION BY dom, l ORDER BY has / w, s), p AS (PARTITION BY dom, l ORDER BY has / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v3 AS (SELECT dom, l, arg_min(lv, k) AS level FROM f3 WHERE lv * w <= has GROUP BY dom, l),
o3 AS (SELECT dom, l, s, t, round(CASE WHEN level IS NULL THEN has ELSE least(has, greatest(level, 0) * w) END)::BIGINT AS budget FROM f3 LEFT JOIN v3 USING (dom, l)),
e AS (SELECT *, budget - epoch * t AS remaining FROM o3, (SELECT unnest([0, 1]) AS epoch) WHERE budget - epoch * t > 0),
r AS (SELECT d.*, epoch, remaining, coalesce(sum(n) OVER (PARTITION BY dom, l, s, epoch ORDER BY md5('mix:' || epoch || ':' || coalesce(doc_id::VARCHAR, '')), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e USING (dom, l, s) WHERE n > 0)
SELECT doc_id, epoch::INT AS epoch, n AS n_tokens, dom AS domain, lang, source FROM r WHERE before < remaining
"""
