"""Mixing sources to target weights through a tree, by DataFrame operations alone.

A node's budget is divided among its children by their weights; what a child can't use goes to its
siblings, and only what all of them can't use was already withheld one level up, since a node
never gets more than its leaves hold. A leaf takes whole epochs, and of the last one a prefix of as
many tokens as remain, in the order of a seeded hash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.llm.common import cut, fitting

#: White space between tokens.
WORD = "[^ \\t\\n\\x0B\\f\\r]+"


@dataclass(frozen=True)
class Level:
    """A level of the tree: the node that a row belongs to, and that node's weight, as SQL over the rows (value) and over the nodes above and itself (weight)."""

    name: str
    value: str
    weight: str


def _filled(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """nodes(parents, name, capacity, weight, budget of the parent) with budget: their own.

    With children in the order of capacity by weight, the level of water that uses up the budget is
    the largest of those found when all children before are full.
    """
    nodes = nodes.withColumn("weight", F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)))
    nodes = nodes.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0))
    key = [F.col(p) for p in parents] or [F.lit(0)]
    order = Window.partitionBy(*key).orderBy(F.coalesce(F.try_divide("capacity", "weight"), F.lit(0.0)), name)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # from the other end of the order, so that the frame runs and is not summed anew for each row
    back = Window.partitionBy(*key).orderBy(F.desc(F.coalesce(F.try_divide("capacity", "weight"), F.lit(0.0))), F.desc(name))
    weights = F.sum("weight").over(back.rowsBetween(Window.unboundedPreceding, 0))
    nodes = nodes.withColumn("level", F.coalesce(F.try_divide(F.col("budget") - before, weights), F.lit(0.0)))
    top = F.greatest(F.max("level").over(Window.partitionBy(*key)), F.lit(0.0))
    return nodes.withColumn("budget", F.least(F.col("capacity").cast("double"), F.col("weight") * top)).drop("level")


def mix(docs: DataFrame, levels: list[Level], *, percent: int, max_epochs: int = 1, seed: int = 0, buckets: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the levels' values, _n_tokens and _copies: how often each row is taken, 0 too.

    The budget is percent of all tokens; a leaf holds its tokens max_epochs times. Of the last epoch
    go the rows, in the order of md5(seed:epoch:id), whose running sum stays within the leaf's rest.
    Nulls: a null value or id counts as an empty string, a null text as no tokens; rows that share an id and
    leaf stand together in the order, so all or none of them go. A leaf's order is never sorted
    whole: sums of hash ranges find the one range in which the prefix ends. An empty table gives an
    empty table. Columns of docs pass through; those with a level's name, or named _n_tokens or _copies, are replaced.
    """
    names = [x.name for x in levels]
    values = {x.name: F.coalesce(F.expr(x.value).cast("string"), F.lit("")) for x in levels}
    leaf = [f"_leaf{i}" for i in range(len(levels))]
    own = [v.alias(n) for n, v in zip(leaf, values.values(), strict=True)]
    tokens = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = cut(docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), *own, tokens.alias("_n")))

    leaves = rows.groupBy(*leaf).agg(F.sum("_n").alias("held"))
    # what stands below a node of no weight can't be used, so it is no capacity of the nodes above
    usable = [F.coalesce(F.expr(x.weight).cast("double"), F.lit(0.0)) > 0 for x in levels]
    leaves = leaves.select("*", *[F.col(c).alias(n) for c, n in zip(leaf, names, strict=True)]).withColumn("usable", F.when(reduce(and_, usable), F.col("held")).otherwise(0)).drop(*names)
    total = leaves.agg(F.sum("held")).first()[0] or 0
    nodes = leaves.withColumn("budget", F.lit(float(math.floor(total * percent / 100))))
    for i, x in enumerate(levels):
        path, above = leaf[: i + 1], leaf[:i]
        weight = F.expr(x.weight)
        named = nodes.select("*", *[F.col(c).alias(n) for c, n in zip(leaf, names, strict=True)]).withColumn("weight", weight).drop(*names)
        level = named.groupBy(*path).agg(F.sum(F.col("usable") * max_epochs).alias("capacity"), F.first("weight").alias("weight"), F.first("budget").alias("budget"))
        nodes = nodes.drop("budget").join(_filled(level, above, path[-1]).select(*path, "budget"), path)
    whole = F.floor(F.col("budget") + 1e-6).cast("long")
    plan = cut(nodes.select(*leaf, whole.alias("budget"), F.coalesce(F.try_divide(whole, F.col("held")), F.lit(0.0)).cast("long").alias("full"), "held"))
    plan = plan.select(*leaf, "full", (F.col("budget") - F.col("full") * F.col("held")).alias("rest"))

    def place(epoch: Column, doc: Column) -> Column:
        return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), doc))

    keyed = rows.join(fitting(plan), leaf).withColumn("_key", place(F.col("full"), F.col("_id")))
    bucket = F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * buckets / 2**32).cast("int")
    keyed = keyed.withColumn("_bucket", bucket)
    sums = keyed.groupBy(*leaf, "rest", "_bucket").agg(F.sum("_n").alias("n"))
    upto = Window.partitionBy(*leaf).orderBy("_bucket")
    sums = sums.withColumn("upto", F.sum("n").over(upto))
    ends = sums.where(F.col("upto") > F.col("rest")).groupBy(*leaf).agg(F.min("_bucket").alias("_bucket"), F.min_by(F.col("upto") - F.col("n"), "_bucket").alias("before"))
    ends = cut(ends)
    inside = keyed.join(fitting(ends), [*leaf, "_bucket"])
    running = F.col("before") + F.sum("_n").over(Window.partitionBy(*leaf).orderBy("_key"))
    inside = inside.withColumn("upto", running).where(F.col("upto") <= F.col("rest")).groupBy(*leaf).agg(F.max("_key").alias("last"))
    first = F.lpad(F.conv(F.ceil(F.col("_bucket") * F.lit(2**32) / buckets).cast("long").cast("string"), 10, 16), 8, "0")
    cuts = plan.join(ends.join(inside, leaf, "left"), leaf, "left").select(
        *leaf, F.col("full").alias("_full"),
        # rows of the last epoch go below `before` and up to `last`; without an end in any range all of them go
        F.when(F.col("_bucket").isNull(), "g").otherwise(F.lower(first)).alias("_before"), F.coalesce("last", F.lit("")).alias("_last"), F.col("rest").alias("_rest"),
    )
    cuts = cut(cuts)
    base = [c for c in docs.columns if c not in ("_n_tokens", "_copies") and (c not in names or c in (id_col, text_col))]
    whole_rows = docs.select(F.struct(F.lit(True).alias("is"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(base)]).alias("_row"), *own, tokens.alias("_n_tokens"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_md5_id"))
    joined = whole_rows.join(fitting(cuts), leaf).withColumn("_key", place(F.col("_full"), F.col("_md5_id")))
    last = ((F.col("_key") < F.col("_before")) | (F.col("_key") <= F.col("_last"))) & (F.col("_rest") > 0)
    joined = joined.withColumn("_copies", F.col("_full") + last.cast("long"))
    return joined.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(base)], *[F.col(c).alias(n) for c, n in zip(leaf, names, strict=True)], "_n_tokens", "_copies")


#: The tree of the query: fixed by this library.
TREE = [
    Level("domain", "CASE WHEN source = 'src0' THEN 'web' WHEN ascii(right(source, 1)) % 2 = 0 THEN 'books' ELSE 'forums' END", "CASE domain WHEN 'web' THEN 2 WHEN 'books' THEN 3 ELSE 1 END"),
    Level("lang", "lang", "CASE lang WHEN 'en' THEN 3 ELSE 2 END"),
    Level("source", "source", "1 + ascii(right(source, 1)) % 3"),
]


def _oracle_level(i: int) -> str:
    names = [x.name for x in TREE]
    path, above = names[: i + 1], names[:i]
    part = f"PARTITION BY {', '.join(above)}" if above else ""
    p = ", ".join(path)
    return f"""
n{i} AS (SELECT {p}, sum(held) * 2 AS capacity, CAST(any_value({TREE[i].weight}) AS DOUBLE) AS weight, any_value(budget) AS above FROM b{i} GROUP BY {p}),
l{i} AS (SELECT *, (above - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM n{i} WINDOW w AS ({part} ORDER BY capacity / weight, {path[-1]})),
f{i} AS (SELECT {p}, least(CAST(capacity AS DOUBLE), weight * greatest(max(lev) OVER ({part}), 0.0)) AS budget FROM l{i}),
b{i + 1} AS (SELECT b{i}.* EXCLUDE (budget), f{i}.budget FROM b{i} JOIN f{i} USING ({p})),"""


ORACLE = f"""
WITH docs AS (SELECT doc_id, coalesce({TREE[0].value}, '') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n FROM documents),
leaves AS (SELECT domain, lang, source, sum(n) AS held FROM docs GROUP BY domain, lang, source),
b0 AS (SELECT *, CAST(floor((SELECT sum(held) FROM leaves) * 60 / 100) AS DOUBLE) AS budget FROM leaves),{"".join(map(_oracle_level, range(3)))}
plan AS (SELECT domain, lang, source, held, CAST(floor(budget + 1e-6) AS BIGINT) AS budget FROM b3),
parts AS (SELECT *, CASE WHEN held = 0 THEN 0 ELSE budget // held END AS whole FROM plan),
placed AS (SELECT d.doc_id, d.domain, d.lang, d.source, d.n, p.whole, p.budget - p.whole * p.held AS rest, md5('7:' || CAST(p.whole AS VARCHAR) || ':' || coalesce(CAST(d.doc_id AS VARCHAR), '')) AS k FROM docs d JOIN parts p USING (domain, lang, source)),
ran AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY k) AS upto FROM placed)
SELECT doc_id, domain, lang, source, CAST(n AS BIGINT) AS n_tokens, CAST(whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM ran
WHERE whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END > 0
"""
