"""Rules as a table: of any number, joined with what they are about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernels import patterns
from ..session import small, written

ARROW, GRAM = "→", 3


def _turned(c: Column) -> Column:
    """``a→b`` as ``b→a``."""
    at = F.locate(ARROW, c)
    return F.concat(F.substr(c, at + 1), F.lit(ARROW), F.substr(c, F.lit(1), at - 1))


def _exact(rules: DataFrame) -> DataFrame:
    """Each exact rule with the operations it is about: as written, turned round, or both."""
    p, turned = F.col("pattern"), _turned(F.col("pattern"))
    ways = F.when(~F.contains(p, F.lit(ARROW)), F.array(p)).when(F.col("direction") == "forward", F.array(p)).when(F.col("direction") == "reverse", F.array(turned))
    ways = F.array_distinct(ways.otherwise(F.array(p, turned)))
    return rules.where("kind <> 'match_regex' and pattern is not null").select("ord", F.explode(ways).alias("op"))


def _searched(rules: DataFrame, ops: DataFrame) -> DataFrame:
    """``ord, op`` of search rules and the operations they find: by the first letters of what a pattern demands."""
    search = rules.where("kind = 'match_regex'").withColumn("part", F.udf(patterns.demanded, "string", useArrow=True)("pattern")).where("part is not null")
    search = written(search.select("ord", "pattern", "part", F.substr("part", F.lit(1), F.lit(GRAM)).alias("gram")))

    def runs(n: int) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.length("op") - n + 1), lambda i: F.substr("op", i, F.lit(n)))
        return F.when(F.length("op") >= n, some).otherwise(F.array().cast("array<string>"))

    grams = F.array_distinct(F.concat(*map(runs, range(1, GRAM + 1))))
    likely = ops.select("op", F.explode(grams).alias("gram")).join(search.where("gram <> ''"), "gram").where(F.contains("op", F.col("part"))).select("ord", "pattern", "op")
    # patterns that demand nothing have to be tried on every different operation
    free = ops.crossJoin(small(search.where("gram = ''").select("ord", "pattern"))).select("ord", "pattern", "op")
    hit = F.udf(patterns.found, "boolean", useArrow=True)
    return likely.union(free).where(hit("pattern", "op")).select("ord", "op")


def first_rule(ops: DataFrame, rules: DataFrame, groups: str = "groups") -> DataFrame:
    """``ops`` plus ``ord`` and ``label`` of the first rule that is about ``op`` and applies to its ``groups``; nulls where there is none.

    ``rules`` has ord, kind (``match_regex`` searches, others compare), pattern, label, direction, groups, exclude_groups.
    An exact rule with an arrow is about the operation as written (``forward``), turned round (``reverse``) or both; a
    rule for groups needs one of them, an excluded group rules it out; null lists are empty, broken
    patterns match nothing. Each different operation meets the rules once, and the plan is the same however
    many rules there are. An empty table of rules or operations gives no label or no rows.
    """
    empty = F.array().cast("array<string>")
    own = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, empty)))
    ops = ops.withColumn("_groups", own(F.col(groups)))
    different = written(ops.where("op is not null").select("op", "_groups").distinct())
    alone = different.select("op").distinct()
    wanted = rules.select("ord", "kind", "pattern", "label", F.coalesce("direction", F.lit("either")).alias("direction"), own(F.col("groups")).alias("wanted"), own(F.col("exclude_groups")).alias("barred"))
    hits = _exact(wanted).join(alone, "op").select("ord", "op").union(_searched(wanted, alone))
    rows = hits.join(wanted.select("ord", "label", "wanted", "barred"), "ord").join(different, "op")
    rows = rows.where(((F.size("wanted") == 0) | F.arrays_overlap("wanted", "_groups")) & ~F.arrays_overlap("barred", "_groups"))
    first = rows.groupBy("op", "_groups").agg(F.min(F.struct("ord", "label")).alias("first"))
    return ops.join(first, ["op", "_groups"], "left").select(*[c for c in ops.columns if c != "_groups"], F.col("first.ord").alias("ord"), F.col("first.label").alias("label"))
