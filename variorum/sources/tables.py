"""CSV and JSON readers with declared schemas and the name variants found in the wild."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as C
from ..session import written

SCORES = ("feature", "label", "variant_likelihood", "doc_freq", "orthography_match", "punct_penalty_applied", "singleton_demoted", "lexical_whitelist_applied", "unstable")
MATCHES = "our_index int, canon_index int, our_indexes array<int>, canon_indexes array<int>, our_word string, canon_word string, relation string, matched boolean"
UNKNOWNS = "app_id string, wit_list string, rdg_text string, lem_text string, feature string, variant_likelihood double, reason string, inference_rule string"


def read_csv(spark: SparkSession, paths: str | list[str], schema: str | None = None) -> DataFrame:
    """Header CSV; all strings without a schema. Multi-line quoted cells are kept."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(paths)


def read_scores(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Feature scores of several files; a feature's row in the first file that has it stays.

    Flag columns are read with or without a closing question mark; missing columns
    are null (flags false, likelihood 0.5, frequency 0).
    """
    parts = []
    for k, path in enumerate(paths):
        raw = read_csv(spark, path)
        raw = raw.toDF(*[c.strip().rstrip("?") for c in raw.columns])
        parts.append(raw.select(*[(F.col(c) if c in raw.columns else F.lit(None).cast("string")).alias(c) for c in SCORES]).withColumn("_file", F.lit(k)))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    flag = lambda c: F.coalesce(F.lower(F.trim(c)).isin("true", "1", "yes"), F.lit(False)).alias(c)
    rows = rows.select(
        C.canonical_feature(F.col("feature")).alias("feature"), F.coalesce("label", F.lit("")).alias("label"),
        F.coalesce(F.col("variant_likelihood").try_cast("double"), F.lit(0.5)).alias("variant_likelihood"),
        F.coalesce(F.col("doc_freq").try_cast("int"), F.lit(0)).alias("doc_freq"), *[flag(c) for c in SCORES[4:]], "_file",
    )
    return first_wins(rows, ["feature"], [F.col("_file"), F.monotonically_increasing_id()]).drop("_file")


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def read_matches(spark: SparkSession, paths: str | list[str], lines: bool = False) -> DataFrame:
    """Greedy match records, single indices turned into lists; a file is one array, or with ``lines`` each of its lines is one."""
    rows = spark.read.schema(MATCHES).option("multiLine", not lines).json(paths)
    lists = {f"{s}_indexes": F.coalesce(f"{s}_indexes", F.when(F.col(f"{s}_index").isNotNull(), F.array(f"{s}_index")), F.array().cast("array<int>")) for s in ("canon", "our")}
    return rows.withColumns(lists).select("canon_indexes", "our_indexes", "canon_word", "our_word", "relation", "matched")


def corpus_id(prefix, number):
    """Segment id of a remote corpus record: prefix, then chapter and verse without leading zeros."""
    part = lambda k: F.regexp_replace(F.regexp_extract(number, r"^(\d+)(?:\.(\d+))?", k), "^0+(?=.)", "")
    return F.concat(prefix, part(1), F.when(part(2) != "", F.concat(F.lit("."), part(2))).otherwise(F.lit("")))


GATE = "xml_id string, canon_count int, our_count int, subs_total int, subs_low int, unmatched int, short_tokens int, error_rate double, triggers array<string>, flagged boolean"
GROUPS = "xml_id string, score double, groups array<struct<c:array<int>,o:array<int>>>"


def read_dry_run(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Report of the gate, one JSON object a line: which stanzas dynamic programming is to see."""
    return spark.read.schema(GATE).json(paths)


def read_groups(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Index groups of each stanza as dynamic programming left them, one JSON object a line."""
    return spark.read.schema(GROUPS).json(paths)


PAGE = "url string, next string, results array<struct<prefix:string,number:string,text:string>>"


def chained(links: DataFrame) -> DataFrame:
    """``url, first, place`` of ``url, next``: the head of each page's chain and its distance from it, by pointer doubling.

    Every page points at the one before; in each round pointers jump as far again, so a chain of n pages takes about
    log2(n) rounds. Of several pages with one ``next`` the least by name leads there, of several rows of a page the one of
    least ``next`` counts. A page that nothing leads to is a head; a ring has none, its pages are left out.
    """
    pages = links.where("url is not null").groupBy("url").agg(F.min("next").alias("next"))
    before = pages.where("next is not null and next <> url").groupBy(F.col("next").alias("url")).agg(F.min("url").alias("up"))
    now = written(pages.select("url").join(before, "url", "left").select("url", F.coalesce("up", "url").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("steps")))
    total = now.count()
    open_, far = now.where("up <> url").count(), 1
    while open_ and far < 2 * total:  # then only rings are left
        jump = now.select(F.col("url").alias("up"), F.col("up").alias("upper"), F.col("steps").alias("more"))
        now = written(now.join(jump, "up").select("url", F.col("upper").alias("up"), (F.col("steps") + F.col("more")).alias("steps")))
        far *= 2
        # done are those that point at a head
        heads = now.where("steps = 0").select(F.col("url").alias("up"))
        open_ = now.join(heads, "up", "left_anti").count()
    heads = now.where("steps = 0").select(F.col("url").alias("up"))
    return now.join(heads, "up", "left_semi").select("url", F.col("up").alias("first"), F.col("steps").cast("int").alias("place"))


def read_chains(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``first, page, ab_id, ord, text`` of saved pages of a corpus service: every chain of ``next`` links, named by its first page.

    A link to a page that was not saved ends its chain. Pages and links are joined by Spark; nothing goes to the driver.
    """
    pages = spark.read.schema(PAGE).json(paths)
    links = pages.select("url", "next")
    there = links.select(F.col("url").alias("next")).distinct()
    links = links.join(there.withColumn("saved", F.lit(True)), "next", "left").select("url", F.when(F.col("saved"), F.col("next")).alias("next"))
    rows = pages.join(chained(links), "url").select("first", F.col("place").alias("page"), F.posexplode("results").alias("ord", "r"))
    return rows.select("first", "page", corpus_id(F.col("r.prefix"), F.col("r.number")).alias("ab_id"), "ord", F.col("r.text").alias("text"))


def walked(links: DataFrame, start: str) -> DataFrame:
    """``url, place`` of the pages of ``url, next`` met from ``start`` on; a page met before, or one that is not there, ends the walk.

    What is met doubles in each round, as links jump as far as the walk has come.
    """
    pages = written(links.where("url is not null").groupBy("url").agg(F.min("next").alias("next")))
    jump, far = pages, 1
    met = written(pages.where(F.col("url") == start).select("url", F.lit(0).cast("long").alias("place")))
    while True:
        ahead = met.join(jump, "url").select(F.col("next").alias("url"), (F.col("place") + far).alias("place"))
        ahead = written(ahead.join(pages.select("url"), "url").join(met.select("url"), "url", "left_anti").groupBy("url").agg(F.min("place").alias("place")))
        if ahead.isEmpty():
            return met.select("url", F.col("place").cast("int").alias("place"))
        met = written(met.union(ahead))
        jump = written(jump.join(jump.toDF("next", "then"), "next").select("url", F.col("then").alias("next")))
        far *= 2


def read_corpus(spark: SparkSession, paths: str | list[str], start: str) -> DataFrame:
    """``page, ab_id, ord, text`` of saved pages of a corpus service, from ``start`` along their ``next`` links. Pages that nothing leads to are left out."""
    pages = spark.read.schema(PAGE).json(paths)
    rows = pages.join(walked(pages.select("url", "next"), start), "url").select(F.col("place").alias("page"), F.posexplode("results").alias("ord", "r"))
    return rows.select("page", corpus_id(F.col("r.prefix"), F.col("r.number")).alias("ab_id"), "ord", F.col("r.text").alias("text"))
