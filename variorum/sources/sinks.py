"""Writers: TEI apparatus, side-by-side text, page milestones, lineage, alignment store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import neighbours

#: fixed values: categories of the taxonomy and their descriptions
TAXONOMY = {"meaningful": "Meaningful variant", "trivial": "Trivial variant", "missing": "Word missing", "unknown": "Unknown"}


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def taxonomy_additions(have: Column, wanted: tuple[str, ...] = tuple(TAXONOMY)) -> Column:
    """Categories that are wanted but not there, in order."""
    return F.array_except(F.array(*[F.lit(w) for w in wanted]), F.coalesce(have, F.array().cast("array<string>")))


def app_xml(readings: DataFrame) -> DataFrame:
    """``doc, ord, xml``: one ``<app>`` a row from ``doc, ord, app_id, lem, wit, rdg`` and, where there, ``type, ana, cert, n``."""
    more = [c for c in ("type", "resp", "cert", "ana", "n") if c in readings.columns]
    attr = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f' {name}="'), escaped(F.col(c)), F.lit('"'))).otherwise("")
    rdg = F.concat(F.lit("<rdg"), attr("wit", "wit"), *[attr(c, c) for c in more], F.lit(">"), escaped(F.coalesce("rdg", F.lit(""))), F.lit("</rdg>"))
    rows = readings.withColumn("_rdg", F.struct("wit", rdg.alias("xml")))
    apps = rows.groupBy("doc", "ord", "app_id", "lem").agg(F.array_sort(F.collect_list("_rdg")).alias("r"))
    xml = F.concat(
        F.lit('<app xml:id="'), escaped(F.col("app_id")), F.lit('"><lem>'), escaped(F.col("lem")), F.lit("</lem>"),
        F.array_join(F.transform("r", lambda x: x["xml"]), ""), F.lit("</app>"),
    )
    return apps.select("doc", "ord", "app_id", xml.alias("xml"))


def write_tei(apps: DataFrame, path: str, div_id: str) -> None:
    """One file a document under ``path``/doc=…, header, taxonomy and apps in order; rows are sorted in their partition, never gathered in one value."""
    categories = "".join(f'<category xml:id="{k}"><catDesc>{v}</catDesc></category>' for k, v in TAXONOMY.items())
    head = (
        '<?xml version="1.0" encoding="UTF-8"?><TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><encodingDesc><classDecl><taxonomy>'
        f'{categories}</taxonomy></classDecl></encodingDesc></teiHeader><text><body><div xml:id="{div_id}">'
    )
    docs = apps.select("doc").distinct()
    ends = docs.select("doc", F.lit(-1).alias("ord"), F.lit(head).alias("xml")).union(
        docs.select("doc", F.lit(2**31 - 1).alias("ord"), F.lit("</div></body></text></TEI>").alias("xml"))
    )
    rows = apps.select("doc", F.col("ord").cast("int").alias("ord"), "xml").union(ends)
    rows.repartition("doc").sortWithinPartitions("doc", "ord").select("doc", "xml").write.partitionBy("doc").text(path)


def write_report(df: DataFrame, path: str, csv: bool = True) -> None:
    """A table as JSON lines under ``path``/json and, unless it holds structures that CSV can't show, as CSV with a header; lists become ``;``-joined cells."""
    df.write.mode("overwrite").json(f"{path}/json")
    if csv:
        cell = lambda f: F.array_join(F.col(f.name).cast("array<string>"), ";").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name)
        df.select(*map(cell, df.schema)).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/csv")


def ocr_text(words: DataFrame) -> DataFrame:
    """``path, value`` of ``path, line, index, word``: words joined by spaces, lines by line ends; lines without words are empty."""
    lines = words.groupBy("path", "line").agg(F.array_sort(F.collect_list(F.struct("index", "word"))).alias("w"))
    lines = lines.select("path", F.struct("line", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text")).alias("l"))
    whole = lines.groupBy("path").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    at = F.transform(F.sequence(F.lit(0), F.array_max(F.transform("ls", lambda x: x["line"]))), lambda i: F.coalesce(F.filter("ls", lambda x: x["line"] == i)[0]["text"], F.lit("")))
    return whole.select("path", F.array_join(at, "\n").alias("value"))


def write_ocr_text(words: DataFrame, path: str) -> None:
    """One plain text file a page under ``path``/page=…."""
    ocr_text(words).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("page"), "value").write.mode("overwrite").partitionBy("page").text(path, lineSep="\n")


def _rewritten(change):
    """Whole XML files through ``change(root, rows)``; files that don't parse stay as they are."""
    from xml.etree import ElementTree

    def run(content, rows):
        try:
            root = ElementTree.fromstring(bytes(content))
        except ElementTree.ParseError:
            return content
        change(root, rows or [])
        return ElementTree.tostring(root, encoding="utf-8")

    # a hundred files at a time; an Arrow batch holds ten thousand, with all their words as objects
    return F.udf(run, "binary", useArrow=False)


def _own_id(el) -> str:
    return el.get("{http://www.w3.org/XML/1998/namespace}id") or ""


def replaced_segments(files: DataFrame, texts: DataFrame) -> DataFrame:
    """``path, content`` with the ``ab`` elements named in ``path, ab_id, text`` holding the new text instead of what they held."""

    def change(root, rows) -> None:
        new = {r["ab_id"]: r["text"] for r in rows}
        for el in root.iter():
            if isinstance(el.tag, str) and el.tag.rpartition("}")[2] == "ab" and _own_id(el) in new:
                for child in list(el):
                    el.remove(child)
                el.text = new[_own_id(el)]

    by = texts.groupBy("path").agg(F.collect_list(F.struct("ab_id", "text")).alias("rows"))
    return files.join(by, "path", "left").select("path", _rewritten(change)("content", "rows").alias("content"))


def paged_segments(files: DataFrame, words: DataFrame) -> DataFrame:
    """``path, content`` with the ``ab`` elements named in ``path, ab_id, seq, page, line, word`` holding these words instead of what they held.

    ``seq`` orders the words of a file. Where page or line is another than that of the word before, in
    whatever segment, an empty ``pb`` or ``lb`` with its number stands before the word (lines are
    counted from 0 and numbered from 1); the first word of a file has both. The elements have the
    namespace of the segment. A segment that is named twice is filled at its first place.
    """
    seen = neighbours(words.withColumn("at", F.struct("page", "line")), ["path"], ["seq"], "at")
    new = lambda c: F.col("before").isNull() | ~F.col(f"before.{c}").eqNullSafe(F.col(c))
    items = seen.select(
        "path", "ab_id", "seq", F.when(new("page"), F.col("page").cast("string")).alias("pb"), F.when(new("line"), (F.col("line") + 1).cast("string")).alias("lb"), "word"
    )

    def change(root, rows) -> None:
        by: dict[str, list] = {}
        for r in sorted(rows, key=lambda r: r["seq"]):
            by.setdefault(r["ab_id"], []).append(r)
        for ab in root.iter():
            space, _, name = ab.tag.rpartition("}") if isinstance(ab.tag, str) else ("", "", "")
            if name != "ab" or _own_id(ab) not in by:
                continue
            for child in list(ab):
                ab.remove(child)
            ab.text, last = "", None
            for r in by.pop(_own_id(ab)):
                for kind in ("pb", "lb"):
                    if r[kind] is not None:
                        last = ab.makeelement(f"{space}}}{kind}" if space else kind, {"n": r[kind]})
                        ab.append(last)
                if last is None:
                    ab.text += f" {r['word']}"
                else:
                    last.tail = f"{last.tail or ''} {r['word']}"

    by = items.groupBy("path").agg(F.collect_list(F.struct("ab_id", "seq", "pb", "lb", "word")).alias("rows"))  # a file's words: the file is one cell itself
    return files.join(by, "path", "left").select("path", _rewritten(change)("content", "rows").alias("content"))


def annotated_files(files: DataFrame, readings: DataFrame) -> DataFrame:
    """``path, content`` with ``resp, cert, ana, n`` set on the readings named by ``app_id, wit``, in place; files already annotated (``*.v3.xml``) are left out.

    Running it on its own result sets the same values again.
    """

    def change(root, rows) -> None:
        new = {(r["app_id"], r["wit"]): r for r in rows}
        for app in root.iter():
            if isinstance(app.tag, str) and app.tag.rpartition("}")[2] == "app":
                for rdg in app:
                    r = new.get((_own_id(app), rdg.get("wit")))
                    if r is not None:
                        for name in ("resp", "cert", "ana", "n"):
                            rdg.set(name, r[name] or "")

    by = readings.groupBy("path").agg(F.collect_list(F.struct("app_id", "wit", "resp", "cert", "ana", "n")).alias("rows"))
    open_ = files.where(~F.col("path").endswith(".v3.xml"))
    return open_.join(by, "path", "left").select("path", _rewritten(change)("content", "rows").alias("content"))


def multi_view_xml(apps: DataFrame) -> DataFrame:
    """``stem, xml``: one ``div`` a file from ``stem, ord, app_id, xml``, its id the stem, all ids prefixed by it."""
    xml = F.expr("replace(xml, concat('xml:id=\"', app_id, '\"'), concat('xml:id=\"', stem, '__', app_id, '\"'))")
    rows = apps.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("ord", xml.alias("xml")))).alias("a"))
    body = F.array_join(F.transform("a", lambda x: x["xml"]), "")
    return rows.select("stem", F.concat(F.lit('<div xml:id="'), escaped(F.col("stem")), F.lit('">'), body, F.lit("</div>")).alias("xml"))


def view_files(divs: DataFrame, most: int) -> DataFrame:
    """``path, content``: the ``div`` of :func:`multi_view_xml` in whole files of about ``most`` each, so that no file grows with their number."""
    n = -(-divs.count() // most) or 1
    rows = divs.groupBy(F.pmod(F.xxhash64("stem"), F.lit(n)).alias("f")).agg(F.array_sort(F.collect_list(F.struct("stem", "xml"))).alias("d"))
    body = F.concat(F.lit("<TEI>"), F.array_join(F.transform("d", lambda x: x["xml"]), ""), F.lit("</TEI>"))
    return rows.select(F.concat(F.lit("view-"), "f", F.lit(".xml")).alias("path"), F.encode(body, "UTF-8").alias("content"))


def multi_view(apps: DataFrame, stem: str = "stem") -> DataFrame:
    """Apparatus rows of several files as one: every id prefixed by its file's stem."""
    return apps.withColumn("app_id", F.concat(F.col(stem), F.lit("__"), F.col("app_id")))


def milestones(words: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """``page, line, word`` rows with the markers that stand before each word where page or line change."""
    w = Window.partitionBy(doc).orderBy(*order)
    new_page = ~F.col("page").eqNullSafe(F.lag("page").over(w))
    new_line = new_page | ~F.col("line").eqNullSafe(F.lag("line").over(w))
    return words.withColumns({
        "marks": F.concat(
            F.when(new_page, F.concat(F.lit('<pb n="'), escaped(F.col("page").cast("string")), F.lit('"/>'))).otherwise(""),
            F.when(new_line, F.concat(F.lit('<lb n="'), F.col("line").cast("string"), F.lit('"/>'))).otherwise(""),
        )
    })


def side_by_side(pairs: DataFrame, group: str, order: str, left: str, right: str) -> DataFrame:
    """``group, ord, text``: both sides padded to the wider of the two, joined by a tab."""
    width = F.greatest(F.length(left), F.length(right))
    return pairs.select(group, F.col(order).alias("ord"), F.concat(F.rpad(left, width, " "), F.lit("\t"), F.rpad(right, width, " ")).alias("text"))


def lineage(df: DataFrame, source_path: str, script: str, threshold: float | None = None) -> DataFrame:
    """One row on where a table came from: hash of the source file, rows in and kept, time, parameters."""
    spark = df.sparkSession
    source = spark.read.format("binaryFile").load(source_path)
    digest = source.select(F.sha2("content", 256).alias("source_sha256"), F.col("path").alias("source_csv"))
    counts = df.agg(F.count(F.lit(1)).alias("row_count"))
    return digest.crossJoin(counts).withColumns({
        "created_at": F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        "pair_threshold": F.lit(threshold).cast("double"), "script": F.lit(script),
    })


def write_alignments(df: DataFrame, path: str, jsonl: str | None = None) -> None:
    """Alignment store: Parquet by witness, sorted so that row groups prune by stanza; the same rows as JSON lines if a path for them is given."""
    if jsonl:
        df.write.mode("overwrite").json(jsonl)
    df.repartition("witness_id", F.pmod(F.xxhash64("stanza_id"), F.lit(64))).sortWithinPartitions("witness_id", "stanza_id", "our_index").write.mode(
        "overwrite"
    ).partitionBy("witness_id").parquet(path)
