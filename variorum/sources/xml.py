"""TEI, CAB and ALTO readers.

A file is one row (``binaryFile``), parsed in the task that reads it by a table
function; files that don't parse are repaired (:mod:`.repair`), and :func:`unparsed` says
what was wrong and how it was mended. Only a file without any element gives no rows.
Text is composed (NFC) here, once. Each ``read_*`` has an ``*_of`` for files
(``path, content``) that come from elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import text as C
from ..kernels.text import nfc, stanza_token
from .repair import repaired, tree

XML = "{http://www.w3.org/XML/1998/namespace}"
FOREIGN = ("pahl", "pers")
SKIPPED = ("pb", "supplied", "abbr", "foreign", "nerang")


def _local(el) -> str:
    return el.tag.rpartition("}")[2] if isinstance(el.tag, str) else ""


def _id(el) -> str:
    return el.get(f"{XML}id") or ""


def _lang(el) -> str:
    return (el.get(f"{XML}lang") or el.get("lang") or "").lower()


def _reading(app, order: tuple[str, ...]):
    """The reading of an inline ``app`` by type, in the order given; else the first."""
    readings = [r for r in app if _local(r) == "rdg"]
    by_type = {(r.get("type") or "").lower(): r for r in reversed(readings)}
    return next((by_type[t] for t in order if t in by_type), readings[0] if readings else None)


def running_text(el, order: tuple[str, ...] = ("orig", "mod")) -> str:
    """Text of an element: notes left out, inline apps read once, line breaks as a space, or as nothing if ``break="no"``."""
    out: list[str] = []

    def walk(node) -> None:
        out.append(node.text or "")
        for child in node:
            kind = _local(child)
            if kind == "lb":
                out.append("\0" if (child.get("break") or child.get(f"{XML}break") or "").lower() == "no" else "\1")
            elif kind == "app":
                chosen = _reading(child, order)
                if chosen is not None:
                    walk(chosen)
            elif kind != "note":
                walk(child)
            out.append(child.tail or "")

    walk(el)
    return re.sub(r"\s*\x01\s*", " ", re.sub(r"\s*\x00\s*", "", nfc("".join(out))))


@udtf(returnType="kind string, div_id string, key string, place int, text string", useArrow=False)
class Segments:
    """Every element that can be a segment, once for each way to name it: by xml:id, id, n, corresp; ``ab`` elements also for search."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        root = tree(content)
        if root is None:
            return
        parents = {c: p for p in root.iter() for c in p}
        for place, el in enumerate(root.iter()):
            names = [("xml:id", _id(el)), ("id", el.get("id")), ("n", el.get("n")), ("corresp", el.get("corresp"))]
            if not any(v for _, v in names):
                continue
            up, div = el, ""
            while up is not None and not div:
                up = parents.get(up)
                div = _id(up) if up is not None and _local(up) == "div" else ""
            text = running_text(el).strip()
            kinds = {k: v for k, v in names if v}
            for k, v in kinds.items():
                yield k, div, v, place, text
            if _local(el) == "ab":
                yield "ab", div, " ".join(kinds[k] for k in ("xml:id", "id") if k in kinds), place, text


@udtf(returnType="xml_id string, place int, words array<string>", useArrow=False)
class StanzaWords:
    """Words of each ``div`` with an id: foreign and nerang blocks, comments and skipped tags left out."""

    def eval(self, content: bytes, sentence_space: bool) -> Iterator[tuple]:
        root = tree(content)
        if root is None:
            return
        for place, div in enumerate(root.iter()):
            if _local(div) == "div" and _id(div):
                yield _id(div), place, stanza_words(div, sentence_space)


def stanza_words(div, sentence_space: bool = False) -> list[str]:
    words: list[str] = []
    for ab in div.iter():
        if _local(ab) != "ab" or _lang(ab) in FOREIGN or "nerang" in f"{ab.get('n') or ''} {_id(ab)} {ab.get('id') or ''}".lower():
            continue
        parts: list[str] = []

        def flat(el) -> str:
            return " ".join(t.strip() for t in el.itertext() if t.strip())

        def walk(node, parts=parts, flat=flat) -> None:
            # a skipped element loses its own text and tail only, not what its children hold
            kind = _local(node)
            silent = kind in SKIPPED or _lang(node) in FOREIGN
            if kind == "lb" and not silent:
                tail = node.tail or ""
                if (node.get("break") or "").lower() == "no" and parts:
                    parts[-1] = parts[-1].rstrip()
                    tail = tail.lstrip()
                parts.append(tail)
                return
            if kind == "app":
                chosen = _reading(node, ("mod", "orig"))
                parts.append((flat(chosen) if chosen is not None else "") + (node.tail or ""))
                return
            if kind == "seg":
                parts.append((flat(node) or " ") + (node.tail or ""))
                return
            if not silent:
                parts.append(node.text or "")
            for child in node:
                walk(child)
            if not silent and node is not ab:
                parts.append(node.tail or "")

        walk(ab)
        text = "".join(parts)
        if sentence_space:
            text = re.sub(r"\.(?=[^\s\d\W])", ". ", text)
        words += [stanza_token(t) for t in _edge_tokens(text) if not _foreign(t)]
    return words or _edge_tokens("".join(div.itertext()))


def _edge_tokens(text: str) -> list[str]:
    return [t for t in (x.strip(C.EDGE_PUNCT) for x in re.findall(r"[^\s<>]+", text)) if t]


def _foreign(t: str) -> bool:
    return bool(re.search(r"[A-Z0-9'-]", t)) and len(re.findall("[a-zāąēīōūẏŋšṣḥδθṯṙṝ]", t.lower())) <= 1


@udtf(returnType="place int, line int, index int, word string", useArrow=False)
class AltoWords:
    """Words of an ALTO page: every ``String`` of every line, full stops as word ends."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        root, place = tree(content), 0
        if root is None:
            return
        lines = [el for el in root.iter() if _local(el) == "TextLine"]
        for line, el in enumerate(lines):
            text = " ".join(nfc(s.get("CONTENT") or "") for s in el.iter() if _local(s) == "String")
            for index, word in enumerate(text.replace(".", " ").split()):
                yield place, line, index, word
                place += 1


@udtf(returnType="place int, id string, index int, word string", useArrow=False)
class CabWords:
    """Words of every ``ab`` with an id; words broken over lines are joined, inner full stops dropped."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        root, place = tree(content), 0
        if root is None:
            return
        for el in root.iter():
            if _local(el) == "ab" and _id(el):
                for index, word in enumerate(running_text(el).replace(".", " ").split()):
                    yield place, _id(el), index, word
                    place += 1


@udtf(returnType="place int, id string, page string, line string, word string", useArrow=False)
class PagedWords:
    """Words of every ``ab`` with an id, each with the numbers of the ``pb`` and ``lb`` before it in the file."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        root, place, page, line = tree(content), 0, None, None
        if root is None:
            return
        for el in root.iter():
            if _local(el) != "ab" or not _id(el):
                continue
            for part in el.iter():
                page = part.get("n") if _local(part) == "pb" else page
                line = part.get("n") if _local(part) == "lb" else line
                text = [part.text] if part is el or _local(part) not in ("pb", "lb") else []
                for word in " ".join(nfc(t or "") for t in (*text, part.tail if part is not el else "")).split():
                    yield place, _id(el), page, line, word
                    place += 1


@udtf(returnType="div_id string, app_id string, ord int, lem string, rdg_ord int, wit string, rdg string, type string, ana string, cert string, n string", useArrow=False)
class Apparatus:
    """Every reading of every ``app`` of an apparatus, in document order; an ``app`` without readings gives one row with nulls."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        root, ord_ = tree(content), 0
        if root is None:
            return
        for div in [d for d in root.iter() if _local(d) == "div" and _id(d)] or [root]:
            for app in div.iter():
                if _local(app) != "app" or not _id(app):
                    continue
                lem = next((nfc("".join(x.itertext())) for x in app if _local(x) == "lem"), "")
                readings = [r for r in app if _local(r) == "rdg"]
                for k, r in enumerate(readings):
                    yield _id(div), _id(app), ord_, lem, k, r.get("wit"), nfc("".join(r.itertext())), r.get("type"), r.get("ana"), r.get("cert"), r.get("n")
                if not readings:
                    yield _id(div), _id(app), ord_, lem, *[None] * 7
                ord_ += 1


TABLE_FUNCTIONS = {"tei_segments": Segments, "stanza_words": StanzaWords, "alto_words": AltoWords, "cab_words": CabWords, "paged_words": PagedWords, "tei_apparatus": Apparatus}


def _files(spark: SparkSession, paths: str | list[str], glob: str = "*.xml") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(paths).select("path", "content").dropDuplicates(["path"])


def _parsed(files: DataFrame, f, *more) -> DataFrame:
    cols = [F.col("content"), *more]
    return files.lateralJoin(f(*(c.outer() for c in cols)) if more == () else f(F.col("content").outer(), *more)).drop("content")


def segments_of(files: DataFrame) -> DataFrame:
    """``path, kind, div_id, key, place, text, witness`` of all elements with a name; canonical dot spacing applied, empty texts kept."""
    out = _parsed(files, Segments)
    return out.withColumn("witness", C.manuscript_id(F.col("path"))).withColumn("text", F.trim(C.canonical_dots(F.col("text"))))


def read_segments(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return segments_of(_files(spark, paths))


def apparatus_of(files: DataFrame) -> DataFrame:
    """Every reading of every entry of all files: one index over a directory."""
    return _parsed(files, Apparatus)


def read_apparatus(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return apparatus_of(_files(spark, paths))


def stanzas_of(files: DataFrame, sentence_space: bool = False) -> DataFrame:
    """``path, xml_id, words``; of divs that repeat an id in a file the last wins."""
    out = _parsed(files, StanzaWords, F.lit(sentence_space))
    return out.groupBy("path", "xml_id").agg(F.max_by("words", "place").alias("words"))


def read_stanzas(spark: SparkSession, paths: str | list[str], sentence_space: bool = False) -> DataFrame:
    return stanzas_of(_files(spark, paths), sentence_space)


def alto_of(files: DataFrame) -> DataFrame:
    """``page, line, index, word, seq``: pages in order of their names, ``seq`` orders words within a page."""
    out = _parsed(files, AltoWords)
    return out.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("page"), "line", "index", "word", F.col("place").alias("seq"))


def read_alto(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return alto_of(_files(spark, paths))


def cab_of(files: DataFrame) -> DataFrame:
    """``path, id, index, word, seq``."""
    return _parsed(files, CabWords).select("path", "id", "index", "word", F.col("place").alias("seq"))


def paged_of(files: DataFrame) -> DataFrame:
    """``path, id, page, line, seq, word`` by the milestones in the segments; null before the first one."""
    return _parsed(files, PagedWords).select("path", "id", "page", "line", F.col("place").alias("seq"), "word")


def read_paged(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return paged_of(_files(spark, paths))


def read_cab(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return cab_of(_files(spark, paths))


def ocr_words(texts: DataFrame) -> DataFrame:
    """``path, line, index, word`` of ``path, value`` (whole texts), lines counted from 0."""
    lines = texts.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    return lines.select("path", "line", F.posexplode(C.tokens(F.regexp_replace("text", r"\.", " "))).alias("index", "word"))


def read_ocr_text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return ocr_words(spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


@udtf(returnType="error string, line int, repairs array<struct<kind:string,line:int>>", useArrow=False)
class Broken:
    """What keeps a file from being parsed, and what the readers repair in it, in order; nothing if it parses."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            ElementTree.fromstring(content or b"")
        except ElementTree.ParseError as e:
            yield str(e).partition(":")[0], e.position[0], repaired(content)[1]


def unparsed(files: DataFrame) -> DataFrame:
    """``path, error, line, repairs`` of the files that a strict parser refuses, and that the readers repair."""
    return files.lateralJoin(Broken(F.col("content").outer())).drop("content")


def read_unparsed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return unparsed(_files(spark, paths))
