"""XML that a strict parser refuses, read all the same: nothing a reader could want is lost.

A scanner walks the text with a stack of open elements. An end tag closes the nearest open
element of its name and all inside it; one that names none is dropped. Elements still open at
the end are closed there. ``&`` and ``<`` that begin nothing, and unknown entities, stay as
text. A tag cut off by the next one ends there; values may lack quotes; of attributes that
repeat the first stays; content after the root goes into it; a prefix nobody declared is
dropped; characters that XML forbids go. Each repair is noted with its line.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from xml.etree import ElementTree

XML = "http://www.w3.org/XML/1998/namespace"
ENTITIES = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}

_NAME = r"[^\W\d][\w.:-]*"
_START, _END = re.compile(rf"<({_NAME})"), re.compile(rf"</\s*({_NAME})[^<>]*(>?)")
_ATTRIBUTE = re.compile(rf"\s*({_NAME})(?:\s*=\s*(?:\"([^\"<]*)\"|'([^'<]*)'|([^\s\"'<>]+)))?")
_CLOSE = re.compile(r"\s*(/?)>")
_AMP = re.compile(r"&(?:(\w+);|#(\d+);|#x([0-9a-fA-F]+);)?")
_FORBIDDEN = re.compile("[\0-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")
_ENCODING = re.compile(rb"""^\s*<\?xml[^>]*\sencoding\s*=\s*["']([A-Za-z0-9._-]+)["']""")


def decoded(content: bytes, note: Callable[[str, int], None]) -> str:
    """Text by its byte order mark, its declaration, or UTF-8; bytes that are none become U+FFFD."""
    declared = _ENCODING.search(content[:400])
    name = "utf-8-sig" if content[:3] == b"\xef\xbb\xbf" else "utf-16" if content[:2] in (b"\xff\xfe", b"\xfe\xff") else (declared[1].decode() if declared else "utf-8")
    try:
        return content.decode(name)
    except (UnicodeDecodeError, LookupError):
        note("undecodable bytes", 0)
        return content.decode("utf-8", "replace")


class _Scanner:
    def __init__(self, content: bytes):
        self.repairs: list[tuple[str, int]] = []
        self.builder = ElementTree.TreeBuilder()
        self.open: list[tuple[str, str, dict[str, str]]] = []  # name as written, full name, prefixes
        self.root, self.ended, self.whole = False, False, False
        self._counted, self._line = 0, 1
        self.text = ""
        self.text = decoded(content, self.note).replace("\r\n", "\n").replace("\r", "\n")

    def note(self, kind: str, at: int) -> None:
        if at > self._counted:  # repairs are met in order: each line end is counted once
            self._line += self.text.count("\n", self._counted, at)
            self._counted = at
        self.repairs.append((kind, self._line))

    def _plain(self, raw: str, at: int) -> str:
        """Character data or a value: entities replaced, forbidden characters gone."""
        if "&" in raw:

            def one(m: re.Match) -> str:
                number = int(m[2]) if m[2] else int(m[3], 16) if m[3] else None
                if m[1] in ENTITIES:
                    return ENTITIES[m[1]]
                if number is not None and 0 < number < 0x110000:
                    return chr(number)
                self.note("unknown entity" if len(m[0]) > 1 else "bare &", at + m.start())
                return m[0]

            raw = _AMP.sub(one, raw)
        if _FORBIDDEN.search(raw):
            self.note("forbidden character", at)
            raw = _FORBIDDEN.sub("", raw)
        return raw

    def data(self, raw: str, at: int, literal: bool = False) -> None:
        if not raw or (not self.root or self.ended) and not raw.strip("﻿ \t\n"):
            return
        text = raw if literal else self._plain(raw, at)
        if not self.root:
            self.note("text before the root", at)
        else:
            self._again(at)
            self.builder.data(text)

    def _again(self, at: int) -> None:
        if self.ended:
            self.note("content after the root", at)
            self.ended = False

    def _full(self, name: str, spaces: dict[str, str], at: int, element: bool) -> str:
        prefix, colon, local = name.partition(":")
        if not colon:
            return f"{{{spaces['']}}}{name}" if element and spaces.get("") else name
        if prefix not in spaces:
            self.note("undeclared prefix", at)
            return local
        return f"{{{spaces[prefix]}}}{local}"

    def start(self, m: re.Match) -> int:
        """Takes a start tag and gives the place behind it."""
        self._again(m.start())
        at, found = m.end(), {}
        while (a := _ATTRIBUTE.match(self.text, at)) and a.end() > at:
            if a[1] in found:
                self.note("repeated attribute", at)
            elif a[2] is None and a[3] is None:
                self.note("value without quotes" if a[4] else "attribute without a value", at)
            found.setdefault(a[1], self._plain(a[2] or a[3] or a[4] or "", at))
            at = a.end()
        closed = _CLOSE.match(self.text, at)
        if not closed:
            self.note("unfinished tag", at)
            # what is left of the tag goes up to its end or to the next tag
            to = re.compile("[<>]").search(self.text, at)
            at = len(self.text) if not to else to.start() + (to[0] == ">")
        spaces = dict(self.open[-1][2]) if self.open else {"xml": XML}
        for k, v in found.items():
            if k == "xmlns" or k.startswith("xmlns:"):
                spaces[k[6:]] = v
        attributes = {self._full(k, spaces, m.start(), False): v for k, v in found.items() if k != "xmlns" and not k.startswith("xmlns:")}
        full = self._full(m[1], spaces, m.start(), True)
        self.builder.start(full, attributes)
        self.root = True
        if closed and closed[1] and self.open:
            self.builder.end(full)
        else:
            self.open.append((m[1], full, spaces))
            if len(self.open) == 1:
                self.ended = self.whole = bool(closed and closed[1])  # an empty root
        return closed.end() if closed else at

    def end(self, m: re.Match) -> None:
        if not m[2]:
            self.note("unfinished tag", m.start())
        k = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == m[1]), -1)
        if k < 0 or self.ended:
            self.note("stray end tag", m.start())
            return
        for _, full, _ in reversed(self.open[max(1, k) + (k > 0) :]):
            self.note("unclosed element", m.start())
            self.builder.end(full)
        del self.open[max(1, k) + (k > 0) :]
        if k:
            self.builder.end(self.open.pop()[1])
        else:
            self.ended = self.whole = True  # the root stays open for what may follow

    def run(self):
        """The tree, or None without an element."""
        text, at = self.text, 0
        while at < len(text):
            lt = text.find("<", at)
            if lt < 0:
                self.data(text[at:], at)
                break
            self.data(text[at:lt], at)
            at = lt
            for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<?", "?>"), ("<!DOCTYPE", ">")):
                to = text.find(closing, lt + len(opening)) if text.startswith(opening, lt) else -1
                if to >= 0:
                    if opening == "<!DOCTYPE" and "[" in text[lt:to]:
                        to = max(to, text.find("]>", lt) + 1)
                    if opening == "<![CDATA[":
                        self.data(text[lt + 9 : to], lt, literal=True)
                    at = to + len(closing)
                    break
            if at > lt:
                continue
            if m := _END.match(text, lt):
                self.end(m)
                at = m.end()
            elif m := _START.match(text, lt):
                at = self.start(m)
            else:
                self.note("bare <", lt)
                self.data("<", lt, literal=True)
                at = lt + 1
        if not self.root:
            return None
        for _, full, _ in reversed(self.open[1:]):
            self.note("unclosed element", len(text))
            self.builder.end(full)
        if not self.whole:
            self.note("unclosed element", len(text))
        self.builder.end(self.open[0][1])
        return self.builder.close()


def repaired(content: bytes | None) -> tuple[ElementTree.Element | None, list[tuple[str, int]]]:
    """The tree of a broken file (None if it holds no element), and what was repaired: kinds and lines, in order."""
    scanner = _Scanner(content or b"")
    root = scanner.run()
    return root, scanner.repairs


def tree(content: bytes | None) -> ElementTree.Element | None:
    """The tree of a file, repaired where it must be; comments are left out."""
    try:
        parser = ElementTree.XMLParser(target=ElementTree.TreeBuilder(insert_comments=False))
        return ElementTree.fromstring(content or b"", parser)
    except (ElementTree.ParseError, LookupError, ValueError):
        return repaired(content)[0]
