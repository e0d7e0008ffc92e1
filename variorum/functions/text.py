"""Normal forms, tokens and string measures as Column expressions.

Inputs are taken to be NFC: sources compose text once when they read it
(:func:`variorum.functions.udfs.nfc`), so no operator pays for it again.
All of these stay in the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernels.text import CLASSES, EQUIVALENT, GRAPHEMES, MERGED, PUNCT

#: fixed values: editorial signs, vowels of the consonant skeleton, punctuation at word edges
EDITORIAL = "※⁛"
VOWELS = "aāiīuūeēoōəąįų"
EDGE_PUNCT = ",;:\"()[]{}«»—–"
#: fixed values: letters that dots in canonical spelling stand between
DOT_LETTERS = "a-zāēīōūąą̇ṇŋϑδγšṣśžə̨́̄hᵛ"
#: fixed values: marks and letters of another language's transliteration
_CAPITAL = "[A-Z0-9]|[-']"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(" \t\n\r\f\v"))


def squeeze(c: Column) -> Column:
    """White space collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_punct(c: Column) -> Column:
    """Without decorative punctuation anywhere."""
    return F.translate(c, PUNCT, "")


def strip_final_punct(c: Column) -> Column:
    return F.regexp_replace(squeeze(c), f"[{PUNCT}]+$", "")


def ladder_form(c: Column) -> Column:
    """Lower case, trimmed, without editorial signs: what the decision ladder compares."""
    return F.translate(F.lower(strip(c)), EDITORIAL, "")


def bare(c: Column) -> Column:
    return squeeze(strip_punct(c))


def compare_no_space(c: Column) -> Column:
    return F.regexp_replace(bare(c), " ", "")


def token_key(c: Column) -> Column:
    return F.lower(F.translate(c, PUNCT + " ", ""))


def stanza_token(c: Column) -> Column:
    return F.lower(strip(F.translate(c, "⸳⁛", ".")))


def phonological(c: Column) -> Column:
    """Phonological classes merged, initial y before a vowel dropped."""
    for a, b in CLASSES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, r"(?U)\b[yY](?=[aāeēiīoōuū])", "")


def builder_token(c: Column) -> Column:
    """Without leading full stops."""
    return F.regexp_replace(c, r"^\.+", "")


def plain(c: Column) -> Column:
    return F.regexp_replace(squeeze(c), r"\.+$", "")


def canonical_dots(c: Column) -> Column:
    """``xx.y`` as ``xx. y``, then one- and two-letter morphemes joined again: ``ā. mąm`` as ``ā.mąm``."""
    letter = f"[{DOT_LETTERS}]"
    c = F.regexp_replace(c, rf"({letter}{{1,2}})\.({letter})", "$1. $2")
    return F.regexp_replace(c, rf"(^|\s)({letter}{{1,2}})\.\s+(?={letter})", "$1$2.")


def skeleton_by_vowels(c: Column) -> Column:
    """Consonants of a mark-free text: vowels dropped."""
    return F.translate(c, VOWELS, "")


def skeleton(c: Column) -> Column:
    """Matching skeleton: vowels and digits dropped, lone u and i dropped, consonant classes merged in order."""
    c = F.regexp_replace(c, r"[ą̇aeoāąēōūīəə̄ēyẏ\d]", "")
    c = F.regexp_replace(c, "([^u])u([^u])", "$1$2")
    c = F.regexp_replace(c, "([^i])i([^i])", "$1$2")
    return reduce(lambda c, step: reduce(lambda c, one: F.replace(c, F.lit(one), F.lit(step[0])), step[1], c), MERGED, c)


def canonical_feature(c: Column) -> Column:
    """``A for B`` as ``A→B``; only the first separator counts."""
    c = squeeze(c)

    def halves(mark: str) -> Column:
        p = F.split(c, mark, 2)
        return F.concat(F.trim(p[0]), F.lit("→"), F.trim(p[1]))

    return F.when(F.contains(c, F.lit("→")), halves("→")).when(F.contains(c, F.lit(" for ")), halves(" for ")).otherwise(c)


def representative(c: Column) -> Column:
    """The grapheme that stands for ``c`` in feature keys."""
    table = F.create_map(*[F.lit(x) for pair in EQUIVALENT.items() for x in pair])
    return F.coalesce(F.element_at(table, c), c)


def index_list(c: Column) -> Column:
    """``"[1;2,2]"`` to the numbers in it, without repeats, in order."""
    parts = F.split(F.regexp_replace(F.trim(c), r"^\[(.*)\]$", "$1"), "[;,]")
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull()))


def witness_list(c: Column) -> Column:
    """``"5,60"`` to ``"#ms0005 #ms0060"``; ids that are not numbers keep their text."""
    def one(x: Column) -> Column:
        x = F.regexp_replace(F.trim(x), "^#?(ms)?", "")
        return F.concat(F.lit("#ms"), F.when(x.rlike("^[0-9]{1,3}$"), F.lpad(x, 4, "0")).otherwise(x))

    return F.array_join(F.transform(F.filter(F.split(c, r"[,;\s]+"), lambda x: F.trim(x) != ""), one), " ")


def manuscript_id(name: Column) -> Column:
    """``#ms`` and the file stem: numbers padded to four digits, else at most 16 letters and digits."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"\.[^.]*$", "")
    number = F.when(F.length(stem) < 4, F.lpad(stem, 4, "0")).otherwise(stem)
    return F.concat(F.lit("#ms"), F.when(stem.rlike("^[0-9]+$"), number).otherwise(F.substring(F.regexp_replace(stem, "[^0-9A-Za-z]+", ""), 1, 16)))


def certainty(c: Column) -> Column:
    """Three decimals; ``0.500`` for what is no number."""
    # format_number rounds the number as it is stored; format_string rounds its shortest spelling
    return F.coalesce(F.replace(F.format_number(c.try_cast("double"), 3), F.lit(","), F.lit("")), F.lit("0.500"))


def app_id_of(stub: Column) -> Column:
    """The id in an ``<app …>`` stub, by ``xml:id`` or else any ``id``; empty without one."""
    first = F.regexp_extract(stub, 'xml:id="([^"]+)"', 1)
    return F.when(first != "", first).otherwise(F.regexp_extract(stub, r"""\bid=["']([^"']+)["']""", 1))


def reading_of(stub: Column) -> Column:
    return F.trim(F.regexp_extract(stub, r"<rdg[^>]*>(.*?)</rdg>", 1))


def joined_canon(tokens: Column) -> Column:
    """Tokens without one final full stop each, joined by full stops and closed by one."""
    return F.concat(F.array_join(F.transform(tokens, lambda t: F.regexp_replace(t, r"\.$", "")), "."), F.lit("."))


# -- tokens ------------------------------------------------------------------------------------------


def tokens(c: Column) -> Column:
    """White-space tokens; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def edge_stripped(c: Column) -> Column:
    """White-space tokens without punctuation at their ends; full stops stay."""
    edge = "[" + "".join("\\" + x if x in "[]" else x for x in EDGE_PUNCT) + "]+"
    strip = lambda t: F.regexp_replace(F.regexp_replace(t, f"^{edge}", ""), f"{edge}$", "")
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)[^\s<>]+"), F.lit(0)), strip), lambda t: t != "")


def compared_tokens(c: Column) -> Column:
    return F.filter(F.transform(tokens(c), strip_punct), lambda t: t != "")


def graphemes(c: Column) -> Column:
    """Longest known grapheme first, else one character."""
    known = "|".join(sorted((g for g in GRAPHEMES if len(g) > 1), key=len, reverse=True))
    return F.regexp_extract_all(squeeze(c), F.lit(f"(?s){known}|."), F.lit(0))


def is_foreign(token: Column) -> Column:
    """Capitals, digits, hyphens or apostrophes with at most one lower-case letter: another language's transliteration."""
    letters = F.regexp_count(F.lower(token), F.lit("[a-zāąēīōūẏŋšṣḥδθṯṙṝ]"))
    return token.rlike(_CAPITAL) & (letters <= 1)


def has_grapheme(token: Column) -> Column:
    return token.rlike(r"(?U)\p{L}|" + "|".join(g for g in GRAPHEMES if len(g) > 1))


def dot_segments(c: Column) -> Column:
    return F.flatten(F.transform(tokens(c), lambda t: F.filter(F.split(t, r"(?<=\.)(?=[^.])"), lambda s: s != "")))


def sentence_space(c: Column) -> Column:
    """A space after each full stop that a letter follows."""
    return F.regexp_replace(c, r"(?U)\.(?=[^\s\d\W])", ". ")


def bigrams(c: Column) -> Column:
    n = F.length(c) - 1
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))
    return F.when(n >= 1, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def windows(tokens: Column, size: Column) -> Column:
    """All runs of ``size`` tokens."""
    last = F.size(tokens) - size + 1
    runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.slice(tokens, i, size))
    return F.when(last >= 1, runs).otherwise(F.array().cast("array<array<string>>"))


# -- measures ----------------------------------------------------------------------------------------


def bigram_jaccard(a: Column, b: Column) -> Column:
    """Share of common bigrams; texts without bigrams are as like as they are equal, empty ones match only empty ones."""
    x, y = bigrams(a), bigrams(b)
    union = F.size(F.array_union(x, y))
    same = F.when(a == b, 1.0).otherwise(0.0)
    return F.when((a == "") | (b == "") | (union == 0), same).otherwise(F.size(F.array_intersect(x, y)) / union)


def skeletons_match(a: Column, b: Column) -> Column:
    """Equal words, or at most one edit between their skeletons; empty words match nothing."""
    near = F.levenshtein(skeleton(a), skeleton(b), 1) >= 0
    return (a != "") & (b != "") & ((a == b) | near)


def solid_length(c: Column) -> Column:
    return F.length(F.translate(c, ". ", ""))


def too_short(lemma: Column, reading: Column, least: float = 0.6) -> Column:
    n = solid_length(lemma)
    return (n > 0) & (solid_length(reading) / n < least)


def too_long(lemma: Column, reading: Column, most: float = 1.5) -> Column:
    return solid_length(reading) > solid_length(lemma) * most


def contains_closely(a: Column, b: Column, slack: int = 2) -> Column:
    return (F.contains(a, b) | F.contains(b, a)) & (F.abs(F.length(a) - F.length(b)) <= slack)


def families_equal(lemma: Column, reading: Column, patterns: list[str]) -> Column:
    """Whether some one pattern, replaced by ``#`` in both, makes them equal."""
    same = [F.regexp_replace(lemma, p, "#") == F.regexp_replace(reading, p, "#") for p in patterns]
    return reduce(lambda a, b: a | b, same, F.lit(False))


def families_normal(c: Column, families: list[dict]) -> tuple[Column, Column, Column]:
    """(any hit, first family hit, text with every pattern of every family as ``§``), pattern after pattern."""
    first = F.lit(None).cast("string")
    for f in families:
        hit = F.lit(False)
        for p in (*f["patterns"], *f["compare_only"]):
            hit = hit | c.rlike(f"(?iu){p}")
            c = F.regexp_replace(c, f"(?iu){p}", "§")
        first = F.coalesce(first, F.when(hit, F.lit(f["family"])))
    return first.isNotNull(), F.coalesce(first, F.lit("")), c


# -- features ----------------------------------------------------------------------------------------

LONG, SHORT = "āīūēō", "aiueo"
#: fixed values: sibilants, and diphthongs with what they are levelled to
SIBILANTS = ("s", "š", "ṣ", "ś")
LEVELLED = (("ao", "ō"), ("ae", "ē"), ("aē", "ē"), ("ao", "ā"), ("ao", "o"), ("ae", "e"))


def feature_sides(feature: Column) -> tuple[Column, Column]:
    """Both sides of a feature: ``A→B`` gives (A, B), ``A for B`` gives (B, A); empty strings without either."""
    f = F.regexp_replace(squeeze(F.lower(feature)), r"\.+$", "")
    arrow, words = F.split(f, "→", 2), F.split(f, " for ", 2)

    def side(k: int) -> Column:
        return F.when(F.contains(f, F.lit("→")), F.trim(arrow[k])).when(F.contains(f, F.lit(" for ")), F.trim(words[1 - k])).otherwise("")

    return side(0), side(1)


def orthographic(feature: Column) -> Column:
    """Whether a feature is vowel length, a sibilant swap or a levelled diphthong."""
    a, b = feature_sides(feature)
    same = F.translate(a, LONG, SHORT) == F.translate(b, LONG, SHORT)
    # a sibilant swap asks for equal sides but for vowel length, so vowel length already covers it
    swap = (a.isin(*SIBILANTS) | b.isin(*SIBILANTS)) & (a != b) & same
    pair = F.concat(a, F.lit("→"), b)
    level = pair.isin(*[f"{x}→{y}" for p in LEVELLED for x, y in (p, p[::-1])])
    return F.coalesce((a != "") & (b != "") & ((same & (a != b)) | swap | level), F.lit(False))


def triage_band(score: Column) -> Column:
    return F.when((score >= 0.73) & (score < 0.75), "hi").when((score >= 0.70) & (score < 0.73), "mid").otherwise("")


def simple_ops(lemma: Column, reading: Column) -> Column:
    """Atomic operations found by replacement alone: one insertion or deletion, and the first substitution that explains all."""
    verbs = [(lemma, reading, "deleted", F.length(reading) < F.length(lemma)), (reading, lemma, "inserted", F.length(reading) > F.length(lemma))]
    gap = F.lit(None).cast("string")
    for long, short, verb, when in verbs:
        for letter in "həa":
            gap = F.coalesce(gap, F.when(when & (F.replace(long, F.lit(letter), F.lit("")) == short), F.lit(f"{letter} {verb}")))
    swap = F.lit(None).cast("string")
    for a, b in SWAPS:
        hit = F.contains(lemma, F.lit(a)) & F.contains(reading, F.lit(b)) & (F.replace(lemma, F.lit(a), F.lit(b)) == reading)
        swap = F.coalesce(swap, F.when(hit, F.lit(f"{a}→{b}")))
    return F.when(lemma == reading, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(gap, swap)))


#: fixed values: substitutions looked for, lemma to reading, in this order
SWAPS = (
    ("ī", "ū"), ("ū", "ī"), ("i", "e"), ("i", "ə"), ("e", "i"), ("e", "ə"), ("ə", "i"), ("ə", "e"), ("ē", "ī"), ("ī", "ē"), ("ē", "e"),
    ("ā", "ō"), ("ō", "ā"), ("āō", "ō"), ("ō", "āō"), ("y", "ẏ"), ("ẏ", "y"), ("ą", "ą̇"), ("ą̇", "ą"), ("t", "ϑ"), ("ϑ", "t"),
)
