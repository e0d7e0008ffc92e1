"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Built-in expressions only. Patterns run over the whole text; ``split`` gives what
stands between the matches, so a fold over (gap, match) yields code-point
positions. Folds run over ``PART`` matches at a time, each part from its own start:
an array that grows is copied at every step, so one fold over all matches of a text
would cost their square. Quantifiers are possessive and starts are guarded, which
leaves the matches as they are but makes matching linear and free of recursion on
very long runs of digits or letters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str  # Java regular expression, without groups
    hint: str  # cheap test that is true wherever the pattern matches
    valid: str  # SQL test of a match ``{m}``
    score: float  # before context
    context: str  # words that make the kind likelier


_DIGITS = "regexp_replace({m}, '[^0-9]', '')"
_NO_SPACE = "replace({m}, ' ', '')"
#: digits from the right, every second one doubled, nines cast out
_LUHN = (
    f"length({_DIGITS}) between 13 and 19 and aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a + "
    f"case when i % 2 = 1 then int(substring({_DIGITS}, -i, 1)) "
    f"else int(substring({_DIGITS}, -i, 1)) * 2 - if(int(substring({_DIGITS}, -i, 1)) > 4, 9, 0) end) % 10 = 0"
)
_TURNED = f"concat(substring({_NO_SPACE}, 5), substring({_NO_SPACE}, 1, 4))"
#: letters count 10 to 35; the number's remainder by 97 must be 1
_MOD97 = (
    f"length({_NO_SPACE}) between 15 and 34 and aggregate(sequence(1, length({_NO_SPACE})), 0, (a, i) -> "
    f"if(substring({_TURNED}, i, 1) between '0' and '9', a * 10 + int(substring({_TURNED}, i, 1)), "
    f"a * 100 + ascii(substring({_TURNED}, i, 1)) - 55) % 97) = 1"
)
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{{2}}|[0-9]{{1,2}})"

#: the first four are the base kinds: their valid spans always stay
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         "contains({t}, '@')", "true", 0.9, "mail|e-mail|contact|write|kontakt|correo|courriel"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         "contains({t}, '.')", rf"{{m}} rlike r'^{_OCTET}(?:\.{_OCTET}){{{{3}}}}$'", 0.8, "ip|host|server|address|adresse"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", "{t} rlike '[0-9][0-9 -]{{11}}'", _LUHN, 0.8, "card|visa|credit|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains({t}, '+')", f"length({_DIGITS}) between 9 and 15", 0.8,
         "phone|call|tel|mobile|telefon|appel"),
    Kind("iban", r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])",
         "{t} rlike '[A-Z][A-Z][0-9][0-9]'", _MOD97, 0.9, "iban|account|bank|konto|compte|cuenta"),
    Kind("ssn", r"(?<![0-9A-Za-z_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z_])",
         "{t} rlike '[0-9]-[0-9][0-9]-[0-9]'", "true", 0.3, "ssn|social security|tax id"),
)
BASE = ("email", "ip", "card", "phone")
THRESHOLD = 0.5
CONTEXT_GAIN = 0.3
CONTEXT_CHARS = 48
PART = 256  # matches that one fold goes over
_SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body``, in which ``name`` is ``value``, computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _parts(array: str) -> str:
    """SQL for the numbers of the parts of an array; an empty one has one part."""
    return f"sequence(0, greatest(0, (size({array}) - 1) div {PART}))"


def _slice(array: str, part: str) -> str:
    return f"slice({array}, {part} * {PART} + 1, {PART})"


def _spans(kind: Kind, text: str) -> Column:
    """All confirmed spans of a kind, in order; score is 0 to 1 (1 at most).

    A context word counts where it stands whole within ``CONTEXT_CHARS`` characters
    before or after the match, up to the kind's next match.
    """
    pattern = "r'" + kind.pattern.replace("'", "\\'") + "'"
    valid = kind.valid.format(m="x.m").replace("{{", "{").replace("}}", "}")
    n = CONTEXT_CHARS
    before = rf"lower(if(length(x.g) > {n}, right(x.g, {n + 1}), concat(' ', x.g))) rlike r'[^\p{{L}}](?:{kind.context})(?:[^\p{{L}}]|$)'"
    after = rf"lower(if(length(x.h) > {n}, left(x.h, {n + 1}), concat(x.h, ' '))) rlike r'(?:^|[^\p{{L}}])(?:{kind.context})[^\p{{L}}]'"
    pairs = _let(
        "gaps", f"split({text}, {pattern}, -1)",
        f"transform(regexp_extract_all({text}, {pattern}, 0), (m, i) -> struct(get(gaps, i) as g, m as m, get(gaps, i + 1) as h))",
    )
    lengths = f"transform({_parts('p')}, c -> aggregate({_slice('p', 'c')}, 0L, (a, x) -> a + length(x.g) + length(x.m)))"
    starts = f"aggregate({lengths}, array(0L), (a, n) -> concat(a, array(element_at(a, -1) + n)))"
    fold = f"""
      aggregate({_slice("p", "c")}, named_struct('pos', get(starts, c), 'spans', cast(array() as {_SPAN})),
        (a, x) -> named_struct(
          'pos', a.pos + length(x.g) + length(x.m),
          'spans', if({valid},
            concat(a.spans, array(named_struct('kind', '{kind.name}', 'start', a.pos + length(x.g),
              'end', a.pos + length(x.g) + length(x.m),
              'score', least(1.0D, {kind.score}D + if({before} or {after}, {CONTEXT_GAIN}D, 0.0D))))),
            a.spans)),
        a -> a.spans)"""
    found = _let("p", pairs, _let("starts", starts, f"flatten(transform({_parts('p')}, c -> {fold}))"))
    kept = found if kind.name in BASE else f"filter({found}, s -> s.score >= {THRESHOLD}D)"
    hint = kind.hint.format(t=text).replace("{{", "{").replace("}}", "}")
    return F.expr(f"case when {hint} then {kept} else cast(array() as {_SPAN}) end")


def find_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``df`` plus ``pii``: array of (kind, start, end, score).

    Kinds in the order of ``KINDS``, then by start; positions count code points,
    end exclusive. Base kinds (``BASE``) are confirmed by their checks alone;
    the others also need a score of ``THRESHOLD``. Null and empty texts give an
    empty array; repeated rows give equal arrays; an empty table gives no rows;
    a column ``pii`` is replaced and every other column stays.
    """
    kept = [c for c in df.columns if c.lower() != "pii"]
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    row = row.select("row", *[_spans(k, "t").alias(k.name) for k in KINDS])
    return row.select(*[F.col("row")[c].alias(c) for c in kept], F.concat(*[k.name for k in KINDS]).alias("pii"))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every span of ``pii`` in ``text`` replaced by its kind in angle brackets.

    Overlapping spans become one replacement, named by the first. Null texts stay
    null, texts without spans and rows whose ``pii`` is null stay as they are;
    repeated rows give equal texts; an empty table gives no rows; other columns,
    ``pii`` among them, are kept.
    """
    sorted_ = "array_sort(transform(pii, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind)))"
    ends = f"transform({_parts('p')}, c -> aggregate({_slice('p', 'c')}, 0L, (a, s) -> greatest(a, s.end)))"
    upto = f"aggregate({ends}, array(0L), (a, e) -> concat(a, array(greatest(element_at(a, -1), e))))"
    # a part's own piece of the text is cut out first, so that its spans are not looked for from the text's start
    piece = f"substring({text}, int(get(upto, c) + 1), int(get(upto, c + 1) - get(upto, c)))"
    fold = f"""
      aggregate({_slice("p", "c")}, named_struct('pos', get(upto, c), 'out', cast(array() as array<string>)),
        (a, s) -> named_struct(
          'pos', greatest(a.pos, s.end),
          'out', if(s.start >= a.pos,
            concat(a.out, array(substring(piece, int(a.pos - get(upto, c) + 1), int(s.start - a.pos)), concat('<', upper(s.kind), '>'))), a.out)),
        a -> array_join(a.out, ''))"""
    parts = f"transform({_parts('p')}, c -> {_let('piece', piece, fold)})"
    whole = f"concat(array_join({parts}, ''), substring({text}, int(element_at(upto, -1) + 1)))"
    done = _let("p", sorted_, _let("upto", upto, whole))
    return df.withColumn(text, F.expr(f"case when size(pii) > 0 then {done} else {text} end"))


def pii_documents(docs: DataFrame) -> DataFrame:
    """Digest for ``documents``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, best_score.

    Null and empty texts have no spans; null ids and repeated rows stay; further columns go; an empty table gives no rows.
    """
    found = find_pii(docs.select("doc_id", "text"))
    joined = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    base = f"filter(pii, s -> s.kind in {BASE})"
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(pii, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE],
        F.expr(f"sha2({joined.format(base)}, 256)").alias("base_sha256"),
        F.expr(joined.format("pii")).alias("spans"),
        F.expr(f"cast(size(filter(pii, s -> s.kind not in {BASE})) as long)").alias("n_added"),
        F.expr("array_max(transform(pii, s -> s.score))").alias("best_score"),
    )


def oracle() -> str:
    """DuckDB SQL for :func:`pii_documents`: the plain patterns, positions by sums of lengths."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[ -]?[0-9])+",
        "phone": r"\+[0-9][ ().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
        "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    }
    digits = "regexp_replace(x.m, '[^0-9]', '', 'g')"
    solid = "replace(x.m, ' ', '')"
    digit = f"CAST(substr({digits}, length({digits}) - i + 1, 1) AS INT)"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digit} ELSE 2 * {digit} - CASE WHEN {digit} > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    number = f"array_to_string(list_transform(string_split(substr({solid}, 5) || substr({solid}, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END), '')"
    mod97 = f"list_reduce(list_transform(string_split({number}, ''), lambda c: CAST(c AS INT)), lambda a, c: (a * 10 + c) % 97) = 1"
    valid = {
        "email": "true", "ssn": "true",
        "ip": "len(list_filter(string_split(x.m, '.'), lambda o: coalesce(TRY_CAST(o AS HUGEINT), 999) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"length({solid}) BETWEEN 15 AND 34 AND {mod97}",
    }
    cut, spans = [], []
    for k in KINDS:
        n, pattern = k.name, plain[k.name]
        cut.append(f"regexp_split_to_array(t, '{pattern}') AS g_{n}, regexp_extract_all(t, '{pattern}') AS m_{n}")
        before = f"CAST(list_sum(list_transform(g_{n}[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m_{n}[1:i - 1], lambda y: length(y))), 0) AS BIGINT)"
        c = CONTEXT_CHARS
        near = f"""(regexp_matches(lower(CASE WHEN length(x.g) > {c} THEN right(x.g, {c + 1}) ELSE ' ' || x.g END), '[^\\p{{L}}](?:{k.context})([^\\p{{L}}]|$)')
          OR regexp_matches(lower(CASE WHEN length(x.h) > {c} THEN left(x.h, {c + 1}) ELSE x.h || ' ' END), '(^|[^\\p{{L}}])(?:{k.context})[^\\p{{L}}]'))"""
        score = f"least(1.0::DOUBLE, {k.score}::DOUBLE + CASE WHEN {near} THEN {CONTEXT_GAIN}::DOUBLE ELSE 0::DOUBLE END)"
        rows = f"list_transform(range(1, len(m_{n}) + 1), lambda i: {{'g': g_{n}[i], 'm': m_{n}[i], 'h': g_{n}[i + 1], 's': {before}}})"
        rows = f"list_transform(list_filter({rows}, lambda x: {valid[n]}), lambda x: {{'k': '{n}', 's': x.s, 'e': x.s + length(x.m), 'w': {score}}})"
        spans.append((rows if n in BASE else f"list_filter({rows}, lambda z: z.w >= {THRESHOLD})") + f" AS s_{n}")
    every = "list_concat(" + ", ".join(f"s_{k}" for k in BASE) + ")"
    added = "list_concat(" + ", ".join(f"s_{k.name}" for k in KINDS if k.name not in BASE) + ")"
    join = "array_to_string(list_transform({}, lambda z: z.k || ':' || z.s || ':' || z.e), ',')"
    return f"""
WITH c AS (SELECT doc_id, {", ".join(cut)} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)), s AS (SELECT doc_id, {", ".join(spans)} FROM c),
  a AS (SELECT *, {every} AS base, {added} AS added FROM s)
SELECT doc_id, {", ".join(f"len(s_{k}) AS n_{k}" for k in BASE)}, sha256({join.format("base")}) AS base_sha256, {join.format("list_concat(base, added)")} AS spans,
  len(added) AS n_added, list_max(list_transform(list_concat(base, added), lambda z: z.w)) AS best_score FROM a"""
