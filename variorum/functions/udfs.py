"""Arrow wrappers of the kernels, for DataFrames and, after :func:`register`, for SQL.

A call handles a whole token list or string pair, so the Arrow boundary is crossed
with coarse rows. Nulls count as empty. Operators call them on distinct inputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udf import UserDefinedFunction

from ..kernels import align as A
from ..kernels import calls as K
from ..kernels import diff as D
from ..kernels import gestalt as S
from ..kernels import greedy as G
from ..kernels import post as P
from ..kernels import text as T

OPS = "array<struct<op:string,ls:int,le:int,ws:int,we:int>>"
SPANS = "array<struct<a:int,b:int,surface:string>>"
GROUPS = "array<struct<c:array<int>,o:array<int>>>"
RECORDS = "array<struct<canon_indexes:array<int>,our_indexes:array<int>,canon_word:string,our_word:string,relation:string,matched:boolean>>"


class _Lazy:
    """A UDF made when it is called: its type is parsed by a running session, and modules are imported before there is one."""

    def __init__(self, f: Callable, kind: str, batches: bool = False):
        self.f, self.kind, self.batches = f, kind, batches  # of values, or of whole Arrow arrays

    def made(self) -> UserDefinedFunction:
        return F.arrow_udf(self.f, self.kind) if self.batches else F.udf(self.f, self.kind, useArrow=True)

    def __call__(self, *columns) -> Column:
        return self.made()(*columns)

    def once(self, *columns) -> Column:
        """The same, never moved or repeated by the optimizer: a result that is exploded would be asked for its size first, by a second call below the last shuffle."""
        return self.made().asNondeterministic()(*columns)


_udf = _Lazy


def _strings(f: Callable) -> Callable:
    return lambda *xs: f(*("" if x is None else x for x in xs))


def _lists(f: Callable) -> Callable:
    return lambda *xs: f(*([] if x is None else list(x) for x in xs))


nfc = _udf(_strings(T.nfc), "string")
base_form = _udf(_strings(T.base_form), "string")
without_marks = _udf(_strings(T.without_marks), "string")
compare_form = _udf(_strings(T.compare_form), "string")
search_form = _udf(_strings(T.search_form), "string")
base_tokens = _udf(_strings(T.base_tokens), "array<string>")
gestalt_ratio = _udf(_strings(S.ratio), "double")
spelling_ratio = _udf(_strings(G.spelling_ratio), "double")
fuzzy_equal = _udf(_strings(lambda a, b: S.ratio(T.search_form(a), T.search_form(b)) >= 0.92), "boolean")
graphemes = _udf(_strings(T.graphemes), "array<string>")
atomic_ops = _udf(_strings(D.atomic_ops), "array<string>")
equivalent_ops = _udf(_strings(D.equivalent_ops), "array<string>")
token_feature = _udf(_strings(D.token_feature), "string")
inferred_feature = _udf(_strings(D.inferred_feature), "string")
concise_diphthong = _udf(_strings(D.concise_diphthong), "string")
align_dp = _udf(_lists(lambda a, b: [dict(zip(("op", "ls", "le", "ws", "we"), x, strict=True)) for x in A.align(a, b)]), OPS)
align_spans = _udf(_lists(lambda a, b: [dict(zip(("a", "b", "surface"), x, strict=True)) for x in A.surfaces(A.align(a, b), a, b)]), SPANS)
alignment = _udf(_lists(K.alignment), f"struct<spans:{SPANS},cover:array<array<int>>,diff:array<int>>")
opcode_spans = _udf(_lists(lambda a, b: [dict(zip(("a", "b", "surface"), x, strict=True)) for x in A.opcode_spans(a, b)]), SPANS)
greedy_spans = _udf(_lists(lambda a, b: [dict(zip(("a", "b", "surface"), x, strict=True)) for x in A.greedy_spans(a, b)]), SPANS)
coverage = _udf(_lists(lambda a, b: A.coverage(A.align(a, b), len(a))), "array<array<int>>")
differing = _udf(_lists(A.differing), "array<int>")
reading_of = _udf(lambda a, b, i, j: A.reading_of(list(a or []), list(b or []), i, j), "string")
compounds = _udf(_lists(lambda a, b: [dict(zip(("ls", "le", "w"), x, strict=True)) for x in A.compounds(a, b)]), "array<struct<ls:int,le:int,w:int>>")
align_nw = _udf(_lists(K.needleman_result), f"struct<groups:{GROUPS},score:double>")
pair_groups = _udf(_lists(K.paired), "array<array<int>>")
align_greedy = _udf(K.greedy_column, RECORDS, batches=True)
consonants_apart = _udf(K.apart_column, "boolean", batches=True)
count_below = _udf(lambda a, b, low: K.count_below([] if a is None else a, [] if b is None else b, low), "bigint")
group_positions = _udf(lambda groups, n: K.group_positions([] if groups is None else groups, n or 0), "array<array<int>>")
single_positions = _udf(lambda records, n: K.single_positions([] if records is None else records, n or 0), "array<array<int>>")
dp_positions = _udf(lambda canon, our, threshold: K.dp_positions([] if canon is None else canon, [] if our is None else our, threshold), "array<array<int>>")
greedy_groups = _udf(
    _lists(K.grouped_records), GROUPS
)
anchored = _udf(_lists(lambda a, b: [{"c": c, "o": o} for c, o in G.anchored(a, b)]), "array<struct<c:int,o:int>>")
trim_fused = _udf(_strings(P.trim_fused), "string")
best_window = _udf(_strings(P.best_window), "string")
trim_by_segments = _udf(lambda lemma, reading: P.trim_by_segments(list(lemma or []), reading or ""), "string")
drop_neighbours = _udf(
    lambda reading, lemma, before, after: P.drop_neighbours(
        reading or "", list(lemma or []), [list(x or []) for x in before or []], [list(x or []) for x in after or []]
    ),
    "string",
)
trimmed_line = _udf(_lists(P.trimmed_line), "array<string>")

NAMES = (
    "nfc base_form without_marks compare_form search_form base_tokens gestalt_ratio spelling_ratio fuzzy_equal graphemes atomic_ops "
    "equivalent_ops token_feature inferred_feature concise_diphthong align_dp align_spans alignment opcode_spans greedy_spans coverage differing "
    "reading_of compounds align_nw pair_groups align_greedy greedy_groups anchored trim_fused best_window trim_by_segments drop_neighbours trimmed_line"
).split()


def register(spark: SparkSession) -> None:
    """Make every function of this module callable in SQL by its name, and the readers' table functions too."""
    from ..sources import xml

    for name in NAMES:
        spark.udf.register(name, globals()[name].made())
    for name, f in xml.TABLE_FUNCTIONS.items():
        spark.udtf.register(name, f)
