"""End-to-end plans: build and tag an apparatus; align stanzas and choose; annotate and review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels.annotate import Annotator
from ..operators import apparatus, cascade, ladder, relations, segments
from ..session import written
from ..sources import xml


def tagged_apparatus(lemma: DataFrame, witnesses: DataFrame, rules: list[dict], families: list[dict]) -> DataFrame:
    """``app_id, ab_id, a, b, lem, witness, rdg, type`` from segments (ab_id, ord, text, and path where there are several documents) and (witness, ab_id, text).

    Neighbouring lemmas are those before and behind in the document, so a word run together
    with the first one of the next segment is found. Alignments and readings are each
    written once, as several branches need them.
    """
    work = written(apparatus.aligned(lemma.select("ab_id", "text"), witnesses))
    rows = written(apparatus.readings(work, apparatus.entry_spans(work), witnesses))
    doc = [c for c in ("path",) if c in lemma.columns]
    rows = ladder.with_neighbours(rows.join(lemma.select(*doc, "ab_id", "ord"), "ab_id"), doc, ["ord", "ab_id", "a", "b"])
    return ladder.classify(rows, rules, families).drop("before", "after", "ord", *doc)


def apparatus_of_files(spark: SparkSession, lemma: str, witnesses: list[str], prefixes: list[str], rules, families, remap: DataFrame | None = None) -> DataFrame:
    """The same from TEI files."""
    wanted = written(segments.lemma_segments(xml.read_segments(spark, lemma), prefixes))
    found = written(segments.witness_segments(written(xml.read_segments(spark, witnesses)), wanted, remap))
    return tagged_apparatus(wanted, found, rules, families)


def chosen_alignment(stanzas: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Greedy alignment of all stanzas, dynamic programming where the gate asks for it, and the choice word by word.

    ``stanzas`` has xml_id, canon, our. Greedy runs once and feeds the gate and both results.
    """
    return relations.chosen(stanzas, threshold)


def annotated_readings(readings: DataFrame, groups: DataFrame, annotator: Annotator, overrides: DataFrame | None = None) -> DataFrame:
    """Readings (app_id, lem, wit, rdg) with the cascade's result and their witnesses' groups."""
    return cascade.annotate(cascade.witness_group_sets(readings, groups), annotator, overrides)
