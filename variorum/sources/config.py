"""Configuration files as plain records and DataFrames. A missing or unreadable file is an empty configuration.

These are hand-written files of some hundred lines at most: the driver reads one by its path. Many
of them (a file for each text or witness) go through ``*_of``, as columns of ``path, content``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = "ord int, kind string, pattern string, label string, direction string, groups array<string>, exclude_groups array<string>, notes string"
GROUPS = "witness string, grp string"
REMAP = "witness string, ab_id string, lookup_id string"


def _parsed(text: str | bytes | None) -> dict:
    import yaml

    try:
        data = yaml.safe_load(text or "")
    except yaml.YAMLError:
        return {}
    return data if isinstance(data, dict) else {}


def _yaml(path: str | None) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            return _parsed(f.read())
    except (OSError, TypeError):
        return {}


def rules(path: str | None) -> tuple[list[dict], str]:
    """Policy rules in order, and the label of what no rule decides (or an empty string)."""
    return _rules(_yaml(path))


def _rules(data: dict) -> tuple[list[dict], str]:
    out = []
    for r in data.get("rules") or []:
        kind = "match" if r.get("match") else "match_regex" if r.get("match_regex") else None
        if kind:
            out.append({
                "ord": len(out), "kind": kind, "pattern": r[kind], "label": (r.get("label") or "trivial").strip().lower(),
                "direction": (r.get("direction") or "either").lower(), "groups": list(r.get("groups") or []),
                "exclude_groups": list(r.get("exclude_groups") or []), "notes": r.get("notes"),
            })
    return out, data.get("default_nontrivial_label") or ""


def families(path: str | None, strict: bool = True) -> list[dict]:
    """Orthography families in order. ``strict`` takes the file as it parses; otherwise a family nested
    in another one by wrong indentation counts as a family of its own."""
    return _families(_yaml(path), strict)


def _families(data: dict, strict: bool) -> list[dict]:
    out = []

    def add(name: str, spec: dict) -> None:
        out.append({
            "family": name, "patterns": list(spec.get("patterns") or []), "compare_only": list(spec.get("compare_only_regex") or spec.get("compare_only") or []),
        })
        if not strict:
            for k, v in spec.items():
                if isinstance(v, dict):
                    add(k, v)

    for name, spec in (data.get("families") or {}).items():
        if isinstance(spec, dict):
            add(name, spec)
    return out


def rules_frame(spark: SparkSession, records: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r.values()) for r in records], RULES)


def witness_groups(spark: SparkSession, path: str | None) -> DataFrame:
    return spark.createDataFrame(_groups(_yaml(path)), GROUPS)


def _groups(data: dict) -> list[tuple]:
    return [(str(w).strip(), g) for g, ws in (data.get("groups") or {}).items() for w in ws or []]


def id_remap(spark: SparkSession, path: str | None) -> DataFrame:
    return spark.createDataFrame(_remap(_yaml(path)), REMAP)


def _remap(data: dict) -> list[tuple]:
    return [(str(w).strip(), str(a), str(b)) for w, m in (data.get("witnesses") or {}).items() for a, b in (m or {}).items()]


def whitelist(path: str | None) -> list[str]:
    try:
        with open(path, encoding="utf-8") as f:
            return _words(f.read())
    except (OSError, TypeError):
        return []


def _words(text: str) -> list[str]:
    return [t for t in map(str.strip, text.splitlines()) if t and not t.startswith("#")]


def _each(files: DataFrame, rows_of: Callable[[str], list], kind: str) -> DataFrame:
    """``path`` and the fields of every record that ``rows_of`` finds in a file's text; files without one give no rows."""

    def run(content: bytes | None) -> list:
        return rows_of((content or b"").decode("utf-8", "replace"))

    rows = files.withColumn("r", F.explode(F.udf(run, f"array<struct<{kind}>>", useArrow=True)("content")))
    return rows.select("path", "r.*")


def _struct(schema: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (c.split(" ", 1) for c in schema.split(", ")))


def rules_of(files: DataFrame) -> DataFrame:
    """``path``, the fields of ``RULES`` and ``otherwise``, the label of what no rule of the file decides."""

    def rows(text: str) -> list[dict]:
        found, otherwise = _rules(_parsed(text))
        return [r | {"otherwise": otherwise} for r in found]

    return _each(files, rows, _struct(f"{RULES}, otherwise string"))


def families_of(files: DataFrame, strict: bool = True) -> DataFrame:
    """``path, ord, family, patterns, compare_only`` in the order of each file; ``strict`` as in :func:`families`."""
    rows = lambda text: [f | {"ord": k} for k, f in enumerate(_families(_parsed(text), strict))]
    return _each(files, rows, _struct("ord int, family string, patterns array<string>, compare_only array<string>"))


def groups_of(files: DataFrame) -> DataFrame:
    """``path, witness, grp``."""
    return _each(files, lambda text: [dict(zip(("witness", "grp"), r, strict=True)) for r in _groups(_parsed(text))], _struct(GROUPS))


def remap_of(files: DataFrame) -> DataFrame:
    """``path, witness, ab_id, lookup_id``."""
    return _each(files, lambda text: [dict(zip(("witness", "ab_id", "lookup_id"), r, strict=True)) for r in _remap(_parsed(text))], _struct(REMAP))


def whitelists_of(files: DataFrame) -> DataFrame:
    """``path, token``: words of plain lists, blank lines and comments left out."""
    return _each(files, lambda text: [{"token": t} for t in _words(text)], "token: string")
