"""Snapshots, caches and decisions as JSON documents, for exchange with tools that keep them so.

Graphs here come from one project's snapshot file and are read on the driver, as one JSON
document has no parts to distribute; larger collections belong in Parquet.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ENTRY = "file string, ord int, kind string, raw string, imported_name string, alias string, line int, resolved_file string, resolution string, note string, reason string, exported_names array<string>"
FIELDS = [f.split()[0] for f in ENTRY.split(", ")]


def validate(payload: object) -> dict:
    if not isinstance(payload, dict):
        raise ValueError("Expected a JSON object.")
    if not isinstance(payload.get("graph"), dict):
        raise ValueError('Expected a JSON object with a "graph" key.')
    return payload


def _entries(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r.get(f) for f in FIELDS) for r in rows], ENTRY)


def tables(spark: SparkSession, payload: dict) -> dict[str, DataFrame]:
    """files (file, hash), imports, unresolved, function_edges of a payload; a file may be a bare list of targets."""
    graph = validate(payload)["graph"]
    files, imports = [], []
    for file, node in graph.items():
        bare = isinstance(node, list)
        files.append((file, None if bare else (node or {}).get("hash")))
        entries = [{"resolved_file": t} for t in node] if bare else (node or {}).get("imports") or []
        imports += [e | {"file": file, "ord": k} for k, e in enumerate(entries)]
    other = {name: [e | {"ord": k} for k, e in enumerate(payload.get(name) or [])] for name in ("unresolved", "function_edges")}
    return {"files": spark.createDataFrame(files, "file string, hash string"), "imports": _entries(spark, imports)} | {k: _entries(spark, v) for k, v in other.items()}


def load_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return tables(spark, json.loads(Path(path).read_text()))


def save_document(document: dict, path: str) -> None:
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(json.dumps(document, indent=2))


def document(result: dict[str, DataFrame]) -> dict:
    """The nested payload of files, imports, unresolved and function_edges; fields that are null are left out,
    but for an import's alias and a from-import's name."""

    def shown(r) -> dict:
        kept = {"import": {"alias"}, "from_import": {"alias", "imported_name"}}.get(r["kind"], set())
        return {k: v for k, v in r.asDict().items() if k not in ("ord", "section", "top_level") and (v is not None or k in kept)}

    graph = {r["file"]: {"hash": r["hash"], "imports": []} for r in result["files"].orderBy("file").collect()}
    for r in result["imports"].orderBy("file", "ord").collect():
        entry = shown(r)
        graph.setdefault(entry.pop("file"), {"hash": None, "imports": []})["imports"].append(entry)
    rest = {k: [shown(r) for r in result[k].orderBy("file", "ord").collect()] for k in ("unresolved", "function_edges")}
    return {"graph": graph} | rest


def load_cache(path: str) -> dict:
    """A missing or broken cache is an empty one."""
    try:
        return json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return {}


def load_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Decisions; a missing file has none, a broken one raises."""
    from weftline.operators.overrides import DECISION

    at = Path(path)
    held = json.loads(at.read_text()) if at.exists() else {}
    names = [f.split()[0] for f in DECISION.split(", ")][1:]
    return spark.createDataFrame([(k, *(v.get(n) for n in names)) for k, v in held.items()], DECISION)


def save_overrides(store: DataFrame, path: str) -> None:
    rows = {}
    for r in store.orderBy("key").collect():
        value = r.asDict()
        key = value.pop("key")
        rows[key] = {k: v for k, v in value.items() if v is not None or k == "imported_name" or (k == "resolved_file" and value["decision"] != "reject")}
    save_document(rows, path)


def save_lines(lines: DataFrame, path: str) -> None:
    """Lines (section, place, line) as one text, in order."""
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text("\n".join(r["line"] for r in lines.orderBy("section", "place").toLocalIterator()))
