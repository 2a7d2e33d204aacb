"""Schemas and vocabularies of the engine's tables. Maps and sets are rows; they are nested again only at the output's edge."""

from __future__ import annotations

# Names that users of the data model rely on.
CHANNELS = ("direct_calls", "runtime_calls", "qualified_refs", "callback_calls", "event_bindings", "api_imports", "inheritance")
KINDS = ("class", "function", "method", "global")
EDGE_TYPES = ("hard", "soft")
RESOLUTIONS = ("MODULE", "FALLBACK", "UNKNOWN")
LAYER_ORDER = ("tests", "ui", "cli", "contract", "engine", "runtime", "adapter")
FAMILIES = ("graph", "topology", "cycles", "collisions", "usage", "consumption", "matrix", "clusters")

TABLES = {
    "modules": "module_id string, path string, absolute_path string",
    "imports": "module_id string, pos int, module string, level int, names array<string>, is_from_import boolean, is_local boolean, type_only boolean",
    "skipped": "path string, reason string, line_number int, column_number int",
    "resolved": "module_id string, pos int, target string, kind string, used_symbol string",
    "edges": "src string, dst string, edge_type string",
    "symbols": "module_id string, symbol string, kind string, signature string, body_fp string, line int",
    "usage": "definer string, symbol string, consumer string, channel string",
    "usage_facts": "module_id string, channel string, value string, extra string",
    "collision_facts": "module_id string, name string, type string, code string, file_path string, line_start int, line_end int, col_start int, col_end int",
    "violations": "kind string, message string, nodes array<string>, artifact_type string, is_identical boolean",
    "ids": "kind string, slot int, generation int, obj_id string, name string, status string, removed_at timestamp",
    "file_state": "path string, mtime_ns long, size long, sha256 string",
    "journal": "revision long, operation string, origin string, status string, file_path string, error string, affected array<string>",
}
