"""A closed query language over canonical records: JSON in, a DataFrame plan out.

Conditions are triples of field, operator and value, all of which must hold; there are no expressions. A request is checked
before anything is planned and the first defect in a fixed order is reported. Then filters and columns become Spark columns, so
that they reach the scan.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits and the contract of roots, fields and operators.
MAX_FILTERS, MAX_SELECT, MAX_IN, MAX_BYTES, MAX_LIMIT, DEFAULT_LIMIT, DEFAULT_EVIDENCE = 10, 20, 50, 16 * 1024, 200, 20, 3
VERSIONS = (("1.0", "1.0"), ("1.1", "1.1"))
STRING_OPS = ("eq", "neq", "contains", "starts_with", "ends_with", "in")
INT_OPS = ("eq", "neq", "gt", "gte", "lt", "lte", "in")
COUNT_OPS = ("count_eq", "count_gt", "count_gte", "count_lt", "count_lte")


@dataclass(frozen=True)
class Field:
    type: str
    ops: tuple[str, ...]
    nullable: bool = False
    values: tuple[str, ...] = ()


CONTRACT: dict[str, dict[str, Field]] = {
    "modules": {
        "module_name": Field("string", STRING_OPS), "module_id": Field("string", STRING_OPS), "path": Field("string", STRING_OPS),
        "import_count": Field("int", INT_OPS), "imports": Field("array", (*COUNT_OPS, "is_empty")),
    },
    "artifacts": {
        "artifact_name": Field("string", STRING_OPS), "full_name": Field("string", STRING_OPS), "module_name": Field("string", STRING_OPS),
        "kind": Field("enum", ("eq", "neq", "in"), values=("class", "function", "method", "global", "ambiguous")),
        "signature": Field("string", ("eq", "neq", "contains", "starts_with", "ends_with", "is_null"), True),
        "consumer_data_available": Field("bool", ("eq", "neq")),
        "consumer_count": Field("int", ("eq", "neq", "gt", "gte", "lt", "lte", "is_null"), True),
        "consumers": Field("array", (*COUNT_OPS, "is_empty", "is_null"), True),
    },
    "dependencies": {"source": Field("string", STRING_OPS), "target": Field("string", STRING_OPS), "edge_type": Field("enum", ("eq", "neq", "in"), values=("hard", "soft"))},
}
SORT_KEYS = {"modules": ("module_name",), "artifacts": ("module_name", "artifact_name"), "dependencies": ("source", "target", "edge_type")}
#: Outputs of version 1.1 that stand beside evidence; they can be neither selected nor filtered by.
COMPANIONS = {"modules": ("imports_truncated",), "artifacts": ("consumers_truncated",), "dependencies": ()}
EVIDENCE = {"modules": ("imports",), "artifacts": ("consumers",), "dependencies": ()}


class RequestError(ValueError):
    """The first defect of a request: its code and the path of the place."""

    def __init__(self, code: str, path: str = "$request", **details: Any) -> None:
        super().__init__(f"{code} at {path}")
        self.code, self.path, self.details = code, path, details


def _need(holds: bool, code: str, path: str = "$request", **details: Any) -> None:
    if not holds:
        raise RequestError(code, path, **details)


def _is_int(x: Any) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


_FITS = {"string": lambda x: isinstance(x, str), "enum": lambda x: isinstance(x, str), "int": _is_int, "bool": lambda x: isinstance(x, bool), "array": lambda x: False}
NO_VALUE = ("is_empty", "is_null")


def _check_condition(item: Any, fields: dict[str, Field], path: str) -> tuple[str, str, Any]:
    """One condition: its shape, its field, then the operator for the field and the value for both."""
    _need(isinstance(item, dict) and {"field", "operator"} <= item.keys() <= {"field", "operator", "value"}, "invalid_filter", path)
    name, op = item["field"], item["operator"]
    _need(isinstance(name, str) and name in fields, "unknown_field", f"{path}.field")
    field = fields[name]
    _need(bool(field.ops), "field_not_filterable", f"{path}.field")
    _need(op != "is_null" or field.nullable, "is_null_on_non_nullable", f"{path}.operator")
    _need(isinstance(op, str) and op in field.ops, "invalid_operator_for_type", f"{path}.operator", allowed_operators=field.ops)
    at, mismatch = f"{path}.value", "operator_value_mismatch"
    _need(("value" in item) != (op in NO_VALUE), mismatch, at)
    value = item.get("value")
    if op == "in":
        _need(isinstance(value, list) and len(value) > 0, mismatch, at)
        _need(len(value) <= MAX_IN, "invalid_filter", at, max_items=MAX_IN)
        _need(len({json.dumps(v, sort_keys=True) for v in value}) == len(value), "invalid_filter", at)
    if op not in NO_VALUE:
        if op in COUNT_OPS:
            fits = _is_int(value) and value >= 0
        elif op in ("contains", "starts_with", "ends_with"):
            fits = isinstance(value, str) and value != ""
        else:
            each = value if op == "in" else [value]
            fits = all(_FITS[field.type](v) and (not field.values or v in field.values) for v in each)
        _need(fits, mismatch, at, expected_type=field.type)
    return name, op, value


def validate(request: Any) -> dict[str, Any]:
    """The request with its defaults; the first defect raises :class:`RequestError`.

    Order: object, keys, versions, root, lists and their lengths, size, limits, select, then each condition.
    """
    _need(isinstance(request, dict), "invalid_request")
    pair = request.get("schema_version"), request.get("language_version")
    required = ("schema_version", "language_version", "root", "filters", "select")
    newer = pair == ("1.1", "1.1")
    surplus = sorted(str(k) for k in request.keys() - {*required, "limit", *(["evidence_limit"] if newer else [])})
    _need(not surplus, "invalid_request", surplus[0] if surplus else "", unknown_fields=surplus)
    for key in required:
        _need(key in request, "missing_required_field", key)
    for i, key in enumerate(("schema_version", "language_version")):
        _need(pair[i] in [v[i] for v in VERSIONS], f"unsupported_{key}", key)
    _need(pair in VERSIONS, "unsupported_version_pair")
    root = request["root"]
    _need(isinstance(root, str) and root in CONTRACT, "unknown_root", "root", allowed_roots=sorted(CONTRACT))
    lists = (("filters", MAX_FILTERS, "too_many_filters"), ("select", MAX_SELECT, "too_many_select_fields"))
    for key, _, _ in lists:
        _need(isinstance(request[key], list), "invalid_request", key)
    for key, most, code in lists:
        _need(len(request[key]) <= most, code, key, max_items=most)
    try:
        size = len(json.dumps(request, ensure_ascii=False).encode())
    except (TypeError, ValueError):
        raise RequestError("invalid_request") from None
    _need(size <= MAX_BYTES, "request_too_complex", max_bytes=MAX_BYTES, actual_bytes=size)
    limit = request.get("limit", DEFAULT_LIMIT)
    _need(_is_int(limit) and 1 <= limit <= MAX_LIMIT, "invalid_limit", "limit", max_limit=MAX_LIMIT)
    evidence = request.get("evidence_limit", DEFAULT_EVIDENCE) if newer else None
    _need(evidence is None or _is_int(evidence) and evidence >= 0, "invalid_evidence_limit", "evidence_limit")
    fields, select = CONTRACT[root], request["select"]
    for i, name in enumerate(select):
        _need(isinstance(name, str), "unknown_field", f"select[{i}]")
        _need(name not in select[:i], "duplicate_select_field", f"select[{i}]")
    for i, name in enumerate(select):
        _need(name in fields or newer and name in COMPANIONS[root], "unknown_field", f"select[{i}]")
        _need(name in fields, "field_not_selectable", f"select[{i}]")
    filterable = fields | {n: Field("bool", ()) for n in COMPANIONS[root]} if newer else fields
    checked = [_check_condition(item, filterable, f"filters[{i}]") for i, item in enumerate(request["filters"])]
    return {"schema_version": pair[0], "language_version": pair[1], "root": root, "filters": checked, "select": select or list(fields), "limit": limit, "evidence_limit": evidence}


def condition(name: str, op: str, value: Any) -> Column:
    """A triple as a column; null fits nothing but ``is_null``."""
    c = F.col(name)
    size = F.size(c)
    by_op = {
        "eq": lambda: c == value, "neq": lambda: c != value, "contains": lambda: c.contains(value), "starts_with": lambda: c.startswith(value), "ends_with": lambda: c.endswith(value),
        "in": lambda: c.isin(value), "gt": lambda: c > value, "gte": lambda: c >= value, "lt": lambda: c < value, "lte": lambda: c <= value,
        "count_eq": lambda: size == value, "count_gt": lambda: size > value, "count_gte": lambda: size >= value, "count_lt": lambda: size < value, "count_lte": lambda: size <= value,
        "is_empty": lambda: size == 0, "is_null": c.isNull,
    }
    found = by_op[op]()
    return found & c.isNotNull() if op in (*COUNT_OPS, "is_empty") else found


def matched(records: DataFrame, request: dict[str, Any]) -> DataFrame:
    """Records that a validated request's filters let through."""
    return records.filter(reduce(lambda a, b: a & b, [condition(*f) for f in request["filters"]])) if request["filters"] else records


def project(records: DataFrame, request: dict[str, Any]) -> DataFrame:
    """The selected fields, evidence cut to its limit with a ``*_truncated`` companion in version 1.1."""
    out = []
    for name in request["select"]:
        if name in EVIDENCE[request["root"]] and request["language_version"] == "1.1":
            n = request["evidence_limit"]
            out += [F.col(name) if n is None else F.slice(name, 1, n).alias(name), (F.lit(False) & F.col(name).isNull() if n is None else F.when(F.col(name).isNotNull(), F.size(name) > n)).alias(f"{name}_truncated")]
        else:
            out.append(F.col(name))
    return records.select(*out)


def run(records: DataFrame, request: Any) -> DataFrame:
    """The first ``limit`` matching records in the root's order."""
    asked = validate(request)
    found = matched(records, asked).orderBy(*SORT_KEYS[asked["root"]]).limit(asked["limit"])
    return project(found, asked)


def answer(records: DataFrame, request: Any, stale: DataFrame | None = None) -> dict[str, Any]:
    """The whole response; ``stale`` if a match touches a module (``module_id``) whose last parse failed.

    One pass finds the matches' number and the first of them; both are bounded by the request's limit.
    """
    try:
        asked = validate(request)
    except RequestError as e:
        return {"status": "error", "error": {"code": e.code, "path": e.path, "details": e.details}}
    root = asked["root"]
    found = matched(records, asked)
    if stale is not None:
        keys = ("source", "target") if root == "dependencies" else ("module_name",)
        touched = [found.join(stale.select(F.col("module_id").alias(k)), k, "left_semi").select(F.col(k).alias("module_id")) for k in keys]
        names = [r["module_id"] for r in reduce(DataFrame.unionByName, touched).distinct().orderBy("module_id").limit(MAX_LIMIT).collect()]
        if names:
            return {"status": "stale", "available": False, "root": root, "provenance": "last_known_good", "affected_modules": names}
    total = found.count()
    first = found.orderBy(*SORT_KEYS[root]).limit(asked["limit"])
    rows = [r.asDict(True) for r in project(first, asked).collect()]
    out = {"status": "ok", "schema_version": asked["schema_version"], "language_version": asked["language_version"], "root": root, "total_matches": total, "returned": len(rows), "limit": asked["limit"], "truncated": len(rows) < total}
    if any(r.get(c) for r in rows for c in COMPANIONS[root]):
        out["expand"] = {"available": True, "retry_with_full_evidence": {**request, "evidence_limit": None}}
    return {**out, "results": rows}


def module_records(modules: DataFrame, imports: DataFrame) -> DataFrame:
    """Root ``modules``: a record per module with its imports in their order."""
    per = imports.groupBy("module_id").agg(F.array_sort(F.collect_list(F.struct("pos", "module", "level", "names", "is_from_import", "is_local", "type_only"))).alias("imports"))
    empty = F.expr("cast(array() as array<struct<pos: int, module: string, level: int, names: array<string>, is_from_import: boolean, is_local: boolean, type_only: boolean>>)")
    out = modules.join(per, "module_id", "left").withColumn("imports", F.coalesce("imports", empty))
    return out.select(F.col("module_id").alias("module_name"), "module_id", "path", F.size("imports").alias("import_count"), "imports")


def artifact_records(symbols: DataFrame, usage: DataFrame | None, covered: DataFrame | None = None) -> DataFrame:
    """Root ``artifacts``. Without consumer data for an artifact its count and consumers are null, not 0.

    ``covered(definer)``: modules whose usage has been analysed; all if None and ``usage`` is given.
    """
    per = symbols.groupBy(F.col("module_id").alias("definer"), "symbol").agg(F.collect_set("kind").alias("kinds"), F.max(F.when(F.col("signature") != "", F.col("signature"))).alias("signature"))
    kind = F.when(F.size("kinds") == 1, F.col("kinds")[0]).otherwise("ambiguous")
    out = per.select("definer", "symbol", kind.alias("kind"), "signature")
    if usage is None:
        out = out.withColumn("available", F.lit(False)).withColumn("c", F.lit(None).cast("array<string>"))
    else:
        used = usage.groupBy("definer", "symbol").agg(F.array_sort(F.collect_set("consumer")).alias("c"))
        out = out.join(used, ["definer", "symbol"], "left")
        out = out.withColumn("available", F.lit(True)) if covered is None else out.join(covered.select("definer").distinct().withColumn("available", F.lit(True)), "definer", "left").withColumn("available", F.coalesce("available", F.lit(False)))
    consumers = F.when(F.col("available"), F.coalesce("c", F.array().cast("array<string>")))
    return out.select(
        F.col("symbol").alias("artifact_name"), F.concat_ws("::", "definer", "symbol").alias("full_name"), F.col("definer").alias("module_name"), "kind", "signature",
        F.col("available").alias("consumer_data_available"), F.when(F.col("available"), F.size(consumers).cast("long")).alias("consumer_count"), consumers.alias("consumers"),
    )


def dependency_records(edges: DataFrame) -> DataFrame:
    """Root ``dependencies``: a pair with a hard and a soft edge has two records."""
    return edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "edge_type").distinct()


def describe(schema_version: str = "1.1", language_version: str = "1.1") -> dict[str, Any]:
    """The contract: roots, fields, operators, nullability and limits."""
    if (schema_version, language_version) not in VERSIONS:
        raise RequestError("unsupported_version")
    roots = {r: {"sort": SORT_KEYS[r], "fields": {n: {"type": f.type, "operators": f.ops, "nullable": f.nullable, "values": f.values} for n, f in fields.items()}} for r, fields in CONTRACT.items()}
    return {"schema_version": schema_version, "language_version": language_version, "filters": "all must hold", "limits": {"filters": MAX_FILTERS, "select": MAX_SELECT, "in": MAX_IN, "bytes": MAX_BYTES, "limit": MAX_LIMIT, "default_limit": DEFAULT_LIMIT}, "roots": roots}
