import pytest

from sparkarch.plans import dsl

BASE = {"schema_version": "1.1", "language_version": "1.1", "root": "artifacts", "filters": [], "select": []}


def code(**change):
    with pytest.raises(dsl.RequestError) as e:
        dsl.validate({**BASE, **change})
    return e.value.code


def test_first_error_in_order():
    assert dsl.answer(None, [])["error"]["code"] == "invalid_request"
    assert code(extra=1, root="nothing") == "invalid_request"
    with pytest.raises(dsl.RequestError) as e:
        dsl.validate({k: v for k, v in BASE.items() if k != "select"})
    assert e.value.code == "missing_required_field" and e.value.path == "select"
    assert code(schema_version="9") == "unsupported_schema_version"
    assert code(language_version="1.0") == "unsupported_version_pair"
    assert code(root="nothing", limit=0) == "unknown_root"
    assert code(filters="x") == "invalid_request"
    assert code(filters=[{}] * 11, limit=0) == "too_many_filters"
    assert code(select=["kind"] * 21) == "too_many_select_fields"
    assert code(filters=[{"field": "kind", "operator": "eq", "value": "x" * 17000}]) == "request_too_complex"
    assert code(limit=True) == "invalid_limit"
    assert code(evidence_limit=-1) == "invalid_evidence_limit"
    assert code(select=["kind", "kind"]) == "duplicate_select_field"
    assert code(select=["nothing"]) == "unknown_field"
    assert code(select=["consumers_truncated"]) == "field_not_selectable"


@pytest.mark.parametrize(
    ("field", "operator", "value", "expected"),
    [
        ("nothing", "eq", 1, "unknown_field"), ("consumers_truncated", "eq", True, "field_not_filterable"), ("kind", "is_null", None, "is_null_on_non_nullable"), ("kind", "contains", "c", "invalid_operator_for_type"),
        ("consumer_count", "eq", True, "operator_value_mismatch"), ("kind", "eq", "module", "operator_value_mismatch"), ("artifact_name", "contains", "", "operator_value_mismatch"), ("kind", "in", [], "operator_value_mismatch"),
        ("kind", "in", ["class", "class"], "invalid_filter"), ("artifact_name", "in", [str(i) for i in range(51)], "invalid_filter"), ("consumers", "count_gt", -1, "operator_value_mismatch"),
    ],
)
def test_conditions_that_are_refused(field, operator, value, expected):
    item = {"field": field, "operator": operator} | ({} if operator == "is_null" else {"value": value})
    assert code(filters=[item]) == expected


def test_operators_without_value():
    assert code(filters=[{"field": "signature", "operator": "is_null", "value": True}]) == "operator_value_mismatch"
    assert code(filters=[{"field": "signature", "operator": "eq"}]) == "operator_value_mismatch"


@pytest.fixture(scope="module")
def records(spark):
    symbols = spark.createDataFrame([("m", "a", "class", "()"), ("m", "b", "function", ""), ("m", "b", "class", ""), ("n", "c", "global", None), ("o", "d", "method", "(x)")], "module_id string, symbol string, kind string, signature string")
    usage = spark.createDataFrame([("m", "a", x, "direct_calls") for x in "zyxwv"] + [("o", "d", "m", "api_imports")], "definer string, symbol string, consumer string, channel string")
    covered = spark.createDataFrame([("m",), ("n",)], "definer string")
    return dsl.artifact_records(symbols, usage, covered)


def ask(records, *filters, **more):
    return dsl.answer(records, {**BASE, "filters": [dict(zip(("field", "operator", "value"), f)) for f in filters], **more})


def names(answer):
    return [r["artifact_name"] for r in answer["results"]]


def test_null_matches_only_is_null(records):
    assert names(ask(records, ("consumer_count", "is_null"))) == ["d"]
    assert names(ask(records, ("consumer_count", "neq", 7))) == ["a", "b", "c"]
    assert names(ask(records, ("consumer_count", "eq", 0))) == ["b", "c"]
    assert names(ask(records, ("consumers", "is_empty"))) == ["b", "c"]
    assert names(ask(records, ("consumers", "count_gte", 1))) == ["a"]
    assert names(ask(records, ("signature", "is_null"))) == ["b", "c"]
    assert names(ask(records, ("kind", "eq", "ambiguous"))) == ["b"]


@pytest.mark.parametrize(("limit", "shown", "cut"), [({}, ["v", "w", "x"], True), ({"evidence_limit": None}, list("vwxyz"), False), ({"evidence_limit": 0}, [], True), ({"evidence_limit": 5}, list("vwxyz"), False)])
def test_evidence(records, limit, shown, cut):
    answer = ask(records, ("artifact_name", "eq", "a"), **limit)
    assert answer["results"][0]["consumers"] == shown and answer["results"][0]["consumers_truncated"] is cut
    assert ("expand" in answer) == cut


def test_order_limit_and_truncation(records):
    answer = ask(records, limit=2, select=["full_name"])
    assert answer["results"] == [{"full_name": "m::a"}, {"full_name": "m::b"}]
    assert (answer["total_matches"], answer["returned"], answer["truncated"]) == (4, 2, True)


def test_hard_and_soft_are_two_records_and_stale_modules_block(spark):
    edges = spark.createDataFrame([("a", "b", "hard"), ("a", "b", "soft")], "src string, dst string, edge_type string")
    r = dsl.dependency_records(edges)
    request = {**BASE, "schema_version": "1.0", "language_version": "1.0", "root": "dependencies"}
    assert dsl.answer(r, request)["total_matches"] == 2
    stale = spark.createDataFrame([("b",)], "module_id string")
    assert dsl.answer(r, request, stale)["affected_modules"] == ["b"]
    assert dsl.answer(r, {**request, "filters": [{"field": "target", "operator": "neq", "value": "b"}]}, stale)["status"] == "ok"


def test_imports_are_evidence_too(spark):
    modules = spark.createDataFrame([("m", "m.py"), ("n", "n.py")], "module_id string, path string")
    imports = spark.createDataFrame([("m", i, f"x{i}", 0, [], False, False, False) for i in range(4)], "module_id string, pos int, module string, level int, names array<string>, is_from_import boolean, is_local boolean, type_only boolean")
    answer = dsl.answer(dsl.module_records(modules, imports), {**BASE, "root": "modules"})
    assert [(r["import_count"], len(r["imports"]), r["imports_truncated"]) for r in answer["results"]] == [(4, 3, True), (0, 0, False)]
