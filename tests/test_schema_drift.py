import datetime as dt
import json

from conftest import rows

from cipherledger.operators.schema_drift import drift, path_drift, typed_table

T = dt.datetime(2024, 1, 1)
SCHEMA = "feed_name string, file_name string, entity string, exported_at timestamp_ntz, delivered_at timestamp_ntz, line_no int, payload string, kind string"


def records(spark, files, entity="MoscaRiskAssessment", feed="f"):
    data = []
    for n, (name, payloads) in enumerate(files):
        for i, p in enumerate(payloads):
            data.append((feed, name, entity, T + dt.timedelta(days=n), T, i, p if isinstance(p, str) or p is None else json.dumps(p), "clash"))
    return spark.createDataFrame(data, SCHEMA)


def found(df):
    return rows(drift(df), "file_name", "field_name", "change_kind")


def test_each_kind_of_change(spark):
    one = [{"artefact_id": "a", "binding_model": "mosca", "must_start_by": "2030-01-01", "shelf_life_x": 1.5}] * 3
    two = [{"artefact_id": "a", "bindingModel": ["mosca"], "must_start_by": None, "tags": [1]}] * 3
    assert found(records(spark, [("1", one), ("2", two)])) == [("2", "binding_model", "renamed"), ("2", "binding_model", "retyped"), ("2", "shelf_life_x", "removed"), ("2", "tags", "added")]


def test_minorities_truncated_lines_and_copies_do_not_count(spark):
    one = [{"artefact_id": "a", "band": "Low"}] * 4
    two = [{"artefact_id": "a", "band": "High"}] * 3 + [{"artefact_id": "a", "risk_category": "High", "x": 1}, '{"artefact_id": "b", "ba', None, "[1]", ""]
    df = records(spark, [("1", one), ("2", two)])
    assert found(df.union(df)) == []


def test_half_of_the_records_make_a_field(spark):
    one = [{"artefact_id": "a"}] * 4
    two = [{"artefact_id": "a", "note": "x"}] * 2 + [{"artefact_id": "a"}] * 2
    assert found(records(spark, [("1", one), ("2", two)])) == [("2", "note", "added")]


def test_notation_within_a_kind_is_no_change(spark):
    assert found(records(spark, [("1", [{"must_start_by": "2030-01-01"}]), ("2", [{"must_start_by": "1 Jan 2030"}]), ("3", [{"must_start_by": None}])])) == []


def test_empty_objects_and_empty_table(spark):
    assert found(records(spark, [("1", [{}]), ("2", [{}])])) == []
    assert found(records(spark, [])) == []
    assert typed_table(records(spark, []), "ScanPathRequest").count() == 0


def test_typed_table_reports_failed_casts(spark):
    data = [
        {"artefact_id": "a", "x_years": "1.5", "isOverdue": "yes", "bound_by": 2, "latest_start": {"year": 2030, "month": 2, "day": 3}, "finish_by": 21915},
        {"artefact_id": "b", "shelf_life_x": "many", "overdue": 0, "binding_model": {"model": "HNDL"}, "must_start_by": "03.02.2030", "must_complete_by": 20300203},
        {"artefact_id": "c", "shelf_life_x": None, "must_start_by": "soon"},
    ]
    got = typed_table(records(spark, [("1", data)]), "MoscaRiskAssessment").orderBy("line_no").collect()
    day = dt.date(2030, 2, 3)
    assert [(r.shelf_life_x, r.is_overdue, r.binding_model, r.must_start_by, r.must_complete_by, r.failed_casts) for r in got] == [
        (1.5, True, "regulatory", day, dt.date(2030, 1, 1), []),
        (None, False, "hndl", day, day, ["shelf_life_x"]),
        (None, None, None, None, None, ["must_start_by"]),
    ]


def named(field, n=40):
    return {"shelf_life_x": [0.5 + k % 30 for k in range(n)], "owner": [f"team-{k % 12}" for k in range(n)], "binding_model": [["mosca", "hndl", "regulatory"][k % 3] for k in range(n)]}[field]


def test_renames_to_names_that_no_list_holds(spark):
    a = [{"artefact_id": str(k), "shelf_life_x": x, "owner": o} for k, (x, o) in enumerate(zip(named("shelf_life_x"), named("owner")))]
    b = [{"artefact_id": str(k), "life_in_years": x, "ownerTeam": o} for k, (x, o) in enumerate(zip(named("shelf_life_x"), named("owner")))]
    df = records(spark, [("1", a), ("2", b), ("3", b), ("4", a)])
    assert found(df) == [("2", "ownerTeam", "renamed"), ("2", "shelf_life_x", "renamed"), ("4", "owner", "renamed"), ("4", "shelf_life_x", "renamed")]
    got = typed_table(df, "MoscaRiskAssessment")
    assert got.filter("shelf_life_x is null").count() == 0


def test_fields_without_anything_in_common_are_removed_and_added(spark):
    a = [{"artefact_id": str(k), "owner": o, "flag": True} for k, o in enumerate(named("owner"))]
    b = [{"artefact_id": str(k), "ticket": f"T{k * 7919}", "done": True} for k in range(40)]
    assert found(records(spark, [("1", a), ("2", b)])) == [("2", "done", "added"), ("2", "flag", "removed"), ("2", "owner", "removed"), ("2", "ticket", "added")]


def test_paths_at_any_depth(spark):
    one = [{"artefact_id": "a", "where": {"path": "p", "line": 1}, "tags": [{"k": 1}]}] * 3
    two = [{"artefact_id": "a", "where": {"path": "p", "line": "1", "row": 2}, "tags": [{"v": 1}, 2]}] * 3
    got = rows(path_drift(records(spark, [("1", one), ("2", two)])), "path", "change_kind")
    assert got == [("tags[]", "retyped"), ("tags[].k", "removed"), ("tags[].v", "added"), ("where.line", "retyped"), ("where.row", "added")]
    assert path_drift(records(spark, [])).count() == 0


def test_json_null_is_no_text(spark):
    got = typed_table(records(spark, [("1", [{"artefact_id": None, "binding_model": None, "is_overdue": None, "must_start_by": None}])]), "MoscaRiskAssessment").collect()
    assert [(r.artefact_id, r.binding_model, r.is_overdue, r.must_start_by, r.failed_casts) for r in got] == [(None, None, None, None, [])]
