import datetime as dt
import json

from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cipherledger.operators.scan_documents import scan_children

T = dt.datetime(2024, 1, 1)
SCHEMA = "scan_id string, received_at timestamp_ntz, document string, value string"
COLUMNS = ("scan_id", "artefact_id", "child", "parent_pos", "pos", "value")


def children(spark, docs):
    data = [(s, t, d if isinstance(d, str) or d is None else json.dumps(d), "clash") for s, t, d in docs]
    return rows(scan_children(spark.createDataFrame(data, SCHEMA)), *COLUMNS)


def plain(scan, doc):
    """Brute force over one document."""
    many = lambda v: v if isinstance(v, list) else [] if v is None else [v]
    out = []
    for a in many(doc.get("artefacts")):
        for i, o in enumerate(many(a.get("occurrences"))):
            at = o.get("location") if isinstance(o, dict) else o
            at = at.get("path") if isinstance(at, dict) else at
            out += [(scan, a["id"], "occurrence", 0, i, at)] if at is not None else []
        for i, k in enumerate(many(a.get("known_vulnerabilities"))):
            out += [(scan, a["id"], "alias", i, j, x) for j, x in enumerate(many((k or {}).get("aliases"))) if x is not None]
    return out


def test_shapes_positions_and_wrapper(spark):
    doc = {
        "artefacts": [
            {"id": "a", "occurrences": [{"location": "p"}, {"location": None}, {"location": {"path": "q", "module": "m"}}], "known_vulnerabilities": {"aliases": "X"}},
            {"id": "b", "occurrences": {"location": "r"}, "known_vulnerabilities": [{"aliases": None}, {"aliases": ["Y", None, "Z"]}]},
            {"id": "c", "occurrences": None},
        ],
        "risk_assessments": {"gone": {"model_verdicts": json.dumps([{"model": "mosca"}, {"model": "hndl"}])}, "b": {"artefact_id": "other", "model_verdicts": {"model": "regulatory"}}, "n": {"model_verdicts": None}},
    }
    want = [
        ("s", "a", "alias", 0, 0, "X"), ("s", "a", "occurrence", 0, 0, "p"), ("s", "a", "occurrence", 0, 2, "q"), ("s", "b", "alias", 1, 0, "Y"), ("s", "b", "alias", 1, 2, "Z"),
        ("s", "b", "occurrence", 0, 0, "r"), ("s", "b", "verdict", 0, 0, "regulatory"), ("s", "gone", "verdict", 0, 0, "mosca"), ("s", "gone", "verdict", 0, 1, "hndl"),
    ]
    assert children(spark, [("s", T, doc)]) == want
    assert children(spark, [("s", T, {"schema_version": 3, "result": doc})]) == want


def test_last_readable_document_counts(spark):
    good = {"artefacts": [{"id": "a", "occurrences": ["old"]}]}
    late = {"artefacts": [{"id": "a", "occurrences": ["new"]}], "risk_assessments": [{"artefact_id": "z", "model_verdicts": [{"model": "mosca"}]}]}
    day = dt.timedelta(days=1)
    docs = [("s", T, good), ("s", T + day, late), ("s", T + day, late), ("s", T + 2 * day, json.dumps(late)[:-5]), ("s", T + 3 * day, None), ("s", T + 3 * day, "[]"), ("u", T, "nonsense"), (None, T, good), ("n", None, good)]
    assert children(spark, docs) == [("n", "a", "occurrence", 0, 0, "old"), ("s", "a", "occurrence", 0, 0, "new"), ("s", "z", "verdict", 0, 0, "mosca")]


def test_empty(spark):
    assert children(spark, []) == []
    assert children(spark, [("s", T, {})]) == []


LOCATION = st.one_of(st.none(), st.sampled_from(["p", "q"]), st.fixed_dictionaries({"path": st.sampled_from(["x", "y"])}))
OCCURRENCES = st.one_of(st.none(), st.lists(st.fixed_dictionaries({"location": LOCATION}), max_size=4), st.fixed_dictionaries({"location": LOCATION}))
ALIASES = st.one_of(st.none(), st.sampled_from(["A", "B"]), st.lists(st.one_of(st.none(), st.sampled_from(["A", "B"])), max_size=3))
ADVISORIES = st.one_of(st.none(), st.lists(st.fixed_dictionaries({"aliases": ALIASES}), max_size=3))
ARTEFACTS = st.lists(st.fixed_dictionaries({"occurrences": OCCURRENCES, "known_vulnerabilities": ADVISORIES}), max_size=4)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(ARTEFACTS, min_size=1, max_size=12))
def test_round_trip_of_any_nesting(spark, docs):
    named = [{"artefacts": [{**a, "id": f"a{i}"} for i, a in enumerate(d)]} for d in docs]
    want = sorted((r for i, d in enumerate(named) for r in plain(f"s{i}", d)), key=repr)
    assert children(spark, [(f"s{i}", T, d) for i, d in enumerate(named)]) == want
