"""p7: nested records into relations."""

import datetime as dt
import json

from skarv.operators.reports import report_elements, report_tables
from skarv.operators.shred import Plan, name_of, relation, relations, schema_graph, segment, segments, shred, tables

DDL = "id string, report_json string, summary_json string, ingested_at timestamp_ntz, e string, x string"
T = dt.datetime(2026, 1, 1)


def elements(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], DDL)
    return {(r.run_id, r.rel, r.elem_path) for r in report_elements(df).collect()}


def test_paths_and_positions(spark):
    report = {
        "issues": [{"id": 1, "affectedUrls": ["a", None, "b"]}, None, {"id": 2, "affectedUrls": "c"}, 7],
        "pages": {"url": "u", "schema": {"rawItems": {"@type": "X"}}},
        "topicClusters": None,
        "competitiveContext": {"competitors": [{"clusters": []}, {"clusters": [{"n": 1}]}], "gaps": "g"},
        "implementationPacks": [{"predictedImpact": {"categories": [1, 2]}}],
    }
    got = elements(spark, [("r", json.dumps(report), json.dumps(json.dumps({"categoryScores": [{"id": "a"}, {"id": "b"}]})), T)])
    assert got == {
        ("r", "issues", "0"), ("r", "issues", "2"), ("r", "issues", "3"), ("r", "issues.affectedUrls", "0/0"), ("r", "issues.affectedUrls", "0/2"), ("r", "issues.affectedUrls", "2/0"),
        ("r", "pages", "0"), ("r", "pages.schema.rawItems", "0/0"), ("r", "competitiveContext.competitors", "0"), ("r", "competitiveContext.competitors", "1"),
        ("r", "competitiveContext.competitors.clusters", "1/0"), ("r", "competitiveContext.gaps", "0"), ("r", "implementationPacks", "0"),
        ("r", "implementationPacks.predictedImpact.categories", "0/0"), ("r", "implementationPacks.predictedImpact.categories", "0/1"),
        ("r", "summary.categoryScores", "0"), ("r", "summary.categoryScores", "1"),
    }


def test_deliveries_nulls_and_broken_json(spark):
    old, new = json.dumps({"issues": [1, 2]}), json.dumps({"issues": [1]})
    later = T + dt.timedelta(days=1)
    rows = [("a", old, None, T), ("a", new, None, later), ("a", new, None, later), ("b", '{"issues": [', None, T), ("c", None, None, None), ("n", "NaN", "null", T), (None, new, None, T)]
    assert elements(spark, rows) == {("a", "issues", "0")}
    assert elements(spark, []) == set()
    big = json.dumps({"issues": [{"affectedUrls": ["u" * 10] * 2000}] * 20})
    assert len(elements(spark, [("big", big, None, T)])) == 20 + 40_000


def test_tables_keep_parents_and_inlined_columns(spark):
    report = {"issues": [{"id": "x", "deep": {"n": 3}, "affectedUrls": ["u"]}]}
    rows = report_elements(spark.createDataFrame([("r", json.dumps(report), None, T, "", "")], DDL), with_values=True)
    issue = relation(rows, "run_id", "issues", {"id": "string", "deep.n": "int"}).first()
    assert (issue.elem_path, issue.parent_path, issue.id, issue["deep.n"]) == ("0", "", "x", 3)
    url = rows.filter("rel = 'issues.affectedUrls'").first()
    assert (url.parent_rel, url.parent_path, json.loads(url.value)) == ("issues", "0", {"value": "u"})


def graph_of(spark, *texts):
    df = spark.createDataFrame([(str(i), t, None, T, "", "") for i, t in enumerate(texts)], DDL)
    rows = schema_graph(df, "report_json").collect()
    return df, {r.path: r.repeated for r in rows}


def rows_of(spark, *texts):
    """(table, relation, path, parent relation, parent path) to flat value, by an inferred plan."""
    df, graph = graph_of(spark, *texts)
    plan = Plan.infer({"report_json": (list(graph), [p for p, many in graph.items() if many])}, {"report_json": ""}, {"report_json": "doc"})
    return {(r.table_name, r.rel, r.elem_path, r.parent_rel, r.parent_path): json.loads(r.value) for r in shred(df, "id", plan, with_values=True).collect()}


def test_schema_graph_gives_a_plan(spark):
    df, graph = graph_of(spark, '{"a": {"b": [{"c": [1]}]}, "d": 1}')
    assert graph == {"a": False, "a.b": True, "a.b.c": True, "d": False}
    plan = Plan.infer({"report_json": (list(graph), ["a.b", "a.b.c"])}, {"report_json": ""})
    assert {(r.rel, r.elem_path) for r in shred(df, "id", plan).collect()} == {("a.b", "0"), ("a.b.c", "0/0")}


def test_names_never_collide(spark):
    got = rows_of(spark, '{"a": {"b": 1}, "a_b": 2, "a.b": 3, "": 4, "[]": 5, "a\\\\": {"b": 6}}')
    assert got == {("doc", "doc", "", "", ""): {"a.b": 1, "a_b": 2, "a\\.b": 3, "\\e": 4, "\\[]": 5, "a\\\\.b": 6}}
    for name in ("", ".", "\\", "[]", "a.b\\c", "\\e", "e", "\\[]", "x."):
        assert name_of(segment(name)) == name and segments(segment(name) + ".z") == [segment(name), "z"]
    many = rows_of(spark, '{"a": {"b": [1]}, "a.b": [2, 3]}')
    assert {k[1:3]: v for k, v in many.items() if k[0] != "doc"} == {("a.b", "0"): {"value": 1}, ("a\\.b", "0"): {"value": 2}, ("a\\.b", "1"): {"value": 3}}


def test_recursive_elements_are_one_table(spark):
    got = rows_of(spark, '{"node": {"n": 1, "node": {"n": 2, "node": {"n": 3}}}, "list": [{"x": 1, "list": [{"x": 2}, {"x": 3, "list": []}]}]}')
    assert {k[0] for k in got} == {"doc", "node", "list"}
    assert {k[2:]: v["n"] for k, v in got.items() if k[0] == "node"} == {("0", "doc", ""): 1, ("0/0", "node", "0"): 2, ("0/0/0", "node.node", "0/0"): 3}
    assert {k[2:]: v["x"] for k, v in got.items() if k[0] == "list"} == {("0", "doc", ""): 1, ("0/0", "list", "0"): 2, ("0/1", "list", "0"): 3}


def test_shared_elements_are_one_table(spark):
    got = rows_of(spark, '{"a": {"score": [{"id": 1, "w": 2}]}, "b": [{"score": [{"id": 3}]}], "c": {"score": [7]}, "d": {"score": [{"other": 1}]}}')
    assert {k[0] for k in got} == {"doc", "b", "a.score", "c.score", "d.score"}
    assert {k[1:]: v for k, v in got.items() if k[0] == "a.score"} == {("a.score", "0", "doc", ""): {"id": 1, "w": 2}, ("b.score", "0/0", "b", "0"): {"id": 3}}
    assert relations(["x", "x.y"], ["x.y"]) == ["x.y"] and tables([], []) == {}


def test_lists_in_lists(spark):
    got = rows_of(spark, '{"m": [[1, 2], [], 3, [[4]]]}')
    assert {k[1:]: v for k, v in got.items() if k[0] != "doc"} == {
        ("m", "0", "doc", ""): {}, ("m.[]", "0/0", "m", "0"): {"value": 1}, ("m.[]", "0/1", "m", "0"): {"value": 2}, ("m", "1", "doc", ""): {}, ("m", "2", "doc", ""): {"value": 3},
        ("m", "3", "doc", ""): {}, ("m.[]", "3/0", "m", "3"): {}, ("m.[].[]", "3/0/0", "m.[]", "3/0"): {"value": 4},
    }


def test_tables_hold_all_of_a_report(spark):
    report = {"totalScore": 7, "comparison": {"before": 5, "categoryDeltas": [{"id": "a", "delta": 2}]}, "issues": [{"id": 1}]}
    rows = report_tables(spark.createDataFrame([("r", json.dumps(report), '{"mode": "page", "categoryScores": []}', T, "", "")], DDL))
    got = {(r.rel, r.elem_path, r.parent_rel, r.parent_path): json.loads(r.value) for r in rows.collect()}
    assert got == {
        ("report", "", "", ""): {"totalScore": 7, "comparison.before": 5}, ("comparison.categoryDeltas", "0", "report", ""): {"id": "a", "delta": 2},
        ("issues", "0", "report", ""): {"id": 1}, ("summary", "", "", ""): {"mode": "page"},
    }
