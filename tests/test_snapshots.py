"""p1: what changed between audits."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from skarv.operators.audits import audit_changes, audit_field_changes
from skarv.operators.snapshots import SnapshotIndex, chain

DDL = "id string, target_url string, status string, request_json string, summary_json string, report_json string, completed_at timestamp_ntz, ingested_at timestamp_ntz, hash string, pages string"


def day(n):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=n)


def run(id_, n, pages, target="https://s.example/", status="completed", mode="domain", wrap=False, ingested=None, report=None):
    report = json.dumps({"pages": pages}) if report is None else report
    request = json.dumps({} if mode is None else {"mode": mode})
    # hash and pages: columns whose names clash with internal ones
    return (id_, target, status, request, None, json.dumps(report) if wrap else report, day(n), ingested or day(n), "x", "y")


def page(url, **k):
    return {"url": url, "title": "T", **k}


def changes(spark, rows):
    return {tuple(r) for r in audit_changes(spark.createDataFrame(rows, DDL)).select("run_id", "page_url", "change_kind").collect()}


def test_added_removed_changed(spark):
    u = "https://s.example"
    rows = [
        run("a", 1, [page(u), page(u + "/x/", h1="One  two"), page(u + "/y", headings=["A"])]),
        run("p", 2, [page(u)], mode="page"),
        run("f", 2, [], status="failed"),
        run("b", 3, [page(u + ":443/#top"), page(u + "/x", h1=" One two "), page(u + "/y", headings=["a"]), page(u + "/z")], wrap=True),
        run("c", 4, [page(u + "/x", h1="One two")], target="HTTPS://S.example"),
        run("cut", 5, [], report='{"pages": ['),
    ]
    assert changes(spark, rows) == {
        ("b", u + "/y", "changed"),
        ("b", u + "/z", "added"),
        ("c", u + "/", "removed"),
        ("c", u + "/y", "removed"),
        ("c", u + "/z", "removed"),
    }


def test_equal_forms_are_no_change(spark):
    u = "https://s.example/"
    a = page(u, metaDescription=None, headings=[], canonicalUrl="", bodyText="a\n b", schema={"types": ["A", "B"]}, statusCode=200)
    b = page(u, metaDescription="", bodyText=" a b ", schema={"types": ["B", "A", "A"]}, statusCode=200.0)
    assert changes(spark, [run("a", 1, [a]), run("b", 2, [b], mode=None)]) == set()
    assert changes(spark, [run("a", 1, [a]), run("b", 2, [page(u, schema={"types": "A"})])]) == {("b", u, "changed")}


def test_latest_delivery_counts_and_null_fields(spark):
    u = "https://s.example/"
    rows = [
        run("a", 1, [page(u)]),
        run("b", 2, [page(u, title="old")], ingested=day(2)),
        run("b", 2, [page(u)], ingested=day(9)),
        run("b", 2, [page(u)], ingested=day(9)),
        (None, None, None, None, None, None, None, None, None, None),
        ("n", None, "completed", None, None, "[]", None, None, None, None),
    ]
    assert changes(spark, rows) == set()
    assert changes(spark, []) == set()


def test_empty_snapshot_removes_all_and_long_text(spark):
    u = "https://s.example/"
    long = "word " * 200_000
    rows = [run("a", 1, [page(u, bodyText=long)]), run("b", 2, []), run("c", 3, [page(u, bodyText=long + "x")])]
    assert changes(spark, rows) == {("b", u, "removed"), ("c", u, "added")}


def test_fields_of_changes(spark):
    u = "https://s.example/"
    df = spark.createDataFrame([run("a", 1, [page(u, h1="x")]), run("b", 2, [page(u, h1="y", statusCode=404)])], DDL)
    got = {(r.field, r.old_value, r.new_value) for r in audit_field_changes(df).collect()}
    assert got == {("h1", "x", "y"), ("statusCode", "", "404")}


def test_random_history_against_brute_force(spark):
    rnd = random.Random(3)
    rows, truth = [], set()
    for t in range(4):
        before = None
        for n in range(rnd.randint(1, 5)):
            now = {f"https://t{t}.example/{i}": rnd.randint(0, 2) for i in range(12) if rnd.random() < 0.6}
            rid = f"{t}-{n}"
            rows.append(run(rid, 10 * t + n, [page(u, h1=str(v)) for u, v in now.items()], target=f"https://t{t}.example/"))
            if before is not None:
                truth |= {(rid, u, "added") for u in now.keys() - before.keys()} | {(rid, u, "removed") for u in before.keys() - now.keys()}
                truth |= {(rid, u, "changed") for u in now.keys() & before.keys() if now[u] != before[u]}
            before = now
    rnd.shuffle(rows)
    assert changes(spark, rows) == truth


def test_index_advances(spark, tmp_path):
    """Delivery by delivery, and several snapshots of a target at once, against brute force."""
    rnd = random.Random(4)
    held, truth, got = {}, set(), set()
    index = SnapshotIndex(spark, f"file://{tmp_path}/index", buckets=4, parts=3)
    n = 0
    for v in range(1, 4):
        rows, snaps = [], []
        for target in ("a", "b", "c"):
            for _ in range(rnd.choice([0, 1, 2]) if v > 1 else 1):
                n += 1
                now = {f"k{i}": rnd.choice("xyz") for i in range(6) if rnd.random() < 0.6} if rnd.random() < 0.8 else {}
                snaps.append((target, f"s{n:02}", day(n)))
                rows += [(f"s{n:02}", k, h) for k, h in now.items()]
                old = held.get(target)
                if old is not None:
                    truth |= {(f"s{n:02}", k, "added") for k in now.keys() - old.keys()} | {(f"s{n:02}", k, "removed") for k in old.keys() - now.keys()}
                    truth |= {(f"s{n:02}", k, "changed") for k in now.keys() & old.keys() if now[k] != old[k]}
                held[target] = now
        linked = index.link(spark.createDataFrame(snaps, "target string, snapshot string, at timestamp_ntz"))
        delivered = spark.createDataFrame(rows, "snapshot string, key string, hash string").join(linked, "snapshot")
        got |= {(r.snapshot, r.key, r.change_kind) for r in index.advance(delivered, linked).collect()}
        assert index.version() == v
        assert {(r.target, r.key, r.hash) for r in index.current().collect()} == {(t, k, h) for t, m in held.items() for k, h in m.items()}
    assert got == truth
    assert SnapshotIndex(spark, index.path, 4, 3).version() == 3  # the pointer is in the folder
    index.drop_before(3)
    assert index.current().count() == sum(map(len, held.values()))


def test_chain_in_two_steps(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice(["hot", "hot", "b", None]), rnd.choice([None, dt.datetime(2026, 1, rnd.randint(1, 4), rnd.randint(0, 23))]), f"{i:03}") for i in range(120)]
    got = {r.id: (r.prev_id, r.next_id) for r in chain(spark.createDataFrame(rows, "g string, at timestamp_ntz, id string"), "g", "at", "id").collect()}
    for g in ("hot", "b", None):
        ids = [i for _, _, i in sorted([r for r in rows if r[0] == g], key=lambda r: (r[1] is not None, r[1] or dt.datetime.min, r[2]))]
        for k, i in enumerate(ids):
            assert got[i] == (ids[k - 1] if k else None, ids[k + 1] if k + 1 < len(ids) else None)
