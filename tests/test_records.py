"""Records, listings, keywords and brands."""

from pyspark.sql import functions as F

from skarv.functions import keywords as K
from skarv.operators import records as R


def test_jobs(spark):
    jobs = spark.createDataFrame([(1, "a", "x", "completed", 5), (2, "a", "x", "completed", 7), (3, "a", "y", "failed", 9), (4, None, "x", "completed", 1), (5, "b", "x", "completed", None)], "id int, domain string, type string, status string, completed_at int")
    assert {tuple(r) for r in R.latest_jobs(jobs).collect()} == {("a", "x", 7), (None, "x", 1)}
    assert {r.id for r in R.jobs_to_start(jobs.filter("id < 4"), jobs.filter("id = 2")).collect()} == {1, 3}
    assert R.jobs_of(jobs, ["m", "n"]).count() == 10 and R.jobs_of(jobs.limit(0), ["m"]).count() == 0
    got = R.updated_if(jobs, F.col("completed_at") > 6, {"status": F.lit("done")})
    assert {r.id for r in got.filter("status = 'done'").collect()} == {2, 3}
    assert {r.id for r in R.without_ids(jobs, [1, 2]).collect()} == {3, 4, 5}


def test_records(spark):
    ddl = "id int, domain string, v string"
    old = spark.createDataFrame([(1, "a", "old")], ddl)
    new = spark.createDataFrame([(7, "b", "new"), (5, "b", "older")], ddl)
    assert [r.v for r in R.replaced(old, new).collect()] == ["new"] and [r.v for r in R.replaced(old, new.limit(0)).collect()] == ["old"]
    assert R.singleton(new).first().id == 7 and [r.id for r in R.in_order(new.union(old)).collect()][0] == 1
    assert R.unique_first(new, ["domain"], ["id"]).first().v == "older"
    assert {(r.k, r.v) for r in R.looked_up(spark.createDataFrame([("b", 1), ("c", 2)], "domain string, k int"), new).collect()} == {(1, "older"), (2, None)}
    answers, cache = R.read_through(spark.createDataFrame([(1,), (2,), (9,), (2,)], "id int"), old, spark.createDataFrame([(1, "z", "not used"), (2, "b", "fetched"), (3, "b", "not asked")], ddl), ["id"])
    assert {r.v for r in answers.collect()} == {"old", "fetched"} and cache.count() == 2
    accounts = spark.createDataFrame([("acc", [("properties/12", "Shop"), ("13", None)]), ("none", None)], "account string, properties array<struct<property: string, displayName: string>>")
    assert [tuple(r) for r in R.properties(accounts).collect()] == [("acc", "12", "Shop"), ("acc", "13", None)]


def test_series_and_listings(spark):
    rows = spark.createDataFrame([("t", 1, 5.0, None), ("t", 2, None, 3.0)], "k string, at int, a double, b double")
    assert {tuple(r) for r in R.series(rows, ["k"], "at", ["a", "b"]).collect()} == {("t", 1, "a", 5.0), ("t", 2, "b", 3.0)}
    items = spark.createDataFrame([("d", "low", 9, "open"), ("d", "critical", 1, "open"), ("d", "high", 1, "done"), ("e", "high", 2, "open")], "domain string, priority string, created_at int, status string")
    assert [r.priority for r in R.listed(items, status="open", domain=None).collect()] == ["critical", "high", "low"] and R.listed(items, 1).count() == 1
    headers, kept = R.snapshot_of(items.drop("status"), [F.desc("created_at"), F.col("priority")], 2)
    assert {tuple(r) for r in headers.collect()} == {("d", 2), ("e", 1)} and {r.status for r in kept.collect()} == {"open"}


def test_keywords_and_brands(spark):
    assert K.keyword_of("/tjenester/boat-hire", "Acme", "Boat hire in town | Acme") == "Boat hire in town"
    assert K.keyword_of("/boat_hire.html", "", "") == "Boat hire" and K.keyword_of("/kontakt/123", "Acme – Roof repair", "x") == "Roof repair"
    assert K.keyword_of("/", "Roof repair | Acme and some more words that go on and on", None) == "Roof repair"
    assert K.keyword_of(None, None, None, "a.example/x") == "a.example/x" and K.keyword_of("/" + "x" * 80, None, "T") == "T"
    assert K.visible_keyword("snomaking", ["Other", "Snømåking i byen"]) == "snomaking"
    assert K.visible_keyword("Boat hire", [None, "boat HIRE | Acme"]) == "boat HIRE"
    assert K.brand_tokens("Acme Boats", "www.acme.example") == ["acme", "boats", "example"]
    assert K.supporting_word("boat hire", ["Boat", "price"], ["x"]) == "price" and K.supporting_word("boat", [], ["boat"]) is None
    assert K.brand_of(None, "", "Acme – boats", ["Person"], "b.example") == "Acme" and K.brand_of(None, None, "Acme – boats", None, "www.boats.example") == "Boats"
    df = spark.createDataFrame([("/boat-hire", None, None, None, None, None, "a.example")], "path string, h1 string, title string, p string, a string, t array<string>, host string".replace("t array", "types array"))
    assert tuple(df.select(K.keywords("path", "h1", "title"), K.brands("p", "a", "h1", "types", "host")).first()) == ("Boat hire", "A")
