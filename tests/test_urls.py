from pyspark.sql import functions as F

from skarv.functions.urls import domain_key, host_col, normalize_url, page_key, query_key, url_col

CASES = {
    "https://a.example": "https://a.example/",
    "HTTPS://A.Example:443/x/": "https://a.example/x",
    "http://a.example:80/#top": "http://a.example/",
    "http://a.example:8080/x#y": "http://a.example:8080/x",
    "https://a.example/x/?q=1#z": "https://a.example/x/?q=1",
    "https://a.example?q=1": "https://a.example/?q=1",
    "https://a.example//": "https://a.example/",
    " https://Me:Pw@A.example:443/P/Q/ ": "https://Me:Pw@a.example/P/Q",
    "https://a.example:": "https://a.example/",
    "no url": "no url",
    "": "",
}


def test_both_forms_agree(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "u string")
    got = {r.u: r.n for r in df.select("u", url_col(F.col("u")).alias("n")).collect()}
    assert got == CASES
    assert {k: normalize_url(k) for k in CASES} == CASES
    assert normalize_url(None) is None
    assert spark.createDataFrame([(None,)], "u string").select(url_col(F.col("u")).alias("n")).first().n is None


def test_keys(spark):
    row = spark.createDataFrame([(" A.Example ", "/x/", "/", " Two \t Words ", "https://U@B.example:8/x")], "d string, p string, q string, s string, u string")
    got = row.select(domain_key(F.col("d")), page_key(F.col("p")), page_key(F.col("q")), query_key(F.col("s")), host_col(F.col("u"))).first()
    assert tuple(got) == ("a.example", "/x", "/", "two words", "b.example")
