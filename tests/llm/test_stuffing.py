"""p10: stuffed pages."""

from skarv.llm.stuffing import chunks, stuffed_pages

DDL = "doc_id bigint, text string, url string, source string, k string, p string"


def found(spark, rows):
    df = spark.createDataFrame([(i, t, f"https://h{i}.example/x", "s", "clash", "clash") for i, t in rows], DDL)
    return {r.doc_id for r in stuffed_pages(df).collect()}


def places(n, what):
    return "\n".join(f"{what} Place{i}" for i in range(n))


PROSE = "We look after gardens and roofs all year, and the people in the town know us well. You will hear from us within two days. " * 3


def test_spam_is_found_and_prose_is_not(spark):
    spam = {
        1: places(30, "boat hire"),
        2: ", ".join(["window washing", "price window washing", "best window washing", "window washing near me"] * 8),
        3: "\n".join(f'<a href="https://x{i}.example/a">stage magic Place{i}</a>' for i in range(15)),
        4: " ".join(f"#cakeorders{i} #venuehire #catering" for i in range(12)),
        5: "With catering you get catering, and catering in Place is the best catering. " * 6,
        6: "\n".join(f"Read more on {w} Place{i}" for i in range(10) for w in ("boat hire", "snow clearing")),
        7: "Tags: " + "; ".join(f"{w} cheap" for w in ("boat hire", "snow clearing", "cake orders", "stage magic")) + "\n" + places(20, "cake orders"),
    }
    fine = {
        20: PROSE,
        21: "\n".join(f"- Add {i} internal links about boat hire." for i in range(5)) + "\n" + PROSE,
        22: "\n".join(f"Term {i}: it means that the work on roof {i} is done by the firm in the spring." for i in range(12)),
        23: PROSE + "\n" + places(6, "boat hire"),
        24: "Opening hours\nMonday to Friday 9-16\nSaturday closed\n" + PROSE,
        25: "The boat hire is open. Boat hire in the town costs little. We have had boat hire since the war, and the boat hire is by the quay. " * 3,
    }
    got = found(spark, [*spam.items(), *fine.items(), (30, places(30, "boat hire")), (31, places(25, "snow clearing")), (32, places(25, "cake orders"))])
    assert got & set(fine) == set()
    assert got >= set(spam)


def test_nulls_empty_repeated_long_and_empty_table(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "boat"), (5, places(40_000, "boat hire")), (5, places(40_000, "boat hire")), (None, places(20, "boat hire"))]
    df = spark.createDataFrame([(i, t, None, None, "", "") for i, t in rows], DDL)
    assert sorted([r.doc_id for r in stuffed_pages(df).collect()], key=lambda x: x or 0) == [None, 5]
    assert stuffed_pages(df.limit(0)).count() == 0


def test_chunks_keep_dates_and_list_numbers_together():
    assert [len(c.words) for c in chunks("On May 5. we met. Then\n1. call us")] == [5, 1, 3]
