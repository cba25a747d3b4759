"""Address/date parsing, organisation dimension rules, yearly series."""

from pyspark.sql import functions as F

from lexiflow.functions import mail as M
from lexiflow.operators import actors as A


def test_dates_and_wall_clock_year(spark):
    df = spark.createDataFrame([("Fri, 31 Dec 2021 23:30:00 -0500",), ("Mon, 01 Feb 2021 23:30:00 -0500",),
                                ("not a date",), (None,)], "d string")
    rows = df.select(M.parse_mail_date(F.col("d")).alias("ts"), M.mail_year(F.col("d")).alias("y")).collect()
    assert str(rows[0]["ts"]) == "2022-01-01 04:30:00" and rows[0]["y"] == 2021
    assert rows[1]["y"] == 2021
    assert rows[2]["ts"] is None and rows[2]["y"] is None
    assert rows[3]["ts"] is None


def test_addresses(spark):
    df = spark.createDataFrame([('"Jane Doe" <Jane.Doe@Example.COM>',), ("bob@x.org",), ("nobody",)], "a string")
    rows = df.select(M.address_name(F.col("a")).alias("n"), M.address_domain(F.col("a")).alias("d"),
                     M.address_email(F.col("a")).alias("e")).collect()
    assert (rows[0]["n"], rows[0]["d"], rows[0]["e"]) == ("Jane Doe", "example.com", "Jane.Doe@example.com")
    assert rows[1]["d"] == "x.org" and rows[1]["n"] is None
    assert rows[2]["d"] is None and rows[2]["e"] is None


def test_parent_nationality_rules(spark):
    org = spark.createDataFrame([
        ("child1", "DE", "p1"),      # parent found once -> FI
        ("child2", "DE", "p2"),      # parent found twice -> unchanged
        ("child3", "DE", "nope"),    # parent missing -> unchanged
        ("child4", "DE", "p3"),      # parent with NULL nationality -> NULL copied
        ("p1", "FI", None), ("p2", "US", None), ("p2", "CN", None), ("p3", None, None),
    ], "name string, nationality string, subsidiary_of string")
    got = {r["name"]: r["nationality"] for r in A.parent_nationality(org).collect() if r["name"].startswith("child")}
    assert got == {"child1": "FI", "child2": "DE", "child3": "DE", "child4": None}


def test_expand_and_trim(spark):
    df = spark.createDataFrame([(1, "a.com, b.com"), (2, " x "), (3, None)], "row_no int, d string")
    got = sorted((r["row_no"], r["d"]) for r in A.expand_multi_entries(A.trim_all(df), "d").collect())
    assert got == [(1, "a.com"), (1, "b.com"), (2, "x"), (3, None)]


def test_yearly_zero_fill_and_share(spark):
    m = spark.createDataFrame([("A", 2000, True), ("A", 2002, False), ("B", 2002, True), ("B", None, False)],
                              "grp_col string, sent_year int, is_target boolean")
    y = {(r["grp"], r["year"]): r["n"] for r in A.yearly_counts(m, "grp_col", (2000, 2002)).collect()}
    assert y == {("A", 2000): 1, ("A", 2001): 0, ("A", 2002): 1, ("B", 2000): 0, ("B", 2001): 0, ("B", 2002): 1}
    t = A.yearly_counts(m.where("is_target"), None, (2000, 2002))
    s = A.yearly_counts(m, None, (2000, 2002))
    share = {r["year"]: r["share"] for r in A.target_share(t, s).collect()}
    assert share == {2000: 0.0, 2001: None, 2002: -0.5}


def test_first_match_and_enrich(spark):
    dim = spark.createDataFrame([(2, 0, "a.com", "second"), (1, 1, "a.com", " first "), (3, 0, "b.com", "b")],
                                "row_no int, domain_pos int, domain string, category string")
    fm = A.first_match(dim, "category")
    msgs = spark.createDataFrame([("m1", "a.com"), ("m2", "c.com")], "msg_id string, sender_domain string")
    got = {r["msg_id"]: r["cat"] for r in A.enrich(msgs, fm, "category", "cat").collect()}
    assert got == {"m1": "first", "m2": "Unknown"}


def test_series_of_nothing_and_of_a_null_group(spark):
    none = spark.createDataFrame([], "g string, sent_year int")
    assert A.yearly_counts(none, "g").count() == 0 and A.year_range(none) is None
    rows = spark.createDataFrame([("a", 2000), (None, 2000), (None, 2001), ("b", 2001)], "g string, sent_year int")
    yearly = A.yearly_counts(rows, "g")
    assert yearly.count() == 6 and A.stacked_bands(yearly).count() == 6
    ranks = {r["grp"]: r["rank"] for r in A.rank_by_last_year(yearly).collect()}
    assert ranks == {"a": 1, None: 2, "b": 3}
