"""Hand-made edge rows for the extractors (FIXTURES.md)."""

from pyspark.sql import functions as F

from textflow.functions import incident as X
from textflow.functions import distance as D

SEP = "__________________________________ CREATED BY"


def one(spark, col_expr, value, schema="v string"):
    df = spark.createDataFrame([(value,)], schema)
    return df.select(col_expr.alias("x")).first()["x"]


def test_hour(spark):
    assert one(spark, X.hour_of(F.col("v")), "12:30 PM") == 24
    assert one(spark, X.hour_of(F.col("v"), fix_noon=True), "12:30 PM") == 12
    assert one(spark, X.hour_of(F.col("v")), "12:05 AM") == 12
    assert one(spark, X.hour_of(F.col("v"), fix_noon=True), "12:05 AM") == 0
    assert one(spark, X.hour_of(F.col("v")), "7:15") == 7
    assert one(spark, X.hour_of(F.col("v")), None) is None


def test_dates(spark):
    # 2020-02-01 has ordinal 737456 (Python date.toordinal)
    import datetime
    assert one(spark, X.ordinal_day(F.col("v")), " 01/02/2020 ") == datetime.date(2020, 2, 1).toordinal()
    assert one(spark, X.ordinal_day(F.col("v")), "1/2/2020") == datetime.date(2020, 2, 1).toordinal()
    assert one(spark, X.ordinal_day(F.col("v")), "bad") is None
    assert one(spark, X.ordinal_day(F.col("v")), None) is None
    assert one(spark, X.weekday_of(F.col("v")), "01/02/2020") == datetime.date(2020, 2, 1).weekday()
    assert one(spark, X.weekday_of(F.col("v")), " 01/02/2020") is None  # not trimmed


def test_entry(spark):
    assert one(spark, X.entry_point(F.col("v")), "POINT OF ENTRY-DOOR: GARAGE") == "POINT OF ENTRY-DOOR"
    assert one(spark, X.entry_point(F.col("v")), "POE - GARAGE") == "POINT OF ENTRY-DOOR: GARAGE"
    assert one(spark, X.entry_side(F.col("v")), "PREMISES-FRONT and PREMISES-REAR") == "PREMISES-REAR"
    assert one(spark, X.location_type(F.col("v")), "Residential Farm") == "1"
    assert one(spark, X.location_type(F.col("v")), "Street") == "UNKNOWN"


def _section(text):
    # the reference rule, written out for the test
    import re
    if text is None:
        return ""
    n = text.split(SEP)[-1]
    if "NARRATIVE" in n or "CIRCUMSTANCES" in n:
        n = re.split("NARRATIVE|CIRCUMSTANCES", n)[-1]
        n = re.split(r"\*|:", n[1:])[0]
    return n


def test_narrative_section(spark):
    cases = [None, "", "NO HEADING HERE", f"A {SEP} B NARRATIVE: X * Y",
             f"{SEP} NARRATIVE: one {SEP} CIRCUMSTANCES: two: three", "text NARRATIVE",
             "NARRATIVE::", f"only {SEP} line", "x CIRCUMSTANCES*y", "NARRATIVEa:b"]
    rows = spark.createDataFrame([(c,) for c in cases], "v string") \
        .select(X.narrative_section(F.col("v")).alias("x")).collect()
    assert [r["x"] for r in rows] == [_section(c) for c in cases]


def _vote(text, words):
    neg = ["NOT ", "NO ", "HAVEN'T", "DIDN'T", "DIDNT", "HAVENT"]
    c = 0
    for s in [s + "." for s in text.split(".") if any(w in s for w in words)]:
        c += -1 if any(n in s for n in neg) else 1
    return 1 if c > 0 else 0


def test_votes(spark):
    cases = ["ROOM WAS MESSY. NOT TIPPED.", "RUMMAGED. TIPPED OUT. NO MESSY", "", "CLEAN",
             "DIDNT RUMMAGE. MESSY", "HOUSE LOCKED. GATE NOT LOCKED. BOLTED"]
    rows = spark.createDataFrame([(c,) for c in cases], "v string").select(
        X.search_messy(F.col("v")).alias("m"), X.property_secured(F.col("v")).alias("s")).collect()
    assert [r["m"] for r in rows] == [_vote(c, X.MESSY_WORDS) for c in cases]
    assert [r["s"] for r in rows] == [_vote(c, X.SECURE_WORDS) for c in cases]


def test_fingerprint_equals_hashlib(spark):
    import hashlib
    texts = ["", "abc", "é naïve ünïcode", "PROPERTY STOLEN: ring_"]
    rows = spark.createDataFrame([(t,) for t in texts], "v string") \
        .select(X.fingerprint(F.col("v")).alias("h")).collect()
    assert [r["h"] for r in rows] == [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in texts]


def test_distances(spark):
    df = spark.createDataFrame([(1, 23, 6, 0, "UNKNOWN", "a")], "a int, b int, c int, d int, u string, w string")
    r = df.select(D.hour_gap("a", "b").alias("h"), D.weekday_gap("c", "d").alias("wd"),
                  D.nominal_match("u", "w").alias("n1"), D.nominal_match("w", "w").alias("n2"),
                  D.grid_distance(F.lit(0), F.lit(0), F.lit(3), F.lit(4)).alias("g")).first()
    assert (r["h"], r["wd"], r["n1"], r["n2"], r["g"]) == (2, 1, None, 1, 5)
