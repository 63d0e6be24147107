"""Semantic rules S-1, S-4, S-5, S-6 pinned on small literal tables."""

from datetime import date

from pyspark.sql import functions as F

from seriesforge.functions import dates as D
from seriesforge.functions import text as TX


def _phrase_hit(spark, name, q):
    df = spark.createDataFrame([(name, q)], "name string, q string")
    qt = TX.tokens(F.translate(F.col("q"), "\"'", ""))
    hit = (F.size(qt) > 0) & TX.token_text(TX.tokens(F.col("name"))).contains(TX.token_text(qt))
    return df.select(hit.alias("h")).first()["h"]


def test_s5_token_probe_table(spark):
    assert _phrase_hit(spark, "S&P PMI", "s p")
    assert _phrase_hit(spark, "S&P PMI", "S&P")
    assert not _phrase_hit(spark, "S&P PMI", "sp")
    assert not _phrase_hit(spark, "Japan, JGB, 10Y", "JG")
    assert not _phrase_hit(spark, "Japan, JGB, 10Y", "japan 10y")
    assert _phrase_hit(spark, "snake_case", "snake")
    assert _phrase_hit(spark, "Café Orders", "cafe")
    assert not _phrase_hit(spark, "Straße", "strasse")
    assert not _phrase_hit(spark, "S&P PMI", ",")
    assert not _phrase_hit(spark, "S&P PMI", "")


def test_s6_like_ascii_fold_and_wildcards(spark):
    rows = [("NATION_1, Orders", "nation_1%ord", True), ("Édition", "édition", False),
            ("abc", "A_C", True), ("a\\b", "a\\b", True), ("100%", "0%", True)]
    df = spark.createDataFrame(rows, "name string, q string, want boolean")
    got = df.select(TX.like_contains(F.col("name"), F.col("q")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_s4_text_bounds(spark):
    df = spark.createDataFrame([(date(2020, 1, 1),), (date(2019, 12, 31),), (date(2020, 6, 1),)], "date date")
    for start, end in [("2020", None), (None, "2020"), ("2020-01", "2020-06"), ("2019-12-31", "2020-01-01"),
                       ("2019-12-31x", None), ("2019-99-01", "2020-13-01"), ("", ""), ("zzz", None), (None, "2020-1")]:
        a = df.where(D.in_text_range(F.col("date"), F.lit(start), F.lit(end))).count()
        b = df.where(D.literal_range(F.col("date"), start, end)).count()
        assert a == b, (start, end)
        bounded = D.with_bounds(df.withColumn("start_date", F.lit(start).cast("string")).withColumn("end_date", F.lit(end).cast("string")))
        assert bounded.where(D.in_bounds(F.col("date"))).count() == a, (start, end)
    assert df.where(D.literal_range(F.col("date"), "2020", None)).count() == 2
    assert df.where(D.literal_range(F.col("date"), None, "2020")).count() == 1


def test_s1_nanos_before_1970(spark):
    ns = [-1, -86_400_000_000_000, 0, 86_400_000_000_000 - 1]
    df = spark.createDataFrame([(x,) for x in ns], "x long")
    got = [r["d"] for r in df.select(D.day_from_nanos(F.col("x")).alias("d")).collect()]
    assert got == [date(1969, 12, 31), date(1969, 12, 31), date(1970, 1, 1), date(1970, 1, 1)]


def test_accent_table_is_rule_built():
    src, dst = TX.accent_table()
    assert len(src) == len(dst) > 200
    assert "é" in src and dst[src.index("é")] == "e"
    assert "ß" not in src


def test_s14_hidden_calls_are_not_charged(spark):
    from seriesforge.operators import metering as MT
    rows = [("series", "X, S&P PMI", "member"), ("series", "X, S&P PMI", "api_key"), ("series", "X", "member"), ("series", None, "member"),
            ("multi_series", "X, S&P PMI", "member"), ("search", "X", "member")]
    df = spark.createDataFrame([(k, n, a, 200) for k, n, a in rows] + [("series", "X", "member", 401)], "kind string, series string, auth_type string, status int")
    for patterns in (["s&p pmi"], spark.createDataFrame([("S&P PMI",)], "pattern string")):
        got = sorted((r["kind"], str(r["series"]), r["auth_type"]) for r in MT.charged(df, patterns).collect())
        assert got == sorted((k, str(n), a) for k, n, a in rows[1:5])


def test_b1_text_dates(spark):
    from seriesforge.sources import panels as P
    texts = ["2020-01-31", "2020-01-31 12:00:00", "1/31/2020", "2020/1/31", "20200131", "31 Jan 2020", "Jan 31, 2020"]
    df = spark.createDataFrame([(t,) for t in [*texts, "no date", None]], "t string")
    got = [r["d"] for r in df.select(P.normalize_date(F.col("t"), df.schema["t"].dataType).alias("d")).collect()]
    assert got == [date(2020, 1, 31)] * len(texts) + [None, None]


def test_same_name_in_two_countries(spark):
    """S-8: the country at the lowest code is found, at the highest it is reported."""
    from seriesforge.operators import search as E
    from seriesforge.operators import series as SR
    cat = spark.createDataFrame([("x y", "m", "jp"), ("x y", "a", "cn")], "name string, frequency string, country string")
    q = spark.createDataFrame([(1, "x", None, None, 5)], "query_id int, q string, freq string, country string, lim int")
    assert [(r["country"], r["frequencies"]) for r in E.search_series(cat, q).collect()] == [("cn", ["a", "m"])]
    full = cat.selectExpr("*", "1L as count", "date'2020-01-01' as min_date", "date'2020-01-01' as max_date")
    assert {r["country"] for r in SR.series_info(cat, full).collect()} == {"jp"}
