import datetime as dt

from pyspark.sql import functions as F

from resgov.functions.times import epoch_millis_ntz, midnight_as_written, parse_instant, trunc_seconds


def test_midnight_as_written(spark):
    rows = [("2024-03-10T23:30:00-05:00",), ("2024-03-10",), ("2024-03-10 12:00:00",), ("Mar 1 2024",),
            ("garbage",), (None,), ("2024-03-10T01:00:00+09:00",)]
    df = spark.createDataFrame(rows, "s string").select("s", midnight_as_written(F.col("s")).alias("m"))
    got = {r.s: r.m for r in df.collect()}
    assert got["2024-03-10T23:30:00-05:00"] == dt.datetime(2024, 3, 10)   # not moved to the UTC date
    assert got["2024-03-10T01:00:00+09:00"] == dt.datetime(2024, 3, 10)
    assert got["2024-03-10"] == dt.datetime(2024, 3, 10)
    assert got["2024-03-10 12:00:00"] == dt.datetime(2024, 3, 10)
    assert got["Mar 1 2024"] is None and got["garbage"] is None and got[None] is None
    assert dict(df.dtypes)["m"] == "timestamp_ntz"


def test_instants_are_utc(spark):
    df = spark.createDataFrame([("2024-03-10T23:30:00-05:00", 1700000000000, 0)], "s string, ms long, z long")
    r = df.select(parse_instant(F.col("s")).alias("p"), epoch_millis_ntz(F.col("ms")).alias("e"),
                  epoch_millis_ntz(F.col("z")).alias("zero"),
                  trunc_seconds(F.lit("2024-01-01 10:00:00.999").cast("timestamp_ntz")).alias("t")).first()
    assert r.p == dt.datetime(2024, 3, 11, 4, 30)
    assert r.e == dt.datetime(2023, 11, 14, 22, 13, 20)
    assert r.zero is None                      # 0 is falsy: no timestamp
    assert r.t == dt.datetime(2024, 1, 1, 10, 0)


def test_bad_dates_are_null_not_failures(spark):
    rows = [(t,) for t in ("2024-3-1", "2024", "2024-03", "10:00", "T10:00:00", "2024-02-30", "2024-03-01x", "20240301", "")]
    got = spark.createDataFrame(rows, "s string").select(midnight_as_written(F.col("s")).alias("m"), parse_instant(F.col("s")).alias("p")).collect()
    assert all(r.m is None for r in got)


def test_utc_in_any_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2024-03-10T23:30:00Z", "2024-11-03 01:30:00", 1730613600123)], "z string, n string, ms long")
        r = df.select(parse_instant(F.col("z")).cast("string").alias("z"), parse_instant(F.col("n")).cast("string").alias("n"),
                      epoch_millis_ntz(F.col("ms")).cast("string").alias("e"), epoch_millis_ntz(F.lit(10**17)).alias("far")).first()
        assert (r.z, r.n, r.e, r.far) == ("2024-03-10 23:30:00", "2024-11-03 01:30:00", "2024-11-03 06:00:00.123", None)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_elapsed_seconds_knows_no_clock_change(spark):
    """Wall times in UTC: a night in which the session zone's clocks change is as long as any."""
    from resgov.functions.times import elapsed_seconds
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("""SELECT timestamp_ntz'2024-03-10 01:00:00' AS a, timestamp_ntz'2024-03-10 04:00:00.000001' AS b
                          UNION ALL SELECT timestamp_ntz'2024-11-03 04:00:00', timestamp_ntz'2024-11-03 00:30:00' UNION ALL SELECT NULL, timestamp_ntz'2024-11-03 00:30:00'""")
        assert [r[0] for r in df.select(elapsed_seconds(F.col("a"), F.col("b"))).collect()] == [10_800.000001, -12_600.0, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
