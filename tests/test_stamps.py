"""Version names are in UTC whatever the zone of the session."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from snapdelta.functions import display_date, hash_of_columns, version_stamp
from snapdelta.functions.stamps import stamp_of, timestamp_literal

MOMENTS = [dt.datetime(2024, 3, 2, 6, 30, 5, 999999), dt.datetime(2024, 11, 3, 5, 30), dt.datetime(2024, 11, 3, 6, 30), dt.datetime(1969, 12, 31, 23, 59, 58, 7), dt.datetime(1970, 1, 1)]


@pytest.fixture
def in_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    yield lambda zone: spark.conf.set("spark.sql.session.timeZone", zone)
    spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kathmandu"])
@pytest.mark.parametrize("moment", MOMENTS)
def test_stamps(spark, in_zone, zone, moment):
    in_zone(zone)
    row = spark.range(1).select(version_stamp(timestamp_literal(moment)).alias("v"), display_date(timestamp_literal(moment)).alias("d")).first()
    assert row.v == stamp_of(moment)
    assert row.d == moment.strftime("%Y-%m-%d %H:%M:%S")


def test_values_of_nested_types_have_hashes_of_their_own(spark):
    values = [
        "array('a, b')", "array('a', 'b')", "array('null')", "array(cast(null as string))", "array()", "cast(null as array<string>)",
        "array('a;', 'b')", "array('a', ';b')", "array('1:a;')", "array('1:', 'a;')", "array('')", "array('', '')",
    ]
    df = spark.sql(" UNION ALL ".join(f"SELECT cast({v} as array<string>) AS x" for v in values))
    hashes = [r.h for r in df.select(hash_of_columns(df, ["x"]).alias("h")).collect()]
    assert len(set(hashes)) == len(values) and hashes.count(None) == 1
    maps = ["map('a', 1, 'b', 2)", "map('a', 12)", "map('a', null)", "map()"]
    df = spark.sql(" UNION ALL ".join(f"SELECT cast({v} as map<string,int>) AS m, named_struct('p', '1', 'q', binary('x')) AS s" for v in maps))
    assert df.select(hash_of_columns(df, ["m", "s"]).alias("h")).distinct().count() == len(maps)
    one = spark.sql("SELECT map('a', 1, 'b', 2) AS m")
    two = spark.sql("SELECT map('b', 2, 'a', 1) AS m")
    assert one.select(hash_of_columns(one, ["m"])).first() == two.select(hash_of_columns(two, ["m"])).first()


def test_moments_hash_alike_in_every_zone(spark, in_zone):
    found = set()
    for zone in ("UTC", "America/New_York"):
        in_zone(zone)
        df = spark.range(2).select(F.timestamp_seconds(F.lit(1730611800) + F.col("id") * 3600).alias("t"))
        found |= {r.h for r in df.select(hash_of_columns(df, ["t"]).alias("h")).collect()}
    assert len(found) == 2
