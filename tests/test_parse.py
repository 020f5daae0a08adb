"""Literal rows of FIXTURES.md section 3: parsing, flags, bands (traps T1-T6)."""
import pytest
from pyspark.sql import functions as F

from hearth.functions.flags import floor_bands, listing_flags
from hearth.functions.parse import ceiling_height, parse_int, price_usd

PRICES = [
    ("$120,000", 120000.0, 120000.0),
    ("֏ 48,000,000", 120000.0, 48000000.0),
    ("€90,000", 99000.0, 90000.0),
    ("$ 52,000 monthly", 52000.0, None),
    ("12 000", 12000.0, None),
    ("", None, None),
    (None, None, None),
    ("negotiable", None, None),
]


@pytest.mark.parametrize("mode,idx", [("intended", 1), ("as_written", 2)])
def test_price_modes(spark, mode, idx):
    df = spark.createDataFrame([(p[0],) for p in PRICES], "price string")
    got = [r[0] for r in df.select(price_usd("price", mode)).collect()]
    for (raw, *exp), g in zip(PRICES, got):
        want = exp[idx - 1]
        if want is None:
            assert g is None, raw
        else:
            assert g == pytest.approx(want), raw


def test_bad_numbers_never_raise_under_ansi(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") in ("true", "True")
    df = spark.createDataFrame([("5+",), ("abc",), ("4800000000",), (None,)], "r string")
    rows = df.select(parse_int("r").alias("v")).collect()
    assert [r.v for r in rows] == [None, None, None, None]


def test_ceiling_height_modes(spark):
    df = spark.createDataFrame([("2.75 m",), ("3.0 m",), ("2.6",), (None,)], "ceiling_height string")
    intended = [r[0] for r in df.select(ceiling_height("ceiling_height", "intended")).collect()]
    written = [r[0] for r in df.select(ceiling_height("ceiling_height", "as_written")).collect()]
    assert intended == [2.75, 3.0, 2.6, None]
    assert written == [275.0, 30.0, 26.0, None]


def test_flags_and_null_routing(spark):
    schema = ("new_construction string, elevator string, floors_in_building int, ceiling_height string, "
              "balcony string, renovation string, furniture string")
    rows = [("Yes", "Available", 5, "2.75 m", "Open balcony", "Euro Renovation", "Available"),
            ("No", "Not Available", 6, "3.0 m", "No balcony", "Old Renovation", "By Agreement"),
            (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    flags = listing_flags("intended")
    got = [r.asDict() for r in df.select(*[e.alias(k) for k, e in flags.items()]).collect()]
    assert got[0] == dict(new_construction_flag=1, elevator_flag=1, skyscraper=0, high_ceiling=0,
                          balcony_binary=1, renovation_flag=1, furniture_binary=1)
    assert got[1] == dict(new_construction_flag=0, elevator_flag=0, skyscraper=1, high_ceiling=1,
                          balcony_binary=0, renovation_flag=0, furniture_binary=0)
    # null goes to the else branch
    assert got[2] == dict(new_construction_flag=0, elevator_flag=0, skyscraper=1, high_ceiling=1,
                          balcony_binary=0, renovation_flag=0, furniture_binary=0)
    as_written = listing_flags("as_written")
    hc = [r[0] for r in df.select(as_written["high_ceiling"]).collect()]
    assert hc == [1, 1, 1]   # 2.75 m -> 275 -> not <= 2.75


def test_floor_bands(spark):
    df = spark.createDataFrame([(6,), (7,), (13,), (14,), (None,)], "floor int")
    bands = floor_bands("floor")
    got = [tuple(r) for r in df.select(*bands.values()).collect()]
    assert got == [(1, 0, 0), (0, 1, 0), (0, 1, 0), (0, 0, 1), (None, None, None)]
