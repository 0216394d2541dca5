import pytest

from larkspur.operators.units import convert_units, load_in_megawatts, read_unit, unit_distance


def test_scale_marks_never_meet():
    assert unit_distance("Mcf", "MMcf") == 1.0
    assert unit_distance("MBBL", "MMBBL") == 1.0
    assert unit_distance("thousand barrels", "million barrels") == 1.0
    assert unit_distance("$/gal", "¢/gal") == 1.0
    assert unit_distance("cubic metres", "cubic meters") < 0.34
    assert unit_distance("megawatthours", "megawatt hours") < 0.1


def test_convert(spark):
    rows = [
        (1, "PET.STK", "gal", None, 42000.0), (2, "PET.STK", "MMbbl", None, 2.0), (3, "PET.STK", "Mbbl", None, 7.0), (4, "PET.STK", None, "Units: U.S. gallons. Revised quarterly.", 84000.0),
        (5, "PET.STK", "see name", "Stocks (Thousand Barrels (MBBL))", 5.0), (6, "NG.PRC", "$/therm", None, 1.0), (7, "ELEC.GEN", "GJ", None, 36.0), (8, "NG.PROD", "(MCF)", None, 1000.0),
        (9, "PET.STK", None, None, 1.0), (10, "PET.STK", "furlongs", None, 1.0), (11, "PET.STK", "gal", None, None), (12, None, "gal", "x" * 50_000, 1.0), (13, "ELEC.GEN", "megawat hours", None, 3.0),
    ]
    df = spark.createDataFrame(rows, "id int, grp string, units string, description string, value double").selectExpr("*", "'a' as spelling", "9 as factor")
    got = {r.id: r.common_value for r in convert_units(df, "grp", "units", "value", ["description"]).collect()}
    want = {1: 1.0, 2: 2000.0, 3: 7.0, 4: 2.0, 5: 5.0, 6: 1000.0, 7: 10.0, 8: 1.0, 9: None, 10: None, 11: None, 12: None, 13: 3.0}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == (None if v is None else pytest.approx(v)), k
    out = convert_units(df, "grp", "units", "value", ["description"])
    assert "spelling" in out.columns and out.columns.count("factor") == 1
    assert convert_units(df.limit(0), "grp", "units", "value", ["description"]).count() == 0


def test_loads(spark):
    rows = [(1, "A", 0, 100.0, 98.0), (2, "A", 900, 0.1, 99.0), (3, "A", 1800, 25.0, 101.0), (4, "A", 2700, 100_000.0, None), (5, "A", 3600, None, 100.0), (6, "A", 3600, -5.0, 100.0), (7, "B", 0, 5.0, None), (8, None, None, 5.0, None), (8, None, None, 5.0, None)]
    df = spark.createDataFrame(rows, "id int, area string, t long, load double, fc double")
    got = {r.id: r.common_value for r in load_in_megawatts(df, "area", "t", "load", "fc").collect()}
    assert got == {1: 100.0, 2: 100.0, 3: 100.0, 4: 100.0, 5: None, 6: None, 7: None, 8: None}
    assert load_in_megawatts(df, "area", "t", "load", "fc").count() == 9


@pytest.mark.parametrize(
    ("typed", "known"),
    [("thousnd barrels", "thousand barrels"), ("Milion Cubic Feet", "million cubic feet"), ("bilion cubic feet", "billion cubic feet"), ("megwatthours", "megawatthours"), ("dollers per barel", "dollars per barrel"), ("cents per millionn Btu", "cents per million Btu"), ("thosuand galons", "thousand gallons")],
)
def test_misspelt_words_keep_their_scale(typed, known):
    assert unit_distance(typed, known) < 0.1


def test_a_word_between_two_scales_matches_neither(spark):
    assert unit_distance("nillion cubic feet", "million cubic feet") == unit_distance("nillion cubic feet", "billion cubic feet") == 1.0
    rows = [(1, "NG.PROD", "milion cubic feet", 3.0), (2, "NG.PROD", "nillion cubic feet", 3.0), (3, "PET.STK", "thousnd barels", 5.0), (4, "PET.STK", "thousend galons", 42.0)]
    df = spark.createDataFrame(rows, "id int, grp string, units string, value double")
    got = {r.id: r.common_value for r in convert_units(df, "grp", "units", "value", []).collect()}
    assert got == {1: 3.0, 2: None, 3: 5.0, 4: pytest.approx(1.0)}


@pytest.mark.parametrize(
    ("group", "unit", "factor"),
    [
        ("PET.STK", "Thousand Barrels (MBBL)", 1.0), ("PET.STK", "10^6 bbl", 1e3), ("PET.STK", "1000 m³", 1 / 0.158987294928), ("PET.STK", "million US gallons", 1e3 / 42), ("PET.STK", "billion barrels", 1e6),
        ("PET.PRC", "USD per gallon", 4200.0), ("PET.PRC", "US cents/bbl", 1.0), ("PET.PRC", "$/m3", 15.8987294928), ("PET.PRC", "dollars per thousand gallons", 4.2),
        ("NG.PROD", "MMcf", 1.0), ("NG.PROD", "Mcf", 1e-3), ("NG.PROD", "bcm", 1e3 / 0.028316846592), ("NG.PROD", "cu ft", 1e-6), ("NG.PROD", "thousand cubic metres", 1e-3 / 0.028316846592),
        ("NG.PRC", "$/MMBTU", 100.0), ("NG.PRC", "c/thm", 10.0), ("NG.PRC", "dollars per million Btu", 100.0), ("NG.PRC", "cents per therms", 10.0),
        ("ELEC.GEN", "GWh", 1e3), ("ELEC.GEN", "million kilowatthours", 1e3), ("ELEC.GEN", "MJ", 1e-3 / 3.6), ("ELEC.GEN", "thousand megawatt hours", 1e3), ("ELEC.GEN", "petajoules", 1e6 / 3.6),
        ("PET.STK", "$/bbl", None), ("PET.PRC", "barrels", None), ("ELEC.GEN", "bbl", None), ("NG.PROD", "gcf", None),
    ],
)
def test_any_scale_with_any_base(spark, group, unit, factor):
    df = spark.createDataFrame([(1, group, unit, 1.0)], "id int, grp string, units string, value double")
    got = convert_units(df, "grp", "units", "value", []).first().common_value
    assert got is None if factor is None else got == pytest.approx(factor)
