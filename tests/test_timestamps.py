import pytest

from larkspur.operators.timestamps import mixture, normalise_times, parses, slashed_orders

CHICAGO = "America/Chicago"


@pytest.mark.parametrize(
    ("text", "form"),
    [
        ("2019-07-28", "2019-07-28"),
        (" 2019/7/8 ", "2019-07-08"),
        ("20210901", "2021-09-01"),
        ("July 2014", "2014-07"),
        ("2014", "2014"),
        ("FEB 16 2015", "2015-02-16"),
        ("08-Feb-15", "2015-02-08"),
        ("11.6.2017", "2017-06-11"),
        ("28 de mayo de 2008", "2008-05-28"),
        ("7 août 2014", "2014-08-07"),
        ("25. März 2021", "2021-03-25"),
        ("2015年4月26日", "2015-04-26"),
        ("2008 Jul-Aug", "2008-07/2008-08"),
        ("39470", "2008-01-23"),
        ("1431653400", "2015-05-15T01:30:00Z"),
        ("1551173400999", "2019-02-26T09:30:00Z"),
        ("2012-01-29T20:45:00.475Z", "2012-01-29T20:45:00Z"),
        ("Thu, 29 Aug 2013 02:30:00 +0200", "2013-08-29T00:30:00Z"),
        ("11/05/2022 07:30 AM GMT", "2022-11-05T07:30:00Z"),
        ("02/06/2024 12:30 AM PDT", "2024-02-06T07:30:00Z"),
        ("20241224T010000Z", "2024-12-24T01:00:00Z"),
        ("2024-11-18 19:00:00-04", "2024-11-18T23:00:00Z"),
    ],
)
def test_forms(text, form):
    assert parses(text)[0][1] == form


@pytest.mark.parametrize("text", [None, "", "  ", "TBD", "N/A", "0000-00-00", "13/45/2022", "2023-02-30", "25:00", "9" * 200, "2024-01-01 " * 500, "12/20/2024 25:10"])
def test_no_case(text):
    assert parses(text) == ()


def test_wall_clock():
    first = lambda t: parses(t, CHICAGO)[0][1]
    assert first("11/03/2024 01:30:00") == "2024-11-03T06:30:00Z"  # occurs twice: the earlier
    assert first("11/03/2024 24:00:00") == "2024-11-04T06:00:00Z"
    assert first("2025-07-01 12:00") == "2025-07-01T17:00:00Z"
    assert first("2025-07-01 12:00 UTC") == "2025-07-01T12:00:00Z"


def test_mixture_prefers_the_order_that_explains_the_source():
    w = mixture([({"slash_dmy": 1.0}, 5), ({"slash_mdy": 1.0, "slash_dmy": 1.0}, 40)], {"slash_mdy": 0.05})
    assert w["slash_dmy"] > 0.95


def test_orders_of_one_source():
    even = {"slash_mdy": 1.0, "slash_dmy": 1.0}
    assert slashed_orders({"both": 40, "slash_dmy": 5}, even)[0] < 0.05
    assert slashed_orders({"both": 40, "slash_mdy": 5, "none": 3}, even)[0] > 0.95
    assert 0.1 < slashed_orders({"both": 4}, even)[0] < 0.9999  # nothing tells
    declared = {"slash_mdy": 1.0, "slash_dmy": 1e-6}
    month, day_only = slashed_orders({"both": 400, "slash_mdy": 300, "slash_dmy": 5}, declared)
    assert month > 0.999 and day_only < 0.5  # a date that breaks the declared order is noise
    assert slashed_orders({"both": 3}, declared)[0] > 0.999


def test_orders_differ_by_source(spark):
    rows = [("us", "12/18/2021"), ("us", "03/04/2021"), ("eu", "18/12/2021"), ("eu", "03/04/2021"), ("new", "03/04/2021"), ("new", "05/05/2021"), (None, None)]
    got = {(r.source, r.value): r for r in normalise_times(spark.createDataFrame(rows, "source string, value string"), "value", source="source").collect()}
    assert got["us", "03/04/2021"].normal_form == "2021-03-04"
    assert got["eu", "03/04/2021"].normal_form == "2021-04-03"
    assert got["new", "03/04/2021"].ambiguous is True or got["new", "03/04/2021"].normal_form == "2021-03-04"
    assert got["new", "05/05/2021"].normal_form == "2021-05-05"
    assert got[None, None].normal_form is None


def test_shape(spark):
    df = spark.createDataFrame([(1, "2020-01-01", "a", "x"), (1, "2020-01-01", "a", "x"), (2, "x" * 500, None, None)], "id int, value string, layout string, __sig string")
    out = normalise_times(df, "value", month_first=True)
    assert out.columns == ["id", "value", "__sig", "normal_form", "layout", "posterior", "ambiguous"]
    assert [r.normal_form for r in out.orderBy("id").collect()] == ["2020-01-01", "2020-01-01", None]
    assert normalise_times(df.limit(0), "value").count() == 0


def test_texts_of_any_length():
    assert parses(" " * 75 + "2024-05-06")[0][1] == "2024-05-06"
    assert parses("\t" * 100_000 + "6   " + " " * 500 + " May 2024 \n")[0][1] == "2024-05-06"
    assert parses("2024-05-06T10:00:00." + "3" * 5_000 + "Z")[0][1] == "2024-05-06T10:00:00Z"
    assert parses("1/" * 200_000) == ()


def test_times_that_the_clock_shows_twice_or_skips_are_marked(spark):
    rows = [("2024-11-03 01:30",), ("2024-03-10 02:30",), ("2024-11-03 03:30",), ("2024-11-03 01:30 CST",), ("03/04/2021",), ("18/12/2021",)]
    got = {r.value: r for r in normalise_times(spark.createDataFrame(rows, "value string"), "value", zone=CHICAGO, month_first=True).collect()}
    assert got["2024-11-03 01:30"].normal_form == "2024-11-03T06:30:00Z" and got["2024-11-03 01:30"].ambiguous
    assert got["2024-03-10 02:30"].normal_form == "2024-03-10T08:30:00Z" and got["2024-03-10 02:30"].ambiguous
    assert not got["2024-11-03 03:30"].ambiguous and not got["2024-11-03 01:30 CST"].ambiguous
    assert got["03/04/2021"].normal_form == "2021-03-04" and 0.99 < got["03/04/2021"].posterior < 1.0 and not got["03/04/2021"].ambiguous
    assert got["18/12/2021"].normal_form is None
