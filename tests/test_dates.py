"""Hand-written text -> date rows; none is derived from the patterns."""

import datetime

import pytest

from curata.functions import dates

D = datetime.date
CASES = [
    ("2019", D(2019, 1, 1)), ("2021.0", D(2021, 1, 1)), ("2011.0", D(2011, 1, 1)), ("2019.0", D(2019, 1, 1)),
    ("10000-01-01", D(2000, 1, 1)), ("0", D(2000, 1, 1)), ("1850", D(1850, 1, 1)), ("2024", D(2024, 1, 1)), (" 2018 ", D(2018, 1, 1)),
    ("2020-05-04T10:00:00Z", D(2020, 5, 4)), ("2018-03-05 00:00:00", D(2018, 3, 5)), ("2020/05/04", D(2020, 5, 4)),
    ("2020-5-4", D(2020, 5, 4)), ("2020-05", D(2020, 5, 1)), ("2020/11", D(2020, 11, 1)),
    ("June 2015", D(2015, 6, 1)), ("Sept. 2016", D(2016, 9, 1)), ("september 2016", D(2016, 9, 1)), ("Jul-2014", D(2014, 7, 1)),
    ("MAY 2013", D(2013, 5, 1)), ("Dec.2012", D(2012, 12, 1)), ("Feb/2012", D(2012, 2, 1)),
    ("Mar-Apr 2017", D(2017, 3, 1)), ("Mar.-Apr. 2017", D(2017, 3, 1)), ("July/August 2010", D(2010, 7, 1)),
    ("Mar. 5, 2018", D(2018, 3, 5)), ("March 15, 2018", D(2018, 3, 15)), ("June 3rd, 2019", D(2019, 6, 3)), ("May 12-14, 2016", D(2016, 5, 14)),
    ("1 June 2020", D(2020, 6, 1)), ("15 Nov. 2019", D(2019, 11, 15)), ("12 July 2019", D(2019, 7, 12)), ("1 Jan. 2021", D(2021, 1, 1)),
    ("07-Aug-2011", D(2011, 8, 7)), ("1st October 2014", D(2014, 10, 1)), ("01/Mar/2015", D(2015, 3, 1)),
    ("5 June7, 2011", D(2011, 6, 5)), ("3-5 Aug. 2013", D(2013, 8, 5)), ("3-5 August 2013", D(2013, 8, 5)),
    ("30 Sep-2 Oct. 2012", D(2012, 10, 2)), ("30 Sept. - 2 October 2012", D(2012, 10, 2)), ("5 Mar-Apr. 2012", D(2012, 4, 1)),
    ("Firstquarter 2011", D(2011, 3, 1)), ("Secondquarter 2011", D(2011, 6, 1)), ("Thirdquarter 2011", D(2011, 9, 1)),
    ("Fourthquarter 2011", D(2011, 12, 1)), ("01/thirdquarter/2011", D(2011, 9, 1)), ("First Quarter 2012", D(2012, 3, 1)),
    ("[[issued]]2010", D(2010, 1, 1)), ("Issued on: 2009-02-03", D(2009, 2, 3)), ("[2008]", D(2008, 1, 1)),
    ("n/a", None), (None, None), ("", None), ("31 Feb. 2019", None), ("2019-13-01", None), ("Smarch 2019", None), ("20 19", None),
    ("in 2019", None), ("12345", None),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    return {r.i: r.p for r in dates.parse_dates(df, "t", "p").collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_shape(parsed, i):
    assert parsed[i] == CASES[i][1], CASES[i][0]


def test_years_outside_a_range_only_on_request(spark):
    df = spark.createDataFrame([("2024",), ("1850",), ("2011",), ("June 2024",)], "t string")
    assert [r.p for r in dates.parse_dates(df, "t", "p").collect()] == [D(2024, 1, 1), D(1850, 1, 1), D(2011, 1, 1), D(2024, 6, 1)]
    assert [r.p for r in dates.parse_dates(df, "t", "p", years=(1900, 2022)).collect()] == [D(2000, 1, 1), D(2000, 1, 1), D(2011, 1, 1), D(2024, 6, 1)]
