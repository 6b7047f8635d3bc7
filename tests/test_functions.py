"""Scalar functions against literal events and plain Python."""

import json
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from regfeed import feeds
from regfeed.functions import cards, identity, text, timeutil


def number(spark, feed, uri, rid=None, data=None):
    df = spark.createDataFrame([(feed, uri, rid, data)], "f string, u string, r string, d string")
    return df.select(identity.company_number(F.col("f"), F.col("u"), F.col("r"), F.col("d")).alias("n")).first().n


# Published sample events and their company numbers.
@pytest.mark.parametrize(
    "feed,uri,rid,data,wanted",
    [
        ("filings", "/company/10620794/filing-history/MzM5ODkyOTYzNmFkaXF6a2N4", "MzM5ODkyOTYzNmFkaXF6a2N4", None, "10620794"),
        ("companies", "/company/05954546", "05954546", "05954546", "05954546"),
        ("company-exemptions", "company/14438833/exemptions", "14438833", None, "14438833"),
        ("company-exemptions", "/company/14438833/exemptions", "14438833", None, "14438833"),
        ("officers", "/company/SC123456/appointments/x", "x", None, "SC123456"),
        ("officers", "/company/sc123456/appointments/x", "x", None, None),
        ("charges", "/company/123456/charges/x", "x", None, None),
        ("persons-with-significant-control", "/company/123456/persons-with-significant-control/individual/x", "x", None, "123456"),
        ("persons-with-significant-control-statements", "/company/12345678/persons-with-significant-control-statements/x", "x", None, "12345678"),
        ("insolvency-cases", "/company/12345678/insolvency", "12345678", None, "12345678"),
        ("disqualified-officers", "/disqualified-officers/natural/x", "x", None, ""),
    ],
)
def test_company_number(spark, feed, uri, rid, data, wanted):
    assert number(spark, feed, uri, rid, data) == wanted


def python_normalise(value):
    """The timestamp rule in plain Python."""
    if re.fullmatch(r"\d{4}-\d\d-\d\d", value):
        value += "T00:00:00"
    value = re.sub(r"^(\d{4}-\d\d-\d\d) (\d\d:)", r"\1T\2", value)
    if not re.search(r"Z$|\+\d\d:\d\d$", value):
        value += "Z"
    match = re.fullmatch(r"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(\.\d{1,9})?(Z|\+(\d\d):(\d\d))", value)
    if not match:
        return None
    try:
        base = datetime.strptime(match[1], "%Y-%m-%dT%H:%M:%S").replace(tzinfo=timezone.utc)
    except ValueError:
        return None
    millis = int(((match[2] or ".0")[1:] + "000")[:3])
    base += timedelta(milliseconds=millis) - timedelta(hours=int(match[4] or 0), minutes=int(match[5] or 0))
    return base.strftime("%Y-%m-%dT%H:%M:%S.") + f"{base.microsecond // 1000:03d}Z"


STAMPS = [
    "2024-01-01 00:00:00",
    "2025-09-13T14:55:03",
    "2023-11-03T22:13:03.742120Z",
    "2023-11-03T22:13:03.7Z",
    "2023-11-03T00:13:03.999999+01:00",
    "2023-11-03T00:13:03.1+05:30",
    "2023-11-03T22:13:03-05:00",
    "junk",
    "",
    "T10:00:00",
    "2023-02-30T00:00:00",
    "2023-11-03",
]


def test_normalise_timestamp(spark):
    df = spark.createDataFrame([(s,) for s in STAMPS], "s string")
    got = {r.s: r.t for r in df.select("s", timeutil.iso_millis(timeutil.normalise_timestamp(F.col("s"))).alias("t")).collect()}
    assert got == {s: python_normalise(s) for s in STAMPS}


def test_negative_zone_on_request(spark):
    df = spark.createDataFrame([("2023-11-03T22:13:03-05:00",)], "s string")
    shown = timeutil.iso_millis(timeutil.normalise_timestamp(F.col("s"), negative_zones=True))
    assert df.select(shown.alias("t")).first().t == "2023-11-04T03:13:03.000Z"


def test_delay_is_never_negative(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 00:01:30' p, timestamp_ntz'2024-01-01 00:00:00' r")
    assert df.select(timeutil.delay_minutes(F.col("p"), F.col("r"))).first()[0] == 0.0
    assert df.select(timeutil.delay_minutes(F.col("r"), F.col("p"))).first()[0] == 1.5


@pytest.mark.parametrize(
    "template,values,wanted",
    [
        ("{a} and {b}", {"a": "1"}, "1 and "),
        ("{a}{a}", {"a": "{b}", "b": "x"}, "{b}{b}"),
        ("plain", {}, "plain"),
        ("", {}, ""),
        ("{ a } {", {"a": "1"}, "{ a } {"),
        ("x{made_up_date}y", {"made_up_date": "$1\\2"}, "x$1\\2y"),
    ],
)
def test_fill_template(spark, template, values, wanted):
    df = spark.createDataFrame([(template, values)], "t string, m map<string,string>")
    assert df.select(text.fill_template(F.col("t"), F.col("m"))).first()[0] == wanted


def test_letter_case(spark):
    df = spark.createDataFrame([("persons-with-significant-control", "O'NEILL & SONS (UK) LTD")], "a string, b string")
    row = df.select(text.sentence_case(F.col("a")).alias("a"), text.title_case(F.col("b")).alias("b")).first()
    assert row.a == "Persons with significant control"
    assert row.b == "O'neill & Sons (uk) Ltd"


# Feed, payload, title, description.
CARDS = [
    ("companies", {"company_name": "ACME LTD"}, "Acme Ltd", ""),
    ("filings", {"category": "confirmation-statement", "description": "confirmed", "description_values": {"made_up_date": "2024-01-02"}}, "Confirmation statement filing", "Statement made on 2024-01-02"),
    ("filings", {"description": "confirmed"}, "New filing", "Statement made on "),
    ("filings", {"description": "legacy", "description_values": {"description": "Old"}}, "New filing", "Old"),
    ("filings", {"description": "legacy"}, "New filing", "legacy"),
    ("filings", {"description": "unknown-code"}, "New filing", "unknown-code"),
    ("officers", {"name": "SMITH, ANN", "appointed_on": "2020-01-01", "resigned_on": "2021-01-01"}, "Smith, Ann", "Resigned on 2021-01-01"),
    ("officers", {"name": "SMITH, ANN", "appointed_on": "2020-01-01"}, "Smith, Ann", "Appointed on 2020-01-01"),
    ("persons-with-significant-control", {"name": "Ms A", "notified_on": "2020-01-01"}, "Ms A", "Notified on 2020-01-01"),
    ("charges", {"classification": {"description": "A charge"}}, "A charge", None),
    ("insolvency-cases", {"cases": [{"type": "wind-up"}, {"type": "administration-order"}]}, "Insolvency", "Wind up, Administration order"),
    ("insolvency-cases", {"cases": []}, "Insolvency", ""),
    ("disqualified-officers", {"forename": "A", "surname": "B", "disqualifications": [{"company_names": ["X", "Y"]}, {"company_names": ["Z"]}]}, "A  B", "Disqualified from X, Y, Z"),
    ("disqualified-officers", {"forename": "A", "other_forenames": "C", "surname": "B"}, "A C B", "Disqualified from "),
    ("company-exemptions", {"kind": "exemptions"}, "Company Exemptions", cards.EXEMPTION_TEXT),
    ("persons-with-significant-control-statements", {"linked_psc_name": "MR BOB"}, "Mr Bob", cards.STATEMENT_TEXT),
    ("something-else", {}, "Something Else", cards.NO_DESCRIPTION),
]


def test_cards(spark):
    rows = [(i, feed, "/company/12345678/x", "12345678", json.dumps(data)) for i, (feed, data, _, _) in enumerate(CARDS)]
    names = "event_id int, stream_path string, resource_uri string, resource_id string, data string"
    events = spark.createDataFrame(rows, names).withColumn("data", F.parse_json("data"))
    dictionary = spark.createDataFrame([("confirmed", "Statement made on {made_up_date}")], "code string, template string")
    got = {r.event_id: (r.title, r.description) for r in cards.cards(events, dictionary).collect()}
    assert got == {i: (title, description) for i, (_, _, title, description) in enumerate(CARDS)}


def test_feed_names(spark):
    df = spark.createDataFrame([("persons-with-significant-control",)], "s string")
    assert df.select(feeds.table_name(F.col("s"))).first()[0] == "persons_with_significant_control_events"
    assert df.select(feeds.feed_from_log_key(feeds.log_key(F.col("s")))).first()[0] == "persons-with-significant-control"
    assert len(feeds.FEEDS) == 9
    with pytest.raises(ValueError, match="companies"):
        feeds.require_feed("nothing")
