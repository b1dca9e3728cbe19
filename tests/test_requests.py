import pytest
from conftest import utc

from tidelog.functions.cursors import Cursor
from tidelog.operators.filters import LogFilter
from tidelog.plans.requests import AggregateRequest, ListRequest, RequestError, parse_time

RANGE = {"since": "2024-01-01T00:00:00Z", "until": "2024-01-02T00:00:00Z", "bucket": "1h"}


@pytest.mark.parametrize(
    "params, message",
    [
        ({"level": "nope"}, "invalid level: must be one of debug, info, warn, error"),
        ({"level": ""}, "invalid level: must be one of debug, info, warn, error"),
        ({"since": "yesterday"}, "invalid since: must be a valid ISO 8601 timestamp"),
        ({"until": ""}, "invalid until: must be a valid ISO 8601 timestamp"),
        ({"since": "2024-01-02", "until": "2024-01-01"}, "until must be later than since"),
        ({"since": "2024-01-02", "until": "2024-01-02T00:00:00Z"}, "until must be later than since"),
        ({"limit": "-1"}, "limit must be a positive integer"),
        ({"limit": "1.5"}, "limit must be a positive integer"),
        ({"limit": ""}, "limit must be a positive integer"),
        ({"limit": "0"}, "limit must be between 1 and 1000"),
        ({"limit": "1001"}, "limit must be between 1 and 1000"),
        ({"cursor": "not-a-cursor"}, "invalid or malformed cursor"),
        ({"cursor": ""}, "invalid or malformed cursor"),
    ],
)
def test_list_errors(params, message):
    with pytest.raises(RequestError, match=message):
        ListRequest.parse(params)


@pytest.mark.parametrize(
    "change, message",
    [
        ({"since": None}, "since is required"),
        ({"since": ""}, "since is required"),
        ({"until": None}, "until is required"),
        ({"until": RANGE["since"]}, "until must be later than since"),
        ({"since": "x"}, "invalid since: must be a valid ISO 8601 timestamp"),
        ({"bucket": None}, "bucket is required"),
        ({"bucket": "2h"}, "bucket must be one of: 1m, 5m, 1h, 1d"),
        ({"group_by": "message"}, "group_by must be one of: service, level"),
        ({"group_by": ""}, "group_by must be one of: service, level"),
        ({"level": "fatal"}, "invalid level: must be one of debug, info, warn, error"),
    ],
)
def test_aggregate_errors(change, message):
    with pytest.raises(RequestError, match=message):
        AggregateRequest.parse({**RANGE, **change})


def test_list_request():
    cursor = Cursor(utc("2024-01-01 10:00:00"), 7)
    found = ListRequest.parse(
        {
            "service": "auth",
            "level": "warn",
            "since": "2024-01-01T00:00:00.000001+01:00",
            "q": "x",
            "limit": "0020",
            "cursor": cursor.encode(),
            "attr.user_id": "42",
            "attr.a.b": "",
            "attr.twice": ["1", "2"],
            "other": "ignored",
        }
    )
    assert found.limit == 20
    assert found.where == LogFilter(
        since=utc("2023-12-31 23:00:00.000001"),
        service="auth",
        level="warn",
        q="x",
        attrs={"user_id": "42", "a.b": ""},
        cursor=cursor,
    )
    assert ListRequest.parse({}) == ListRequest(LogFilter(), 100)


def test_aggregate_request():
    found = AggregateRequest.parse({**RANGE, "group_by": "level", "attr.k": "1"}, q_mode="pattern")
    assert (found.bucket, found.group_by, found.where.q_mode) == ("1h", "level", "pattern")
    assert found.where.attrs == {"k": "1"}


@pytest.mark.parametrize(
    "text, instant",
    [
        ("2024-02-29", "2024-02-29 00:00:00"),
        ("2024-02-29T10:20Z", "2024-02-29 10:20:00"),
        ("2024-02-29T10:20:30", "2024-02-29 10:20:30"),
        ("2024-02-29T10:20:30.123456789Z", "2024-02-29 10:20:30.123456"),
        ("2024-02-28T24:00:00Z", "2024-02-29 00:00:00"),
        ("2024-02-29T00:00:00-05:30", "2024-02-29 05:30:00"),
    ],
)
def test_times(text, instant):
    assert parse_time(text, "since") == utc(instant)


@pytest.mark.parametrize(
    "text", ["2023-02-29", "2024-02-29T24:00:01Z", "2024-02-29T10:60Z", "2024-1-1", "20240101", "2024-01-01T00:00:00+19:00"]
)
def test_bad_times(text):
    with pytest.raises(RequestError):
        parse_time(text, "since")


def test_a_very_long_limit_is_answered_like_a_large_one():
    with pytest.raises(RequestError) as large:
        ListRequest.parse({"limit": "99999"})
    with pytest.raises(RequestError) as long:
        ListRequest.parse({"limit": "9" * 5000})
    assert str(large.value) == str(long.value)
