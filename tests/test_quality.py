from __future__ import annotations

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from barwright import schema
from barwright.functions.dates import stamp_of
from barwright.functions.values import threshold_column, threshold_setting
from barwright.operators.mapping import (
    MappingError,
    find_column,
    flatten_labels,
    mapping_verdicts,
    price_column,
    to_canonical,
    with_adjusted_close,
)
from barwright.operators.quality import (
    ThresholdExceeded,
    annotate,
    check_metadata,
    check_threshold,
    coerce,
    error_details,
    feed_problems,
    handle,
    invalid_rows,
    summarize,
    valid_rows,
    validation_events,
    quarantined_rows,
)


def text_rows(spark, changes, count=1):
    base = {
        "ticker": "PETR4", "date": "2023-01-02", "open": "10", "high": "11", "low": "9", "close": "10.5",
        "volume": "100", "source": "desk", "fetched_at": "2024-01-31 00:00:00", "raw_checksum": "x",
    }
    data = [{**base, "n": i, **(changes[i] if i < len(changes) else {})} for i in range(max(count, len(changes)))]
    fields = ", ".join(f"{c} string" for c in base)
    return spark.createDataFrame([tuple(d[c] for c in (*base, "n")) for d in data], f"{fields}, n int")


@pytest.mark.parametrize(
    ("change", "codes"),
    [
        ({}, []),
        ({"date": "not a date"}, ["BAD_DATE"]),
        ({"date": None}, ["VALIDATION_ERROR"]),
        ({"open": "bad"}, ["NON_NUMERIC_PRICE"]),
        ({"open": None}, []),
        ({"open": "1d"}, ["NON_NUMERIC_PRICE"]),
        ({"volume": "12.5"}, ["NON_NUMERIC_VOLUME"]),
        ({"volume": "100.0"}, []),
        ({"volume": "1e3"}, []),
        ({"ticker": None}, ["VALIDATION_ERROR"]),
        ({"high": "99", "low": "105"}, ["CONSTRAINT_VIOLATION"]),
        ({"high": "9", "low": "9"}, []),
        ({"open": "bad", "high": "1", "low": "2"}, ["CONSTRAINT_VIOLATION", "NON_NUMERIC_PRICE"]),
    ],
)
def test_rules(spark, change, codes):
    row = annotate(text_rows(spark, [change])).first()
    assert sorted(e.reason_code for e in row.errors) == codes


def test_strict_rule_refuses_flat_bars_but_not_zero(spark):
    changes = [{"high": "9", "low": "9"}, {"high": "0", "low": "0"}, {"high": None}]
    found = annotate(text_rows(spark, changes), strict=True).orderBy("n").collect()
    assert [len(r.errors) for r in found] == [1, 0, 0]


def test_missing_column_marks_every_row(spark):
    frame = annotate(text_rows(spark, [], 2).drop("ticker"))
    assert [e.reason_code for r in frame.collect() for e in r.errors] == ["MISSING_COL"] * 2
    assert valid_rows(frame).count() == 0


def test_valid_and_invalid_make_up_the_input(spark):
    frame = annotate(text_rows(spark, [{"open": "x"}, {"date": "y"}, {"high": "1", "low": "3"}], 10))
    good, bad = {r.n for r in valid_rows(frame).collect()}, {r.n for r in invalid_rows(frame).collect()}
    assert good | bad == set(range(10)) and not good & bad and bad == {0, 1, 2}
    assert len(rows(error_details(frame, ("n",)))) == 3


def test_gate_fails_at_equality(spark):
    under = summarize(annotate(text_rows(spark, [{"open": "x"}], 20)))
    equal = summarize(annotate(text_rows(spark, [{"open": "x"}], 10)))
    assert check_threshold(under)
    assert not check_threshold(equal, abort=False)
    with pytest.raises(ThresholdExceeded):
        check_threshold(equal)
    empty = summarize(annotate(text_rows(spark, []).limit(0))).first()
    assert (empty.rows_total, empty.invalid_share, empty.error_codes) == (0, 0.0, {})


def test_coercion(spark):
    frame = spark.createDataFrame(
        [("2020-01-01", "1.23", "100"), ("2020-12-31", "bad", "200"), ("not a date", None, None), (None, "4", "bad")],
        "date string, open string, volume string",
    )
    found = coerce(frame).collect()
    assert [str(r.date) for r in found] == ["2020-01-01", "2020-12-31", "None", "None"]
    assert [r.open for r in found] == [1.23, None, None, 4.0]
    assert [r.volume for r in found] == [100, 200, None, None]


@pytest.mark.parametrize(
    ("value", "share"),
    [(0.2, 0.2), ("0.2", 0.2), (50, 0.5), (10, 0.1), ("10%", 0.1), (None, 0.1), (-0.1, 0.1), (200, 0.1), ("foo", 0.1), ("1e100", 0.1)],
)
def test_thresholds(spark, value, share):
    assert threshold_setting(value) == pytest.approx(share)
    frame = spark.createDataFrame([(None if value is None else str(value),)], "t string")
    assert frame.select(threshold_column(frame.t)).first()[0] == pytest.approx(share)


@pytest.mark.parametrize("value", [None, -0.1, 200, "foo", "1e100"])
def test_strict_thresholds_raise(value):
    with pytest.raises(ValueError):
        threshold_setting(value, strict=True)


def test_events_keep_every_detail(spark):
    frame = annotate(text_rows(spark, [{"open": "x"}] * 57, 60))
    events = validation_events(frame, ("ticker",), ("n",), details_per_event=10).collect()
    assert sorted(d.n for e in events for d in e.error_details) == list(range(57))
    assert {e.invalid_count for e in events} == {57} and {e.parts for e in events} == {6}


def test_handle_quarantines_and_returns_valid(spark, tmp_path):
    from pyspark.sql import functions as F

    feed = text_rows(spark, [{"open": "x"}], 30).withColumn("provider", F.lit("alpha"))
    valid, passed = handle(spark, feed, f"{tmp_path}/run", by=("provider",), id_columns=("n",))
    assert passed and valid.count() == 29
    assert spark.read.csv(f"{tmp_path}/run/invalid", header=True).count() == 1
    assert spark.read.json(f"{tmp_path}/run/events").first().invalid_count == 1


def feed(spark, columns="Date, Open, High, Low, Close, Adj Close, Volume"):
    names = [c.strip() for c in columns.split(",")]
    frame = spark.createDataFrame([("2023-01-02", "10", "11", "9", "10.5", "10.4", "100")], ["a", "b", "c", "d", "e", "f", "g"])
    return frame.toDF(*names)


def test_mapping(spark):
    mapped = to_canonical(feed(spark), "desk", "PETR4")
    assert mapped.columns == schema.names(schema.PRICES)
    row = mapped.first()
    assert (row.ticker, str(row.date), row.close, row.volume, row.source) == ("PETR4", "2023-01-02", 10.5, 100, "desk")
    assert row.raw_checksum == to_canonical(feed(spark), "desk", "PETR4").first().raw_checksum
    assert to_canonical(feed(spark, "date, OPEN, high, LOW, close, adj_close, volume"), "desk", "X").first().open == 10.0
    with pytest.raises(MappingError, match="volume"):
        to_canonical(feed(spark).drop("Volume"), "desk", "PETR4")
    assert find_column(["adj_close"], ("Adj Close",)) == "adj_close"
    assert price_column(feed(spark)) == "Adj Close"
    assert "adj_close" in with_adjusted_close(mapped).columns


def test_mapping_verdict_refuses_flat_bar(spark):
    good = feed(spark)
    frame = to_canonical(good.unionByName(good.withColumn("High", good.Low)), "desk", "PETR4")
    assert not mapping_verdicts(frame).first().mapped


def test_two_level_labels(spark):
    frame = spark.sql("select '2023-01-02' Date, named_struct('PETR4', 10.5) Close")
    assert rows(flatten_labels(frame)) == [("2023-01-02", pytest.approx(10.5))]
    with pytest.raises(MappingError):
        flatten_labels(spark.sql("select named_struct('A', 1, 'B', 2) Close"))


def test_feed_problems(spark):
    assert feed_problems(feed(spark)) == []
    assert feed_problems(feed(spark).limit(0)) == ["no rows"]
    assert "missing column volume" in feed_problems(feed(spark).drop("Volume"))


def test_declared_schema():
    text = json.dumps({"columns": [{"name": "a", "type": "float"}, {"name": "b", "type": "string", "nullable": False}]})
    assert schema.required(schema.fields_from_json(text)) == ["b"]
    with pytest.raises(ValueError):
        schema.fields_from_json(json.dumps({"columns": [{"name": "a", "type": "blob"}]}))


def test_metadata_contract(spark):
    good = {
        "ticker": "PETR4", "snapshot_date": "2023-01-02", "rows": 5, "checksum": "a" * 64, "schema_version": "1.0.0",
        "source": "desk", "rows_summary": {"count": 5},
    }
    bad = [
        {**good, "rows": "5"}, {**good, "rows": -1}, {**good, "checksum": "zz"}, {**good, "extra": 1},
        {**good, "snapshot_date": "2023-02-30"}, {k: v for k, v in good.items() if k != "source"},
    ]
    frame = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate([good, *bad])] + [(99, "{oops"), (98, "[1]")], "i int, d string")
    found = {r.i: r.problems for r in check_metadata(frame, "d").collect()}
    assert found[0] == [] and all(found[i] for i in found if i)
    assert found[99] == ["not a JSON object"]


def test_quarantine_has_as_many_folders_as_buckets(spark, tmp_path):
    feed = spark.createDataFrame(
        [(f"T{n}", "2023-01-02", "1", "0.5", "1", "1", "5", "desk", f"p{n % 3}", n) for n in range(50)],
        "ticker string, date string, open string, high string, low string, close string, volume string, source string, provider string, n int",
    ).withColumns({"fetched_at": F.lit("2024-01-01").cast("timestamp"), "raw_checksum": F.lit("x")})
    handle(spark, feed, f"{tmp_path}/run", by=("provider", "ticker"), id_columns=("n",), abort=False, buckets=4)
    assert len(list((tmp_path / "run" / "invalid").glob("_bucket=*"))) <= 4
    kept = quarantined_rows(spark, f"{tmp_path}/run", feed.columns).collect()
    assert sorted((r.ticker, r.provider, r.high, r.n) for r in kept) == sorted((f"T{n}", f"p{n % 3}", "0.5", str(n)) for n in range(50))


def test_stamps_need_a_zone():
    from datetime import datetime, timedelta, timezone

    assert stamp_of(datetime(2024, 1, 31, 1, tzinfo=timezone(timedelta(hours=2)))) == "20240130T230000Z"
    assert stamp_of("20240131T000000Z") == "20240131T000000Z"
    for wrong in (datetime(2024, 1, 31), "2024-01-31", "20240131T000000", "20240131T000000Z "):
        with pytest.raises(ValueError):
            stamp_of(wrong)


def test_a_filter_on_errors_does_not_repeat_the_source(spark):
    from pyspark.sql import types as T

    from barwright.operators.quality import annotate

    text = F.concat(F.col("id").cast("string"), F.lit("marker"))
    columns = {f.name: text if f.kind in ("string", "date", "float", "int") else F.current_timestamp() for f in schema.PRICES}
    checked = annotate(spark.range(3).select(*(c.alias(n) for n, c in columns.items())), strict=True)
    found = checked.filter(F.exists("errors", lambda e: e["reason_code"] == "BAD_DATE")).select("ticker", "date")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("marker") <= len(columns) and isinstance(checked.schema["date"].dataType, T.DateType)
    assert found.count() == 3


def test_a_document_names_its_ticker_once(spark):
    from barwright.operators.mapping import explode_series

    text = '{"Meta": {"S": "AAAA3"}, "D": {"2021-06-01": {"1. open": "1"}, "2021-06-02": {"1. open": "2"}}}'
    found = explode_series(spark.createDataFrame([(text,), ("no document",), (None,)], "answer string"), "answer", "D", "$['Meta']['S']")
    assert rows(found.select("ticker", "date", "`1. open`")) == [("AAAA3", "2021-06-01", "1"), ("AAAA3", "2021-06-02", "2")]
    above = found._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "get_json_object" not in above  # not once a date


def test_plain_dates_are_read_like_all_others(spark):
    from barwright.functions.dates import feed_date, lenient_date

    texts = ["2021-06-01", " 2021-06-01 ", "2021-02-30", "2021-6-1", "06-01-2021", "2021-06-01\n", "2021-06-01T23:30:00-05:00", "x", "", None]
    day, c = F.lit("2021-06-01").cast("date"), F.col("t")
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(feed_date(c) == day, lenient_date(c) == day).collect()
    assert [r[0] for r in found] == [True, True, None, True, True, None, None, None, None, None]
    assert [r[1] for r in found] == [True, True, None, True, None, True, False, None, None, None]
