"""No caps: long payloads, the whole u64 range, malformed documents, long token lists, sub-micro amounts, exact medians."""

import base64
import statistics
from decimal import Decimal

from pyspark.sql import functions as F
from tests_helpers import T0, events

from fillwise.functions.core import since_hours
from fillwise.operators import analytics as A
from fillwise.operators import decode as X
from fillwise.operators import telemetry as T
from fillwise.sources import io as IO
from fillwise.sources import rawtx as R


def test_payload_over_a_mebibyte_is_whole(spark):
    data = bytes(range(256)) * 8192
    logs = spark.createDataFrame([(["Program data: " + base64.b64encode(data).decode()],)], "logs array<string>")
    assert bytes(logs.select(X.program_data_payloads(F.col("logs"))[0]).first()[0]) == data


def test_chain_ids_of_the_whole_u64_range(spark):
    rows = events(spark, [{"order_id": "a", "event_type": "created", "signature": "s"}]).drop("give_chain_id")
    for value, want in ((2**63 + 1, 2**63 + 1), (2**64 - 1, 2**64 - 1), (2**64, None), (-1, None)):
        df = rows.withColumn("give_chain_id", F.lit(Decimal(value)).cast("decimal(20,0)"))
        assert IO.table_rows(df).first().give_chain_id == (None if want is None else Decimal(want))


def test_malformed_documents_are_kept_for_quarantine(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"signature": "ok", "slot": 1}\n{"signature": "cut off\nnot json\n')
    raw = R.read_raw_transactions(spark, str(tmp_path)).cache()
    assert raw.where("_corrupt_record IS NULL").count() == 1
    assert sorted(r[0] for r in R.corrupt_documents(raw).collect()) == ["not json", '{"signature": "cut off']


def test_fallback_token_list_ranks_all_tokens(spark):
    rows = [{"order_id": f"{t}-{k}", "event_type": "created", "signature": f"{t}-{k}", "give_token_symbol": f"T{t:02d}"}
            for t in range(61) for k in range(9 if t == 60 else 1)]
    got = A.positive_volume_tokens(events(spark, rows)).orderBy("rank").collect()
    assert (got[0].symbol, got[0].order_count, len(got)) == ("T60", 9, 8)


def test_median_is_exact_over_many_values(spark):
    for n in (0, 1, 2, 7, 100, 1001):
        values = [((i * 7919) % 503) / 7 + 0.5 for i in range(n)]
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
        want = statistics.median(values) if values else None
        assert A.exact_median(df, "x").first()[0] == want


def test_last_hours_are_counted_from_now(spark):
    rows = events(spark, [{"order_id": "a", "event_type": "created", "signature": "s", "block_time": T0}])
    assert since_hours(rows, 24).count() == 0
    assert since_hours(rows.withColumn("block_time", F.current_timestamp()), 24).count() == 1


def test_latency_is_of_successful_requests(spark):
    log = spark.createDataFrame([(1, "e", T0, 10.0, True), (2, "e", T0, 1000.0, False)],
                                "request_id long, endpoint string, ts timestamp, latency_ms double, ok boolean")
    assert [(r.request_id, r.rolling_latency_ms) for r in T.rolling_latency(log).collect()] == [(1, 10.0)]


def test_wide_integers_are_exact(spark):
    import random

    from fillwise.functions import binary as B
    rnd = random.Random(1)
    values = [0, 1, 10 ** 9, 10 ** 38 - 1, 10 ** 38, 2 ** 64, 2 ** 128 - 1, 2 ** 255, 2 ** 256 - 1, 10 ** 77] + [rnd.randrange(2 ** rnd.randint(1, 256)) for _ in range(60)]
    df = spark.createDataFrame([(k, bytearray(b"x" + v.to_bytes(32, "little"))) for k, v in enumerate(values)], "k int, b binary")
    b = F.col("b")
    for r in df.select("k", B.u_le_text(b, 1, 32).alias("u256"), B.u_le_text(b, 1, 16).alias("u128"), B.u_le(b, 1, 16).alias("d"), B.u_le_too_wide(b, 1, 16).alias("wide"),
                       B.u_le_text(b, 1, 3).alias("u24"), B.u_le_text(b, 2, 32).alias("beyond")).collect():
        v, low = values[r.k], values[r.k] % 2 ** 128
        assert (int(r.u256), int(r.u128), int(r.u24), r.beyond) == (v, low, v % 2 ** 24, None)
        assert r.wide == (low >= 10 ** 38) and r.d == (None if r.wide else Decimal(low))


def test_wire_keeps_chain_ids_of_the_whole_range(spark):
    rows = events(spark, [{"order_id": "a", "event_type": "created", "signature": "s"}]).withColumn("give_chain_id", F.lit(Decimal(2**64 - 1)).cast("decimal(20,0)"))
    assert IO.from_wire(IO.wire_json(rows)).first().give_chain_id == Decimal(2**64 - 1)


def test_an_endpoint_recovers_after_an_old_failure_run(spark):
    import datetime as dt
    at = lambda s: T0 + dt.timedelta(seconds=s)
    schema = "request_id long, endpoint string, ts timestamp, latency_ms double, ok boolean"
    fails = [(k, "e", at(k), 1.0, False) for k in range(5)]
    healthy = lambda rows, **kw: {r.endpoint: r.healthy for r in T.endpoint_totals(spark.createDataFrame(rows, schema), **kw).collect()}
    assert healthy(fails + [(9, "other", at(30), 1.0, True)]) == {"e": False, "other": True, "ALL": None}
    assert healthy(fails + [(9, "other", at(300), 1.0, True)])["e"] is True
    assert healthy(fails, as_of="2001-01-01 00:10:00")["e"] is True


def test_current_rps_counts_the_last_second_only(spark):
    import datetime as dt
    rows = [(1, "a", T0, 1.0, True), (2, "a", T0 + dt.timedelta(milliseconds=900), 1.0, True), (3, "a", T0 + dt.timedelta(seconds=1), 1.0, True), (4, "b", T0, 1.0, True)]
    log = spark.createDataFrame(rows, "request_id long, endpoint string, ts timestamp, latency_ms double, ok boolean")
    assert {r.endpoint: r.current_rps for r in T.current_rps(log).collect()} == {"a": 2, "b": 0}


def test_parse_outcomes_count_lines_that_are_no_document(spark, sf, tmp_path):
    raw = R.damaged(R.raw_transactions_from_tpch(spark, sf, "base58").where("slot < 400"))
    R.landed_lines(raw).select("value").write.text(str(tmp_path / "in"))
    got = X.parse_stats(X.parse_outcomes(spark, R.read_raw_transactions(spark, str(tmp_path / "in")))).first()
    bad = raw.where("slot % 71 = 0 OR slot % 83 = 0").count()
    assert (got.total, got.failed) == (raw.count(), bad) and got.success + got.no_events + bad == got.total and got.success > 0
