"""Hand-written edge rows for the semantics ledger and decoder traps."""

import base64
import datetime as dt
from decimal import Decimal

import pytest

from fillwise.functions.core import check_limit, period_hours
from fillwise.operators import analytics as A
from fillwise.operators import decode as X
from fillwise.operators import lifecycle as L
from fillwise.operators.dedup import latest
from fillwise.schema import CREATE_ORDER_DISCRIMINATOR_HEX, RAW_TX, SOURCE_PROGRAM_ID
from fillwise.sources import io as IO
from tests_helpers import T0, events

def test_q1_two_creates_in_one_transaction_collapse(spark):
    ev = latest(events(spark, [
        {"order_id": "a", "event_type": "created", "signature": "s1"},
        {"order_id": "b", "event_type": "created", "signature": "s1"},
    ]))
    assert ev.count() == 1


def test_equal_version_tie_broken_by_business_columns(spark):
    ev = latest(events(spark, [
        {"order_id": "a", "event_type": "fulfilled", "signature": "s", "_version": 5, "take_amount_usd": 1.0},
        {"order_id": "a", "event_type": "fulfilled", "signature": "s", "_version": 5, "take_amount_usd": 2.0},
        {"order_id": "a", "event_type": "fulfilled", "signature": "s", "_version": 4, "take_amount_usd": 9.0},
    ]))
    assert [r.take_amount_usd for r in ev.collect()] == [2.0]


def test_q2_falsy_values_become_null(spark):
    out = IO.normalise_events(events(spark, [
        {"order_id": "a", "event_type": "created", "signature": "s", "maker": "", "give_amount_usd": 0.0,
         "give_amount": Decimal(0), "give_chain_id": 2**62},
    ])).first()
    assert out.maker is None and out.give_amount_usd is None and out.give_amount is None
    assert out.give_chain_id == 2**62


def test_q4_fulfilled_only_and_created_only(spark):
    ev = events(spark, [
        {"order_id": "f", "event_type": "fulfilled", "signature": "f1", "taker": "t"},
        {"order_id": "c", "event_type": "created", "signature": "c1", "maker": "m", "give_amount_usd": 0.0},
    ])
    rows = {r.order_id: r for r in L.lifecycles(ev).collect()}
    assert rows["f"].created_at is None and rows["f"].time_to_fill_seconds is None
    assert rows["c"].fulfilled_at is None and rows["c"].amount_usd is None  # 0 → NULL
    assert {r.status for r in L.orders_combined(ev).collect()} == {"created", "fulfilled"}


def test_negative_fill_time_kept(spark):
    ev = events(spark, [
        {"order_id": "o", "event_type": "created", "signature": "c", "block_time": T0},
        {"order_id": "o", "event_type": "fulfilled", "signature": "f", "block_time": T0 - dt.timedelta(seconds=90)},
    ])
    assert L.lifecycles(ev).first().time_to_fill_seconds == -90


def test_q20_limits_validated():
    assert check_limit(None, 10, 50) == 10
    for bad in (0, -1, 51):
        with pytest.raises(ValueError):
            check_limit(bad, 10, 50)


def test_q21_unknown_period_is_24h():
    assert period_hours("fortnight") == 24 and period_hours("7d") == 168


def test_empty_table_totals_are_zero(spark):
    out = A.total_stats(events(spark, []).limit(0)).first()
    assert tuple(out) == (0, 0, 0.0, 0.0)


# --------------------------------------------------------------------------- decoder edge rows
def tx(spark, logs=None, pre=None, post=None, pre_sol=None, post_sol=None, data_hex=None, keys=None):
    ix = [{"programId": SOURCE_PROGRAM_ID, "data": data_hex}] if data_hex else []
    row = {"signature": "s", "slot": 1, "blockTime": 978307200,
           "meta": {"err": None, "logMessages": logs or [], "innerInstructions": [],
                    "preTokenBalances": pre or [], "postTokenBalances": post or [],
                    "preBalances": pre_sol or [], "postBalances": post_sol or []},
           "transaction": {"message": {"instructions": ix,
                                       "accountKeys": keys or [{"pubkey": "k", "signer": True}]}}}
    return spark.createDataFrame([row], RAW_TX)


def b64(hexs):
    return "Program data: " + base64.b64encode(bytes.fromhex(hexs)).decode()


def feats(df):
    return X.tx_features(df).first()


def test_order_id_payload_lengths_and_zero_id(spark):
    oid = "ab" * 32
    assert feats(tx(spark, [b64("00" * 8 + oid[:62])])).order_id is None          # 39 bytes
    assert feats(tx(spark, [b64("00" * 8 + oid)])).order_id == oid                 # 40 bytes
    assert feats(tx(spark, [b64("00" * 40), b64("11" * 8 + oid)])).order_id == oid  # zero id skipped
    text = f"Program log: Order ID: {oid.upper()}"
    assert feats(tx(spark, ["Program data: !!!not-base64", text])).order_id == oid  # fallback pattern


def test_chain_id_scan_skips_first_payload_and_last_window(spark):
    eth = (1).to_bytes(8, "little").hex()
    first_only = tx(spark, [b64(eth + "00" * 32)])
    assert feats(first_only).dest_chain is None                      # id in the 1st payload ignored
    assert feats(tx(spark, [b64("00" * 40), b64(eth + "ff")])).dest_chain == 1
    last_window_only = tx(spark, [b64("00" * 40), b64("ff" + eth)])   # 9 bytes: offset 1 is the last window
    assert feats(last_window_only).dest_chain is None
    solana_then_eth = (7565164).to_bytes(8, "little").hex() + eth + "ff"
    assert feats(tx(spark, [b64("00" * 40), b64(solana_then_eth)])).dest_chain == 1


def bal(i, mint, amount, owner="o"):
    return {"accountIndex": i, "mint": mint, "owner": owner, "uiTokenAmount": {"amount": str(amount), "decimals": 6}}


def test_primary_transfer_ties_and_sol_fallback(spark):
    t = feats(tx(spark, pre=[bal(1, "A", 0)], post=[bal(1, "A", 5), bal(2, "B", 5)])).transfer
    assert (t.mint, int(t.amount)) == ("A", 5)                       # first of equal gains wins
    t = feats(tx(spark, pre_sol=[10_000_000 + 1, 0], post_sol=[1, 0])).transfer
    assert t is None                                                 # exactly 10 000 000 is dust
    t = feats(tx(spark, pre_sol=[10_000_001 + 1, 0], post_sol=[1, 0])).transfer
    assert t.mint.startswith("So1111") and int(t.amount) == 10_000_001


def test_upper_case_evm_address_resolves(spark):
    df = spark.createDataFrame([("0XA0B86991C6218B36C1D19D4A2E9EB0CE3606EB48",)], "mint string")
    r = X.resolve_tokens(df, spark).first()
    assert r.symbol == "USDC" and r.decimals == 6


def test_u64_max_and_create_decoder(spark):
    amount = (2**64 - 1).to_bytes(8, "little").hex()
    data = CREATE_ORDER_DISCRIMINATOR_HEX.lower() + amount + "00" * 32 + "14000000" + "ab" * 20
    ev = X.decode_events(spark, tx(spark, [b64("00" * 8 + "cd" * 32)], data_hex=data), "hex").first()
    assert int(ev.give_amount) == 2**64 - 1 and ev.order_id == "cd" * 32 and ev.maker == "k"


def test_create_full_bad_length_moves_cursor(spark):
    from fillwise.operators.decode import with_create_full
    data = (CREATE_ORDER_DISCRIMINATOR_HEX.lower() + "00" * 40 + "19000000" + "14000000" + "ab" * 20)
    df = spark.createDataFrame([(bytes.fromhex(data),)], "bytes binary")
    f = with_create_full(df, "bytes", "f").first().f
    assert f.give_token is None and f.take_token == "0x" + "ab" * 20
