"""Registered decode queries.

The Spark side builds raw transaction documents from the driver tables
(``sources.rawtx``) and decodes them; the oracle states the expected result
directly from the source columns, so it checks the decoder, not a copy of it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fillwise.functions import binary as B
from fillwise.operators import decode as X
from fillwise.plans.catalog import register
from fillwise.schema import EVM_TOKENS, NATIVE_SOL_MINT, SOLANA_TOKENS
from fillwise.sources import rawtx as R
from fillwise.sources import tpch
from fillwise.streaming.ingest import FAST, scratch_dir

_TOK_ROWS = ([(i, a, "solana", s, d, p) for i, (a, s, d, p) in enumerate(SOLANA_TOKENS)]
             + [(len(SOLANA_TOKENS) + i, a, "evm", s, d, p) for i, (a, s, d, p) in enumerate(EVM_TOKENS)])
_TOK = ("tok AS (SELECT * FROM (VALUES "
        + ", ".join(f"({i}, '{a}', '{f}', '{s}', {d}, {p!r})" for i, a, f, s, d, p in _TOK_ROWS)
        + ") t(tok_idx, tok_address, tok_family, tok_symbol, tok_decimals, tok_price))")

_CHAIN = ("CASE o_orderkey % 12 WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 56 WHEN 3 THEN 100 WHEN 4 THEN 137 "
          "WHEN 5 THEN 250 WHEN 6 THEN 8453 WHEN 7 THEN 42161 WHEN 8 THEN 43114 END")

_MINT = ("CASE WHEN tok_address IS NULL THEN 'UNKNOWN' || CAST({k} % 5 AS VARCHAR) "
         "WHEN tok_family = 'evm' AND {k} % 2 = 1 THEN upper(tok_address) ELSE tok_address END")

_CREATED = f"""cx AS (
  SELECT o.*, c_name, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS amt, o_orderkey % 46 AS k_idx, t.*,
         {_MINT.format(k='o_orderkey')} AS mint_in_tx
  FROM orders o LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN tok t ON t.tok_idx = o_orderkey % 46),
cy AS (
  SELECT *, CASE WHEN k_idx = 0 THEN amt + 5000 > 10000000 ELSE tok_address IS NOT NULL END AS known,
         CASE WHEN k_idx = 0 THEN CASE WHEN amt + 5000 > 10000000 THEN '{NATIVE_SOL_MINT}' END
              ELSE mint_in_tx END AS tx_mint
  FROM cx)"""

_FULFILLED = f"""fx AS (
  SELECT l.*, s_name, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS amt, l_partkey % 46 AS k_idx, t.*,
         {_MINT.format(k='l_orderkey')} AS mint_in_tx
  FROM lineitem l LEFT JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN tok t ON t.tok_idx = l_partkey % 46),
fy AS (
  SELECT *, CASE WHEN k_idx = 0 THEN amt + 5000 > 10000000 ELSE tok_address IS NOT NULL END AS known,
         CASE WHEN k_idx = 0 THEN CASE WHEN amt + 5000 > 10000000 THEN '{NATIVE_SOL_MINT}' END
              ELSE mint_in_tx END AS tx_mint,
         CAST(CASE WHEN k_idx = 0 THEN CASE WHEN amt + 5000 > 10000000 THEN amt + 5000 END ELSE amt END
              AS DECIMAL(38,0)) AS tx_amount
  FROM fx)"""

_USD = "CASE WHEN known THEN CAST({a} AS DOUBLE) / pow(10, coalesce(tok_decimals, 6)) * tok_price END"

_EVENTS_SQL = f"""WITH {_TOK}, {_CREATED}, {_FULFILLED}
SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS order_id, 'created' AS event_type,
       'c-' || CAST(o_orderkey AS VARCHAR) AS signature, o_orderkey AS slot, o_orderdate AS block_time,
       c_name AS maker, tx_mint AS give_token_address, CASE WHEN known THEN tok_symbol END AS give_token_symbol,
       CAST(amt AS DECIMAL(38,0)) AS give_amount, {_USD.format(a='amt')} AS give_amount_usd,
       CAST(7565164 AS BIGINT) AS give_chain_id, CAST(NULL AS VARCHAR) AS take_token_address,
       CAST(NULL AS VARCHAR) AS take_token_symbol, CAST(NULL AS DECIMAL(38,0)) AS take_amount,
       CAST(NULL AS DOUBLE) AS take_amount_usd, CAST({_CHAIN} AS BIGINT) AS take_chain_id,
       CAST(NULL AS VARCHAR) AS receiver, CAST(NULL AS VARCHAR) AS taker,
       CAST(NULL AS DECIMAL(38,0)) AS fulfilled_amount, CAST(NULL AS DOUBLE) AS fulfilled_amount_usd,
       CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS ix_pos
FROM cy WHERE o_orderstatus != 'P' AND o_orderkey % 17 != 0
UNION ALL
SELECT sha256(CAST(l_orderkey AS VARCHAR)), 'fulfilled',
       'f-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR), l_orderkey, l_shipdate,
       NULL, NULL, NULL, NULL, NULL, NULL, NULL,
       CASE WHEN known THEN tok_symbol END, tx_amount, {_USD.format(a='tx_amount')}, 7565164,
       NULL, s_name, NULL, NULL, 0
FROM fy WHERE l_linenumber != 7"""


def _raw(spark, sf, encoding="base58"):
    return R.raw_transactions_from_tpch(spark, sf, encoding)


@register("decode_events", _EVENTS_SQL)
def q_decode_events(spark, sf):
    return X.decode_events(spark, _raw(spark, sf))


@register("decode_events_hex", _EVENTS_SQL)
def q_decode_events_hex(spark, sf):
    """Same job on a hex-landed feed: no Python step at all."""
    return X.decode_events(spark, _raw(spark, sf, "hex"), "hex")


@register("decode_create", """
SELECT 'c-' || CAST(o_orderkey AS VARCHAR) AS signature, sha256(CAST(o_orderkey AS VARCHAR)) AS order_id,
       CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS DECIMAL(38,0)) AS give_amount
FROM orders WHERE o_orderstatus != 'P' AND o_orderkey % 17 != 0""")
def q_decode_create(spark, sf):
    ix = X.decoded_instructions(R.created_transactions(spark, sf, "hex"), "hex")
    keep = F.when(X.is_create(F.col("bytes")), F.col("order_id").isNotNull()).otherwise(F.lit(False))
    return (ix.where(keep)
            .select("signature", "order_id", B.u_le(F.col("bytes"), 8, 8).alias("give_amount")))


_ADDR20 = "'0x' || substr(sha256('{p}' || CAST(o_orderkey AS VARCHAR)), 1, 40)"


@register("decode_create_full", f"""WITH {_TOK}
SELECT 'c-' || CAST(o_orderkey AS VARCHAR) AS signature, '828362be28ce4432' AS discriminator,
  CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS DECIMAL(38,0)) AS give_amount,
  sha256(c_name) AS maker_src_field,
  CASE WHEN tok_family = 'evm' THEN tok_address
       ELSE sha256(CASE WHEN tok_address IS NULL THEN 'UNKNOWN' || CAST(o_orderkey % 5 AS VARCHAR)
                        ELSE tok_address END) END AS give_token,
  CASE WHEN o_orderkey % 11 != 0 THEN {_ADDR20.format(p='t')} END AS take_token,
  CASE WHEN o_orderkey % 11 != 0 THEN {_ADDR20.format(p='r')} END AS receiver_dst,
  CASE WHEN o_orderkey % 11 != 0 THEN sha256('a' || CAST(o_orderkey AS VARCHAR)) END AS order_authority_dst,
  CASE WHEN o_orderkey % 11 != 0 AND o_orderkey % 3 != 0 THEN {_ADDR20.format(p='q')} END AS allowed_taker_dst
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN tok ON tok_idx = o_orderkey % 46
WHERE o_orderkey % 17 != 0""")
def q_decode_create_full(spark, sf):
    raw = R.created_transactions(spark, sf, "hex")
    feats = X.tx_features(raw)
    ix = feats.select("signature", F.explode("ixs").alias("ix"))
    ix = ix.where(F.col("ix.programId") == X.SOURCE_PROGRAM_ID)
    ix = ix.withColumn("bytes", X.instruction_bytes(F.col("ix.data"), "hex"))
    ix = ix.where(X.is_create_head(F.col("bytes")))
    return (X.with_create_full(ix, "bytes", "f")
            .select("signature", "f.discriminator", "f.give_amount", "f.maker_src_field", "f.give_token",
                    "f.take_token", "f.receiver_dst", "f.order_authority_dst", "f.allowed_taker_dst"))


@register("borsh_columns", """
SELECT l_orderkey, l_linenumber, l_suppkey, CAST(l_quantity AS INTEGER) AS qty,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS DECIMAL(38,0)) AS cents,
       CAST(l_orderkey AS DECIMAL(38,0)) * CAST(18446744073709551616 AS DECIMAL(38,0))
         + CAST(l_partkey AS DECIMAL(38,0)) AS wide,
       l_returnflag AS flag, l_linestatus = 'O' AS is_open,
       CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate IS NOT NULL END AS opt_some
FROM lineitem""")
def q_borsh_columns(spark, sf):
    """D4 round trip: TPC-H columns → Borsh bytes (hex) → read back with the column readers."""
    li = tpch.read_table(spark, sf, "lineitem")
    cents = (F.col("l_extendedprice").cast("decimal(18,2)") * 100).cast("bigint")
    flag = F.col("l_returnflag")
    opt = F.when(F.col("l_linenumber") % 2 == 0, F.lit("01")).otherwise(F.lit("00"))
    hex_text = F.concat(
        B.le_hex_of(F.col("l_orderkey"), 8),                      # u64 @0
        B.le_hex_of(F.col("l_linenumber"), 1),                    # u8  @8
        B.le_hex_of(F.col("l_suppkey"), 4),                       # u32 @9
        B.le_hex_of(F.col("l_quantity").cast("int"), 2),          # u16 @13
        B.le_hex_of(cents, 8),                                    # u64 @15
        B.le_hex_of(F.col("l_partkey"), 8), B.le_hex_of(F.col("l_orderkey"), 8),   # u128 @23
        B.le_hex_of(F.octet_length(flag), 4), F.hex(flag),        # string @39
        F.when(F.col("l_linestatus") == "O", F.lit("01")).otherwise(F.lit("00")),  # bool
        opt,                                                      # option tag
    )
    # Bytes and cursor are projected as columns first, so that each is worked out once a row.
    b, after = F.col("bytes"), F.col("after")
    staged = li.select(F.unhex(hex_text).alias("bytes")).select("bytes", (F.lit(43) + B.u_le_long(b, 39, 4)).alias("after"))
    return staged.select(
        B.u_le_long(b, 0, 8).alias("l_orderkey"),
        B.u_le_long(b, 8, 1).cast("int").alias("l_linenumber"),
        B.u_le_long(b, 9, 4).alias("l_suppkey"),
        B.u_le_long(b, 13, 2).cast("int").alias("qty"),
        B.u_le(b, 15, 8).alias("cents"),
        B.u_le(b, 23, 16).alias("wide"),
        B.string_at(b, 39).alias("flag"),
        B.boolean_at(b, after).alias("is_open"),
        F.when(B.opt_present(b, after + 1), F.lit(True)).alias("opt_some"),
    )


_ORDER_IDS = """SELECT 'c-' || CAST(o_orderkey AS VARCHAR) AS signature, sha256(CAST(o_orderkey AS VARCHAR)) AS order_id,
  CAST({chain} AS BIGINT) AS dest_chain, c_name AS signer
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'f-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR),
  sha256(CAST(l_orderkey AS VARCHAR)), NULL, s_name
FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey"""


@register("order_id_from_logs", _ORDER_IDS.format(chain=_CHAIN))
def q_order_id_from_logs(spark, sf):
    """D5 + D6 + W4 + W5 on every document (failed ones included: logs only)."""
    return X.tx_features(_raw(spark, sf, "hex")).select(
        "signature", "order_id", F.col("dest_chain"), "signer")


@register("primary_transfer", f"""WITH {_TOK}, {_CREATED}, {_FULFILLED}
SELECT 'c-' || CAST(o_orderkey AS VARCHAR) AS signature, tx_mint AS mint,
       CAST(CASE WHEN k_idx = 0 THEN CASE WHEN amt + 5000 > 10000000 THEN amt + 5000 END ELSE amt END
            AS DECIMAL(38,0)) AS amount,
       CASE WHEN tx_mint IS NULL THEN NULL WHEN k_idx = 0 THEN '' ELSE 'escrow' END AS owner
FROM cy
UNION ALL
SELECT 'f-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR), tx_mint, tx_amount,
       CASE WHEN tx_mint IS NULL THEN NULL WHEN k_idx = 0 THEN '' ELSE s_name END
FROM fy""")
def q_primary_transfer(spark, sf):
    """W3 + J5: the main transfer of every document."""
    raw = _raw(spark, sf, "hex")
    return raw.select("signature", X.primary_transfer(F.col("meta")).alias("t")).select(
        "signature", F.col("t.mint").alias("mint"), F.col("t.amount").alias("amount"),
        F.col("t.owner").alias("owner"))


@register("all_instructions", f"""
SELECT 'c-' || CAST(o_orderkey AS VARCHAR) AS signature, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS n_ix,
       CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS program_pos
FROM orders
UNION ALL SELECT 'f-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR), 1, 0 FROM lineitem""")
def q_all_instructions(spark, sf):
    """Top-level then inner instructions; position of the program instruction."""
    raw = _raw(spark, sf, "hex")
    ixs = X.all_instructions(F.struct(F.col("transaction"), F.col("meta")))
    ids = F.transform(ixs, lambda i: i["programId"])
    pos = F.greatest(F.array_position(ids, X.SOURCE_PROGRAM_ID), F.array_position(ids, X.DESTINATION_PROGRAM_ID)) - 1
    return raw.select("signature", F.size(ixs).alias("n_ix"), pos.cast("int").alias("program_pos"))


_U128 = """(CASE WHEN o_orderkey % 5 = 0 THEN 340282366920938463463374607431768211455::UHUGEINT
  ELSE o_orderkey::UHUGEINT * 18446744073709551616::UHUGEINT + (o_orderkey * 7919)::UHUGEINT END)"""
_ALL_ONES = str(2 ** 256 - 1)


@register("borsh_wide_numbers", f"""
SELECT o_orderkey AS slot, CAST({_U128} AS VARCHAR) AS u128, length(CAST({_U128} AS VARCHAR)) > 38 AS too_wide,
       CASE WHEN o_orderkey % 3 = 0 THEN '{_ALL_ONES}' ELSE CAST({_U128} AS VARCHAR) END AS u256 FROM orders""")
def q_borsh_wide_numbers(spark, sf):
    """u128 and u256 as exact decimal text up to 2^128-1 and 2^256-1."""
    k = F.col("o_orderkey")
    u128 = F.when(k % 5 == 0, F.lit("ff" * 16)).otherwise(F.concat(R.le_hex_of(k * 7919, 8), R.le_hex_of(k, 8)))
    u256 = F.when(k % 3 == 0, F.lit("ff" * 32)).otherwise(F.concat(u128, F.lit("00" * 16)))
    b = F.col("bytes")
    staged = tpch.read_table(spark, sf, "orders").select(k.alias("slot"), F.unhex(F.concat(u128, u256)).alias("bytes"))
    return staged.select("slot", B.u_le_text(b, 0, 16).alias("u128"),
                                                       B.u_le_too_wide(b, 0, 16).alias("too_wide"), B.u_le_text(b, 16, 32).alias("u256"))


@register("borsh_wide", """
SELECT o_orderkey AS slot, lpad(lower(to_hex(o_orderkey)), 64, '0') AS u256,
       substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 2 * (o_orderkey % 7)) AS vec FROM orders""")
def q_borsh_wide(spark, sf):
    """A 256-bit little-endian number and a length-prefixed byte vector."""
    k = F.col("o_orderkey")
    size = (k % 7).cast("int")
    data = F.concat(R.le_hex_of(k, 8), F.lit("00" * 24), R.le_hex_of((k % 7).cast("bigint"), 4),
                    F.substr(F.sha2(k.cast("string"), 256), F.lit(1), size * 2))
    b = F.unhex(data)
    return tpch.read_table(spark, sf, "orders").select(k.alias("slot"), B.u_le_hex(b, 0, 32).alias("u256"), B.vec_u8_hex(b, 32).alias("vec"))


@register("unknown_tokens", f"""WITH {_TOK}, {_CREATED}, {_FULFILLED}
SELECT mint, count(*) AS count FROM (
  SELECT tx_mint AS mint FROM cy WHERE o_orderstatus != 'P' AND o_orderkey % 17 != 0 AND NOT known AND tx_mint IS NOT NULL
  UNION ALL
  SELECT tx_mint FROM fy WHERE l_linenumber != 7 AND NOT known AND tx_mint IS NOT NULL) u
GROUP BY mint ORDER BY count DESC, mint LIMIT 20""")
def q_unknown_tokens(spark, sf):
    return X.unknown_tokens(spark, _raw(spark, sf, "hex"), "hex")


@register("parse_stats", """
SELECT count(*) AS total, count_if(outcome = 'success') AS success, count_if(outcome = 'no_events') AS no_events,
       count_if(outcome = 'failed') AS failed,
       round(count_if(outcome = 'success') * 100.0 / count(*), 4) AS success_rate_pct,
       round(count_if(outcome = 'success') / (count_if(outcome != 'no_events') + 0.001), 6) AS success_ratio
FROM (SELECT CASE WHEN slot % 71 = 0 OR slot % 83 = 0 THEN 'failed' WHEN ok THEN 'success' ELSE 'no_events' END AS outcome
      FROM (SELECT o_orderkey AS slot, o_orderstatus != 'P' AND o_orderkey % 17 != 0 AS ok FROM orders
            UNION ALL SELECT l_orderkey, l_linenumber != 7 FROM lineitem) d) t""")
def q_parse_stats(spark, sf):
    """A15 + A19 over every landed line; some documents have no message, some lines are broken off."""
    root = scratch_dir(spark, "parsestats")
    R.landed_lines(R.damaged(_raw(spark, sf))).select("value").write.options(compression="gzip", **FAST).text(root)
    return X.parse_stats(X.parse_outcomes(spark, R.read_raw_transactions(spark, root)))


@register("balance_deltas", f"""WITH {_TOK}, {_CREATED}, {_FULFILLED}
SELECT * FROM (
  SELECT 'c-' || CAST(o_orderkey AS VARCHAR) AS signature, 1 AS account_index, mint_in_tx AS mint,
         CAST(-amt AS DECIMAL(38,0)) AS change FROM cy WHERE k_idx != 0
  UNION ALL SELECT 'c-' || CAST(o_orderkey AS VARCHAR), 2, mint_in_tx, CAST(amt AS DECIMAL(38,0)) FROM cy WHERE k_idx != 0
  UNION ALL SELECT 'c-' || CAST(o_orderkey AS VARCHAR), 3, mint_in_tx, CAST(floor(amt / 2) AS DECIMAL(38,0))
            FROM cy WHERE k_idx != 0 AND floor(amt / 2) != 0
  UNION ALL SELECT 'f-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR), 1, mint_in_tx,
            CAST(amt AS DECIMAL(38,0)) FROM fy WHERE k_idx != 0
  UNION ALL SELECT 'f-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR), 2, t2.tok_address,
            CAST(amt AS DECIMAL(38,0)) FROM fy JOIN tok t2 ON t2.tok_idx = (fy.k_idx + 1) % 45 WHERE fy.k_idx != 0
) d WHERE change != 0""")
def q_balance_deltas(spark, sf):
    return X.balance_deltas(_raw(spark, sf, "hex"))


@register("zip_tx_signature", """
SELECT count(*) AS requested, count_if(o_orderpriority != '5-LOW') AS fetched,
       count_if(o_orderpriority = '5-LOW') AS missing FROM orders""")
def q_zip_tx_signature(spark, sf):
    """Requested signatures vs fetched documents; those of low-priority orders are left unfetched."""
    missing = tpch.read_table(spark, sf, "orders").where("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("slot"))
    fetched = R.created_transactions(spark, sf, "hex").join(missing, "slot", "left_anti")
    return X.zip_tx_signature(tpch.signatures(spark, sf), fetched)


@register("base58_roundtrip", """
SELECT 'f-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS signature,
       CASE WHEN l_linenumber = 7 THEN 'b1d4f0a3c2e5d6f7' || substr(sha256(CAST(l_orderkey AS VARCHAR)), 1, 62)
            ELSE 'b1d4f0a3c2e5d6f7' || sha256(CAST(l_orderkey AS VARCHAR)) END AS head_hex
FROM lineitem""")
def q_base58_roundtrip(spark, sf):
    """base58 text of every fulfil instruction decodes back to its bytes."""
    raw = R.fulfilled_transactions(spark, sf, "base58")
    b = X.instruction_bytes(F.get(F.col("transaction.message.instructions"), 0)["data"], "base58")
    head = F.when(F.octet_length(b) == 39, F.lower(F.hex(b))).otherwise(F.lower(F.hex(F.substring(b, 1, 40))))
    return raw.select("signature", head.alias("head_hex"))


@register("inspect_instructions")
def q_inspect_instructions(spark, sf):
    """Per-instruction hex dump and head fields (rows-only check)."""
    return X.inspect_instructions(_raw(spark, sf, "hex"), "hex")
