"""Decode raw transactions into order events.

The decode job is narrow: per-transaction features are array expressions
inside the row (``filter``/``transform``/``array_max``), instructions are
``posexplode``d once, and the only join is the broadcast token lookup (a
fixed 45-row dimension).  There is no shuffle, so it scales linearly with
the landed documents.  The single Python step is base58 (Arrow-batched).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwise.functions.base58 import base58_decode, base58_decode_all
from fillwise.functions.binary import bytes_at, hex_at, le_bytes_hex, u_le, u_le_long
from fillwise.functions.core import epoch_ntz
from fillwise.schema import (CHAINS, CREATE_ORDER_DISCRIMINATOR_HEX, DESTINATION_PROGRAM_ID,
                             MIN_SOL_TRANSFER_LAMPORTS, NATIVE_SOL_MINT, SOLANA_CHAIN_ID, SOURCE_PROGRAM_ID,
                             STABLECOIN_SYMBOLS, tokens_df)
from fillwise.sources.rawtx import CORRUPT

PROGRAM_DATA = "Program data:"
ORDER_ID_PATTERN = r"(?i)order[_\s]?id[:\s]+([a-f0-9]{64})"
ZERO_ID = "0" * 64
DEST_CHAIN_IDS = [cid for cid, _ in CHAINS if cid != SOLANA_CHAIN_ID]


# ---------------------------------------------------------------------------
# per-transaction features
# ---------------------------------------------------------------------------
def ok_transactions(raw: DataFrame) -> DataFrame:
    """Drop documents without ``meta`` or with ``meta.err``."""
    return raw.where(F.col("meta").isNotNull() & F.col("meta.err").isNull())


def is_well_formed() -> Column:
    """Whether a document has a message; one without it cannot be parsed (A15 ``failed``)."""
    return F.col("transaction.message").isNotNull()


def program_data_payloads(logs: Column) -> Column:
    """Decoded ``Program data:`` payloads in log order (malformed base64 → NULL, kept in place)."""
    data_logs = F.filter(logs, lambda l: l.startswith(PROGRAM_DATA))
    return F.transform(data_logs, lambda l: F.try_to_binary(F.trim(F.substr(l, F.lit(len(PROGRAM_DATA) + 1))),
                                                            F.lit("base64")))


def order_id_from_logs(logs: Column, payloads: Column | None = None) -> Column:
    """First payload ≥ 40 bytes whose bytes 8..40 are not all zero; else the text pattern."""
    payloads = program_data_payloads(logs) if payloads is None else payloads
    ids = F.transform(payloads,
                      lambda p: F.when(F.octet_length(p) >= 40, F.lower(F.hex(F.substring(p, 9, 32)))))
    from_payload = F.get(F.filter(ids, lambda x: x.isNotNull() & (x != ZERO_ID)), 0)
    texts = F.transform(logs, lambda l: F.regexp_extract(l, ORDER_ID_PATTERN, 1))
    from_text = F.lower(F.get(F.filter(texts, lambda x: x != ""), 0))
    return F.coalesce(from_payload, from_text)


def dest_chain_from_logs(logs: Column, payloads: Column | None = None) -> Column:
    """D6 + W4: in the 2nd and later payloads, the first known non-Solana chain id at any byte offset.

    Offsets run 0 … len-9 (the last full 8-byte window is not read).  One
    regular expression over the payload's hex text finds the earliest
    byte-aligned window equal to a known id's little-endian bytes
    (``^(?:..)*?`` keeps byte alignment and takes the earliest offset; the
    trailing ``..`` demands a byte after the window).  Solana's id is not in
    the pattern, so it is skipped as in the source rule.
    """
    ids = {le_bytes_hex(cid, 8).upper(): cid for cid in DEST_CHAIN_IDS}
    pattern = "^(?:..)*?(" + "|".join(ids) + ")(?:..)"
    lookup = F.create_map(*[x for h, cid in ids.items() for x in (F.lit(h), F.lit(cid).cast("bigint"))])
    payloads = program_data_payloads(logs) if payloads is None else payloads
    later = F.slice(payloads, F.lit(2), F.greatest(F.size(payloads) - 1, F.lit(0)))
    hits = F.transform(F.filter(later, lambda p: p.isNotNull()),
                       lambda p: F.regexp_extract(F.hex(p), pattern, 1))
    first = F.get(F.filter(hits, lambda h: h != ""), 0)
    return F.try_element_at(lookup, first)


def first_signer(keys: Column) -> Column:
    """Pubkey of the first account flagged as signer."""
    return F.get(F.filter(keys, lambda k: F.coalesce(k["signer"], F.lit(False))), 0)["pubkey"]


def primary_transfer(meta: Column) -> Column:
    """W3 + J5: the transaction's main transfer as ``struct(mint, amount, owner)``.

    Largest strictly positive token-balance gain (post − pre on
    ``(accountIndex, mint)``, missing pre = 0), earliest wins ties; else the
    largest SOL outflow above the dust bound, as wrapped SOL.
    """
    pre = F.coalesce(meta["preTokenBalances"], F.array())
    post = F.coalesce(meta["postTokenBalances"], F.array())

    def gain(b: Column, i: Column) -> Column:
        same = F.filter(pre, lambda p: (p["accountIndex"] == b["accountIndex"]) & (p["mint"] == b["mint"]))
        before = F.try_element_at(same, F.lit(-1))["uiTokenAmount"]["amount"].try_cast("decimal(38,0)")
        after = b["uiTokenAmount"]["amount"].try_cast("decimal(38,0)")
        return F.struct((after - F.coalesce(before, F.lit(0).cast("decimal(38,0)"))).alias("change"),
                        (-i).alias("neg_pos"), b["mint"].alias("mint"),
                        F.coalesce(b["owner"], F.lit("")).alias("owner"))

    gains = F.filter(F.transform(post, gain), lambda g: g["change"] > 0)
    best = F.array_max(gains)
    pre_sol = F.coalesce(meta["preBalances"], F.array().cast("array<bigint>"))
    post_sol = F.coalesce(meta["postBalances"], F.array().cast("array<bigint>"))
    outflows = F.transform(pre_sol, lambda a, i: F.struct((a - F.get(post_sol, i)).alias("change"),
                                                          (-i).alias("neg_pos")))
    sol = F.array_max(F.filter(outflows, lambda g: g["change"] > MIN_SOL_TRANSFER_LAMPORTS))

    # Bind both candidates once (a one-element array's lambda variable): the
    # choice below reads each several times, and higher-order functions get
    # no common-subexpression elimination.
    def choose(c: Column) -> Column:
        b, s = c["best"], c["sol"]
        return (F.when(b.isNotNull(), F.struct(b["mint"].alias("mint"), b["change"].alias("amount"),
                                               b["owner"].alias("owner")))
                .when(s.isNotNull(), F.struct(F.lit(NATIVE_SOL_MINT).alias("mint"),
                                              s["change"].cast("decimal(38,0)").alias("amount"),
                                              F.lit("").alias("owner"))))

    return F.get(F.transform(F.array(F.struct(best.alias("best"), sol.alias("sol"))), choose), 0)


def all_instructions(tx: Column) -> Column:
    """Top-level instructions, then every inner (CPI) instruction, in order."""
    top = F.coalesce(tx["transaction"]["message"]["instructions"], F.array())
    inner = F.flatten(F.transform(F.coalesce(tx["meta"]["innerInstructions"], F.array()),
                                  lambda g: F.coalesce(g["instructions"], F.array())))
    return F.concat(top, inner)


def tx_features(raw: DataFrame, logs_kept: bool = False, aside: Sequence[str] = ()) -> DataFrame:
    """One row per transaction with the decoded per-transaction facts (and its logs, if ``logs_kept``; and the columns ``aside``).

    Logs are base64-decoded once (``_payloads``) and reused by the order-id
    and chain-id readers.
    """
    logs = F.coalesce(F.col("meta.logMessages"), F.array().cast("array<string>"))
    tx = F.struct(F.col("transaction"), F.col("meta"))
    carried = [c for c in ("ingest_time", CORRUPT, *aside) if c in raw.columns]
    staged = raw.select(
        "signature", "slot", "blockTime",
        (F.col("meta").isNotNull() & F.col("meta.err").isNull()).alias("tx_ok"),
        is_well_formed().alias("well_formed"), *carried,
        logs.alias("_logs"),
        program_data_payloads(logs).alias("_payloads"),
        first_signer(F.col("transaction.message.accountKeys")).alias("signer"),
        primary_transfer(F.col("meta")).alias("transfer"),
        all_instructions(tx).alias("ixs"),
    )
    return staged.select(
        "signature", "slot", "blockTime", "tx_ok", "well_formed", *carried,
        order_id_from_logs(F.col("_logs"), F.col("_payloads")).alias("order_id"),
        dest_chain_from_logs(F.col("_logs"), F.col("_payloads")).alias("dest_chain"),
        "signer", "transfer", "ixs", *(["_logs"] if logs_kept else []),
    )


# ---------------------------------------------------------------------------
# token registry (J2, J3) and USD value
# ---------------------------------------------------------------------------
def resolve_tokens(df: DataFrame, spark: SparkSession, mint_col: str = "mint") -> DataFrame:
    """Exact Solana mint first, then the lower-cased EVM address (two broadcast lookups).

    Adds ``symbol``, ``decimals``, ``estimated_price`` and ``is_known``.
    """
    toks = tokens_df(spark)
    sol = F.broadcast(toks.where(F.col("family") == "solana").select(
        F.col("address").alias("_sa"), F.struct("symbol", "decimals", "estimated_price").alias("_st")))
    evm = F.broadcast(toks.where(F.col("family") == "evm").select(
        F.col("address").alias("_ea"), F.struct("symbol", "decimals", "estimated_price").alias("_et")))
    out = (df.join(sol, F.col(mint_col) == F.col("_sa"), "left")
             .join(evm, F.lower(F.col(mint_col)) == F.col("_ea"), "left"))
    tok = F.coalesce(F.col("_st"), F.col("_et"))
    return (out.withColumn("_tok", tok)
            .withColumn("symbol", F.col("_tok.symbol"))
            .withColumn("decimals", F.col("_tok.decimals"))
            .withColumn("estimated_price", F.col("_tok.estimated_price"))
            .withColumn("is_known", F.col("_tok").isNotNull())
            .drop("_sa", "_st", "_ea", "_et", "_tok"))


def usd_value(amount: Column, decimals: Column, symbol: Column, price: Column, known: Column) -> Column:
    """``amount / 10^decimals × price``; stablecoins without a price count 1; unknown → NULL."""
    p = F.coalesce(price, F.when(symbol.isin(*STABLECOIN_SYMBOLS), F.lit(1.0)))
    return F.when(known & p.isNotNull(), amount.cast("double") / F.pow(F.lit(10.0), decimals) * p)


# ---------------------------------------------------------------------------
# instruction decoders
# ---------------------------------------------------------------------------
def instruction_bytes(data: Column, encoding: str = "base58") -> Column:
    """Instruction ``data`` text → BINARY."""
    if encoding == "base58":
        return base58_decode(data)
    if encoding == "base64":
        return F.try_to_binary(data, F.lit("base64"))
    return F.try_to_binary(data, F.lit("hex"))


def all_instruction_bytes(data: Column, encoding: str = "base58") -> Column:
    """D9 on an array of instruction ``data`` texts."""
    if encoding == "base58":
        return base58_decode_all(data)
    return F.transform(data, lambda d: instruction_bytes(d, encoding))


def is_create(b: Column) -> Column:
    """D1 gate: ≥ 16 bytes and the create-order discriminator."""
    return (F.octet_length(b) >= 16) & (F.upper(F.hex(F.substring(b, 1, 8))) == CREATE_ORDER_DISCRIMINATOR_HEX)


def is_fulfill(b: Column) -> Column:
    """D2 gate: ≥ 40 bytes (the fulfil discriminator is not checked)."""
    return F.octet_length(b) >= 40


def _address_field(b: Column, off: Column, len_ok_only: bool = False):
    """One ``u32 len + bytes`` address; returns (value, next_offset).

    Lengths other than 20/32, or too few bytes, give NULL; the cursor still
    moves past the 4-byte length whenever it could be read.
    """
    has_len = F.octet_length(b) - off >= 4
    n = u_le_long(b, off, 4)
    fits = has_len & n.isin(20, 32) & (F.octet_length(b) - off - 4 >= n)
    raw = F.lower(F.hex(F.substring(b, off + 5, n)))
    value = F.when(fits, F.when(n == 20, F.concat(F.lit("0x"), raw)).otherwise(raw))
    nxt = F.when(fits, off + 4 + n).when(has_len, off + 4).otherwise(off)
    return value, nxt


CREATE_FIELDS = ["give_token", "take_token", "receiver_dst", "order_authority_dst"]


def is_create_head(b: Column) -> Column:
    """D3 gate: the 48-byte fixed head is present and starts with the create discriminator.

    Filter on this (cheap) gate *before* ``with_create_full``: a filter on the
    decoded struct would be pushed below the staged projections and inline
    every cursor step again.
    """
    return (F.octet_length(b) >= 48) & (F.upper(F.hex(F.substring(b, 1, 8))) == CREATE_ORDER_DISCRIMINATOR_HEX)


def with_create_full(df: DataFrame, bytes_col: str = "bytes", out: str = "create") -> DataFrame:
    """D3: the create-order head and its cursor-read address fields as struct ``out`` (NULL if not a create).

    Each field's start depends on the previous field's outcome, so every
    cursor position is projected as its own column first; built as one
    expression, each offset would embed the previous one several times and
    the expression would grow exponentially with the field count.
    """
    b = F.col(bytes_col)
    df = df.withColumn("_o0", F.lit(48))
    for i, _ in enumerate(CREATE_FIELDS):
        value, nxt = _address_field(b, F.col(f"_o{i}"))
        df = df.withColumn(f"_v{i}", value).withColumn(f"_o{i + 1}", nxt)
    last = F.col(f"_o{len(CREATE_FIELDS)}")
    has_tag = F.octet_length(b) - last >= 1
    opt_val, _ = _address_field(b, last + 1)
    allowed = F.when(has_tag & (hex_at(b, last, 1) != "00"), opt_val)
    df = df.withColumn(out, F.when(is_create_head(b), F.struct(
        F.lower(F.hex(F.substring(b, 1, 8))).alias("discriminator"),
        u_le(b, 8, 8).alias("give_amount"),
        hex_at(b, 16, 32).alias("maker_src_field"),
        *[F.col(f"_v{i}").alias(n) for i, n in enumerate(CREATE_FIELDS)],
        allowed.alias("allowed_taker_dst"),
        F.lower(F.hex(b)).alias("raw_data_hex"),
    )))
    temps = [f"_o{i}" for i in range(len(CREATE_FIELDS) + 1)] + [f"_v{i}" for i in range(len(CREATE_FIELDS))]
    return df.drop(*temps)


# ---------------------------------------------------------------------------
# the decode job (D8) and its outcome counters
# ---------------------------------------------------------------------------
EVENT_OUT = ["order_id", "event_type", "signature", "slot", "block_time", "maker", "give_token_address",
             "give_token_symbol", "give_amount", "give_amount_usd", "give_chain_id", "take_token_address",
             "take_token_symbol", "take_amount", "take_amount_usd", "take_chain_id", "receiver", "taker",
             "fulfilled_amount", "fulfilled_amount_usd"]


def decoded_instructions(raw: DataFrame, encoding: str = "base58", logs_kept: bool = False,
                         aside: Sequence[str] = ()) -> DataFrame:
    """One row per program instruction of a successful transaction, with its bytes and tx facts.

    A document without a message cannot be parsed, so its inner instructions
    don't count either (A15 ``failed``).  Documents without an instruction of either program are dropped before
    any log or balance is looked at.  Documents whose first column of ``aside`` is set give one row without an instruction.
    """
    ours = F.exists(all_instructions(F.struct(F.col("transaction"), F.col("meta"))),
                    lambda i: i["programId"].isin(SOURCE_PROGRAM_ID, DESTINATION_PROGRAM_ID) & i["data"].isNotNull())
    if aside:
        out = F.col(aside[0]).isNotNull()
        good = F.col("meta").isNotNull() & F.col("meta.err").isNull() & is_well_formed() & ours
        feats = tx_features(raw.where(out | good), logs_kept, aside)
        none = F.array(F.lit(None).cast(feats.schema["ixs"].dataType.elementType))
        feats = feats.withColumn("ixs", F.when(out, none).otherwise(F.col("ixs")))
    else:
        out = F.lit(False)
        feats = tx_features(ok_transactions(raw).where(is_well_formed() & ours), logs_kept)
    ix = feats.select("*", F.posexplode("ixs").alias("ix_pos", "ix")).drop("ixs")
    ix = ix.where(out | (F.col("ix.programId").isin(SOURCE_PROGRAM_ID, DESTINATION_PROGRAM_ID)
                         & F.col("ix.data").isNotNull()))
    return ix.withColumn("bytes", instruction_bytes(F.col("ix.data"), encoding))


def decode_events(spark: SparkSession, raw: DataFrame, encoding: str = "base58", aside: Sequence[str] = ()) -> DataFrame:
    """Raw documents → order events (created from the source program, fulfilled from the destination).

    Documents with an ``ingest_time`` (when their file was landed) give it to
    events without a block time, and as ``created_at`` and version, so that a
    replay decodes the same rows; without it the present time is taken.

    ``aside``: columns of ``raw`` that are carried along.  A document whose first one is set is not decoded and gives one
    row, so that what is set aside and what is decoded come from one pass over the documents.
    """
    ix = decoded_instructions(raw, encoding, aside=aside)
    src = F.col("ix.programId") == SOURCE_PROGRAM_ID
    kind = (F.when(src & is_create(F.col("bytes")), F.lit("created"))
            .when(~src & is_fulfill(F.col("bytes")), F.lit("fulfilled")))
    # One non-splittable predicate over a per-instruction column: Catalyst can
    # then not push ``order_id IS NOT NULL`` below the explode, where it would
    # inline (and evaluate twice) the whole log-scanning expression.
    keep = F.when(F.col("event_type").isNotNull(), F.col("order_id").isNotNull()).otherwise(F.lit(False))
    if aside:
        keep = F.when(F.col(aside[0]).isNotNull(), F.lit(True)).otherwise(keep)
    ev = ix.withColumn("event_type", kind).where(keep)
    ev = resolve_tokens(ev.withColumn("mint", F.col("transfer.mint")), spark)
    created = F.col("event_type") == "created"
    give_amount = u_le(F.col("bytes"), 8, 8)
    take_amount = F.floor(F.col("transfer.amount")).cast("decimal(38,0)")
    dec = F.coalesce(F.col("decimals"), F.lit(6))
    usd_give = usd_value(give_amount, dec, F.col("symbol"), F.col("estimated_price"), F.col("is_known"))
    usd_take = usd_value(take_amount, dec, F.col("symbol"), F.col("estimated_price"), F.col("is_known"))
    solana = F.lit(SOLANA_CHAIN_ID).cast("bigint")
    null_s, null_d, null_a = (F.lit(None).cast("string"), F.lit(None).cast("double"),
                              F.lit(None).cast("decimal(38,0)"))
    # Documents may carry the time they were landed, which a replay finds again; otherwise it is now.
    landed = "ingest_time" in raw.columns
    ingest_time = (F.col("ingest_time") if landed else F.current_timestamp()).cast("timestamp_ntz")
    # blockTime is UTC epoch seconds; add it to the NTZ epoch (no session-zone conversion).
    block_time = F.timestamp_add("SECOND", F.col("blockTime"), epoch_ntz())
    return ev.select(
        "order_id", "event_type", "signature", "slot",
        F.coalesce(block_time, ingest_time).alias("block_time"),
        F.when(created, F.col("signer")).alias("maker"),
        F.when(created, F.col("transfer.mint")).alias("give_token_address"),
        F.when(created, F.col("symbol")).alias("give_token_symbol"),
        F.when(created, give_amount).alias("give_amount"),
        F.when(created, usd_give).alias("give_amount_usd"),
        F.when(created, solana).alias("give_chain_id"),
        null_s.alias("take_token_address"),
        F.when(~created, F.col("symbol")).alias("take_token_symbol"),
        F.when(~created, take_amount).alias("take_amount"),
        F.when(~created, usd_take).alias("take_amount_usd"),
        F.when(created, F.col("dest_chain")).otherwise(solana).alias("take_chain_id"),
        null_s.alias("receiver"),
        F.when(~created, F.col("signer")).alias("taker"),
        null_a.alias("fulfilled_amount"), null_d.alias("fulfilled_amount_usd"),
        "ix_pos", *([ingest_time.alias("created_at"), F.unix_timestamp("ingest_time").alias("_version")] if landed else []), *aside,
    )


def parse_outcomes(spark: SparkSession, raw: DataFrame, encoding: str = "base58") -> DataFrame:
    """A15 per document: 'success' (≥1 event), 'no_events', or 'failed' (no message, or a line that is no document).

    The events are counted inside the document, before anything is exploded:
    nothing is shuffled.  ``raw`` may carry the lines of ``RAW_LINES``.
    """
    if CORRUPT not in raw.columns:
        raw = raw.withColumn(CORRUPT, F.lit(None).cast("string"))
    ours = lambda i: i["programId"].isin(SOURCE_PROGRAM_ID, DESTINATION_PROGRAM_ID) & i["data"].isNotNull()
    d = tx_features(raw).withColumn("ixs", F.filter("ixs", ours))
    d = d.withColumn("ix_bytes", all_instruction_bytes(F.transform("ixs", lambda i: i["data"]), encoding))
    each = F.zip_with("ixs", "ix_bytes", lambda i, b: F.coalesce(
        F.when(i["programId"] == SOURCE_PROGRAM_ID, is_create(b)).otherwise(is_fulfill(b)), F.lit(False)))
    events = F.when(F.col("tx_ok") & F.col("order_id").isNotNull(), F.size(F.filter(each, lambda e: e))).otherwise(0).cast("bigint")
    line = F.col(CORRUPT).isNull()                      # what a broken line gave before it broke off does not count
    known = d.withColumn("well_formed", F.col("well_formed") & line).select(
        F.when(line, F.col("signature")).alias("signature"), F.when(line, F.col("slot")).alias("slot"),
        F.when(F.col("well_formed"), events).otherwise(0).cast("bigint").alias("events"), "well_formed")
    return known.select("signature", "slot", "events", F.when(~F.col("well_formed"), "failed").when(F.col("events") > 0, "success")
                        .otherwise("no_events").alias("outcome"))


def parse_stats(outcomes: DataFrame) -> DataFrame:
    """A15 + A19: totals per outcome, success rate and the monitoring success ratio."""
    agg = outcomes.agg(F.count(F.lit(1)).alias("total"),
                       F.count_if(F.col("outcome") == "success").alias("success"),
                       F.count_if(F.col("outcome") == "no_events").alias("no_events"),
                       F.count_if(F.col("outcome") == "failed").alias("failed"))
    return agg.select("*",
                      F.round(F.try_divide(F.col("success") * 100.0, F.col("total")), 4).alias("success_rate_pct"),
                      F.round(F.col("success") / (F.col("success") + F.col("failed") + F.lit(0.001)), 6)
                       .alias("success_ratio"))


def unknown_tokens(spark: SparkSession, raw: DataFrame, encoding: str = "base58",
                   limit: int = 20) -> DataFrame:
    """Mints of primary transfers that the registry does not know, with occurrence counts."""
    ix = decoded_instructions(raw, encoding)
    src = F.col("ix.programId") == SOURCE_PROGRAM_ID
    decodes = F.when(src, is_create(F.col("bytes"))).otherwise(is_fulfill(F.col("bytes")))
    ev = ix.where(F.when(decodes, F.col("order_id").isNotNull() & F.col("transfer").isNotNull())
                  .otherwise(F.lit(False)))
    known = tokens_df(spark)
    sol = F.broadcast(known.where(F.col("family") == "solana").select(F.col("address").alias("mint")))
    evm = F.broadcast(known.where(F.col("family") == "evm").select(F.col("address").alias("lmint")))
    mints = ev.select(F.col("transfer.mint").alias("mint")).withColumn("lmint", F.lower("mint"))
    unknown = mints.join(sol, "mint", "left_anti").join(evm, "lmint", "left_anti")
    return (unknown.groupBy("mint").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc("mint")).limit(limit))


def balance_deltas(raw: DataFrame) -> DataFrame:
    """J5 (listing form): every non-zero token balance change per transaction."""
    pre = F.coalesce(F.col("meta.preTokenBalances"), F.array())
    post = F.coalesce(F.col("meta.postTokenBalances"), F.array())

    def delta(b: Column) -> Column:
        same = F.filter(pre, lambda p: (p["accountIndex"] == b["accountIndex"]) & (p["mint"] == b["mint"]))
        before = F.try_element_at(same, F.lit(-1))["uiTokenAmount"]["amount"].try_cast("decimal(38,0)")
        after = b["uiTokenAmount"]["amount"].try_cast("decimal(38,0)")
        return F.struct(b["accountIndex"].alias("account_index"), b["mint"].alias("mint"),
                        (after - F.coalesce(before, F.lit(0).cast("decimal(38,0)"))).alias("change"))

    return (raw.select("signature", F.explode(F.filter(F.transform(post, delta), lambda d: d["change"] != 0))
                       .alias("d"))
            .select("signature", "d.account_index", "d.mint", "d.change"))


def inspect_instructions(raw: DataFrame, encoding: str = "base58") -> DataFrame:
    """Per program instruction — length, hex dump of the first 200 bytes, head fields, matching logs."""
    ix = decoded_instructions(raw, encoding, logs_kept=True)
    b, logs = F.col("bytes"), F.col("_logs")
    return ix.select(
        "signature", "ix_pos", F.col("ix.programId").alias("program_id"),
        F.octet_length(b).alias("data_len"),
        F.lower(F.hex(F.substring(b, 1, 200))).alias("hex_head"),
        hex_at(b, 0, 8).alias("discriminator"),
        u_le(b, 8, 8).alias("u64_at_8"),
        hex_at(b, 16, 32).alias("bytes_16_48"),
        F.filter(logs, lambda l: l.startswith(PROGRAM_DATA) | F.lower(l).contains("order")).alias("matching_logs"),
    )


def zip_tx_signature(sigs: DataFrame, raw: DataFrame) -> DataFrame:
    """Signatures ⟕ fetched documents; a missing document counts as not fetched."""
    got = raw.select("signature", F.lit(True).alias("_fetched")).dropDuplicates(["signature"])
    j = sigs.join(got, "signature", "left")
    return j.agg(F.count(F.lit(1)).alias("requested"),
                 F.count_if(F.col("_fetched").isNotNull()).alias("fetched"),
                 F.count_if(F.col("_fetched").isNull()).alias("missing"))
