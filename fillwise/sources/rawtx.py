"""Land raw transaction documents (S1) — and build them from the driver tables.

``read_raw_transactions`` is the production source: landed JSON documents
read with a fixed schema (no inference) in PERMISSIVE mode.

``raw_transactions_from_tpch`` builds documents of the same shape from the
TPC-H tables so the decode job can be checked end to end: every order
becomes one source-program transaction and every lineitem one
destination-program transaction, with instruction bytes, ``Program data:``
logs, token and SOL balances laid out the way the decoder expects.  The
expected decode output is then a plain SQL projection of the source
columns (see ``fillwise.plans.q_decode``).  Pure column expressions except
the base58 encoding of instruction data (the wire format), which is the
Arrow-batched UDF in ``functions.base58``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillwise.functions.base58 import base58_encode
from fillwise.functions.binary import le_hex_of
from fillwise.functions.core import epoch_ntz
from fillwise.schema import (CREATE_ORDER_DISCRIMINATOR_HEX, DESTINATION_PROGRAM_ID, EVM_TOKENS, RAW_TX,
                             SOLANA_TOKENS, SOURCE_PROGRAM_ID)
from fillwise.sources.tpch import CHAIN_ID_CYCLE, read_table

N_TOKENS = len(SOLANA_TOKENS) + len(EVM_TOKENS)      # 45 known mints; index 45 = unknown
TOKEN_CYCLE = N_TOKENS + 1
EVENT_DISC_HEX = "e445a52e51cb9a1d"                   # any 8 bytes: log-event header
FILL_DISC_HEX = "b1d4f0a3c2e5d6f7"                    # any 8 bytes: fulfil instruction header
ERR_JSON = '{"InstructionError":[0,{"Custom":6001}]}'
LAMPORTS_BASE = 1_000_000_000
FEE = 5000
CORRUPT = "_corrupt_record"
RAW_LINES = T.StructType(RAW_TX.fields + [T.StructField(CORRUPT, T.StringType(), True)])


def read_raw_transactions(spark: SparkSession, path: str) -> DataFrame:
    """S1 ``scan_raw_tx``: landed JSON documents with a fixed schema.

    The text of a line that is no such document is kept in
    ``_corrupt_record``; ``corrupt_documents`` takes those lines.
    """
    return (spark.read.schema(RAW_LINES).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).json(path))


def corrupt_documents(raw: DataFrame) -> DataFrame:
    """The malformed lines of ``read_raw_transactions``, for a quarantine table."""
    return raw.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def token_index(spark: SparkSession) -> DataFrame:
    """Known mints numbered 0..44 (0 = native SOL); small and fixed, safe to broadcast."""
    rows = ([(i, a, "solana", s, d, p) for i, (a, s, d, p) in enumerate(SOLANA_TOKENS)]
            + [(len(SOLANA_TOKENS) + i, a, "evm", s, d, p) for i, (a, s, d, p) in enumerate(EVM_TOKENS)])
    return spark.createDataFrame(
        rows, "tok_idx INT, tok_address STRING, tok_family STRING, tok_symbol STRING, tok_decimals INT, "
              "tok_price DOUBLE")


def _mint_in_tx(k: Column) -> Column:
    """The mint text as it appears in the balances (odd keys upper-case EVM addresses)."""
    unknown = F.concat(F.lit("UNKNOWN"), (k % 5).cast("string"))
    evm_upper = (F.col("tok_family") == "evm") & (k % 2 == 1)
    return (F.when(F.col("tok_address").isNull(), unknown)
            .when(evm_upper, F.upper(F.col("tok_address")))
            .otherwise(F.col("tok_address")))


def _balance(idx: int, mint: Column, owner: Column, amount: Column, decimals: Column) -> Column:
    return F.struct(F.lit(idx).alias("accountIndex"), mint.alias("mint"), owner.alias("owner"),
                    F.struct(amount.cast("string").alias("amount"), decimals.alias("decimals"))
                    .alias("uiTokenAmount"))


def _b64_log(hex_text: Column) -> Column:
    return F.concat(F.lit("Program data: "), F.base64(F.unhex(hex_text)))


def _encode(hex_text: Column, encoding: str) -> Column:
    if encoding == "base58":
        return base58_encode(F.unhex(hex_text))
    if encoding == "base64":
        return F.base64(F.unhex(hex_text))
    return F.lower(hex_text)


def _sha(text: Column) -> Column:
    return F.sha2(text, 256)


def _chain_cycle(k: Column) -> Column:
    ids = F.array(*[F.lit(v).cast("bigint") for v in CHAIN_ID_CYCLE])
    return F.get(ids, (k % len(CHAIN_ID_CYCLE)).cast("int"))


def _balances(k: Column, amount: Column, party: Column, sol_path: Column, token_path_pre, token_path_post):
    empty_tb = F.array().cast("array<struct<accountIndex:int,mint:string,owner:string,"
                              "uiTokenAmount:struct<amount:string,decimals:int>>>")
    pre_tb = F.when(sol_path, empty_tb).otherwise(token_path_pre)
    post_tb = F.when(sol_path, empty_tb).otherwise(token_path_post)
    base = F.lit(LAMPORTS_BASE).cast("bigint")
    pre_sol = F.when(sol_path, F.array(amount + FEE + base, base)).otherwise(F.array(base * 2, base))
    post_sol = F.when(sol_path, F.array(base, base + amount)).otherwise(F.array(base * 2 - FEE, base))
    return pre_tb, post_tb, pre_sol, post_sol


def _by_slot(rows: DataFrame, files: int | None, slot: Column) -> DataFrame:
    """Narrow source rows dealt by slot into ``files`` pieces, before the documents are built of them.

    Dealing the documents instead ships them through the shuffle and builds each twice: once to draw the bounds.
    """
    return rows.repartitionByRange(files, slot) if files else rows


def created_transactions(spark: SparkSession, sf_dir: str, encoding: str = "base58", files: int | None = None) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    k = F.col("o_orderkey")
    amount = (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint")
    df = (_by_slot(o.join(c, o.o_custkey == c.c_custkey, "left"), files, k)
          .withColumn("tok_idx", (k % TOKEN_CYCLE).cast("int"))
          .join(F.broadcast(token_index(spark)), "tok_idx", "left")
          .withColumn("_amt", amount)
          .withColumn("_mint", _mint_in_tx(k))
          .withColumn("_dec", F.coalesce(F.col("tok_decimals"), F.lit(6))))
    sha_k = _sha(k.cast("string"))
    disc = F.when(k % 17 == 0, F.lit("0000000000000000")).otherwise(F.lit(CREATE_ORDER_DISCRIMINATOR_HEX.lower()))
    give_tok = F.when(F.col("tok_family") == "evm",
                      F.concat(F.lit("14000000"), F.substring(F.col("tok_address"), 3, 40)))\
                .otherwise(F.concat(F.lit("20000000"), _sha(F.col("_mint"))))
    tail = F.concat(
        F.lit("14000000"), F.substring(_sha(F.concat(F.lit("t"), k.cast("string"))), 1, 40),
        F.lit("14000000"), F.substring(_sha(F.concat(F.lit("r"), k.cast("string"))), 1, 40),
        F.lit("20000000"), _sha(F.concat(F.lit("a"), k.cast("string"))),
        F.when(k % 3 == 0, F.lit("00")).otherwise(
            F.concat(F.lit("0114000000"), F.substring(_sha(F.concat(F.lit("q"), k.cast("string"))), 1, 40))))
    data_hex = F.concat(disc, le_hex_of(F.col("_amt"), 8), _sha(F.col("c_name")), give_tok,
                        F.when(k % 11 == 0, F.lit("19000000")).otherwise(tail))
    order_payload = F.when(k % 13 == 0, F.concat(F.lit(EVENT_DISC_HEX), F.substring(sha_k, 1, 40)))\
                     .otherwise(F.concat(F.lit(EVENT_DISC_HEX), sha_k))
    chain = _chain_cycle(k)
    # 8 + 24 bytes: too short to be read as an order-id payload (< 40 bytes).
    chain_payload = F.when(chain.isNotNull(), F.concat(
        le_hex_of(chain, 8), F.substring(_sha(F.concat(F.lit("x"), k.cast("string"))), 1, 48)))
    logs = F.filter(F.array(
        F.lit(f"Program {SOURCE_PROGRAM_ID} invoke [1]"),
        _b64_log(order_payload),
        F.when(chain_payload.isNotNull(), _b64_log(chain_payload)),
        F.concat(F.lit("Program log: Order ID: "), F.upper(sha_k)),
        F.lit(f"Program {SOURCE_PROGRAM_ID} success"),
    ), lambda x: x.isNotNull())
    ix = F.struct(F.lit(SOURCE_PROGRAM_ID).alias("programId"), _encode(data_hex, encoding).alias("data"))
    other = F.struct(F.lit("ComputeBudget111111111111111111111111111111").alias("programId"),
                     F.lit("K1FDJ7").alias("data"))
    nested = k % 5 == 0
    top = F.when(nested, F.array(other)).otherwise(F.array(ix))
    inner = F.when(nested, F.array(F.struct(F.array(ix).alias("instructions"))))\
             .otherwise(F.array().cast("array<struct<instructions:array<struct<programId:string,data:string>>>>"))
    signer = F.struct(F.col("c_name").alias("pubkey"), F.lit(True).alias("signer"))
    escrow = F.struct(F.lit("escrow").alias("pubkey"), F.lit(False).alias("signer"))
    keys = F.when(k % 4 == 0, F.array(escrow, signer)).otherwise(F.array(signer, escrow))
    m, d, a = F.col("_mint"), F.col("_dec"), F.col("_amt")
    pre_tb = F.array(_balance(1, m, F.col("c_name"), a + 1000, d), _balance(2, m, F.lit("escrow"), F.lit(500), d))
    post_tb = F.array(_balance(1, m, F.col("c_name"), F.lit(1000), d),
                      _balance(2, m, F.lit("escrow"), a + 500, d),
                      _balance(3, m, F.lit("fee"), F.floor(a / 2), d))
    pre_tb, post_tb, pre_sol, post_sol = _balances(k, a, F.col("c_name"), F.col("tok_idx") == 0, pre_tb, post_tb)
    return df.select(
        F.concat(F.lit("c-"), k.cast("string")).alias("signature"),
        k.alias("slot"),
        F.timestamp_diff("SECOND", epoch_ntz(), F.col("o_orderdate")).alias("blockTime"),
        F.struct(F.when(F.col("o_orderstatus") == "P", F.lit(ERR_JSON)).alias("err"),
                 logs.alias("logMessages"), inner.alias("innerInstructions"),
                 pre_tb.alias("preTokenBalances"), post_tb.alias("postTokenBalances"),
                 pre_sol.alias("preBalances"), post_sol.alias("postBalances")).alias("meta"),
        F.struct(F.struct(top.alias("instructions"), keys.alias("accountKeys")).alias("message"))
         .alias("transaction"),
    )


def fulfilled_transactions(spark: SparkSession, sf_dir: str, encoding: str = "base58", files: int | None = None) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    k = F.col("l_orderkey")
    amount = (F.col("l_extendedprice").cast("decimal(18,2)") * 100).cast("bigint")
    toks = token_index(spark)
    other = toks.select(F.col("tok_idx").alias("o_idx"), F.col("tok_address").alias("o_address"))
    df = (_by_slot(li.join(s, li.l_suppkey == s.s_suppkey, "left"), files, k)
          .withColumn("tok_idx", (F.col("l_partkey") % TOKEN_CYCLE).cast("int"))
          .join(F.broadcast(toks), "tok_idx", "left")
          .withColumn("o_idx", ((F.col("tok_idx") + 1) % N_TOKENS).cast("int"))
          .join(F.broadcast(other), "o_idx", "left")
          .withColumn("_amt", amount)
          .withColumn("_mint", _mint_in_tx(k))
          .withColumn("_dec", F.coalesce(F.col("tok_decimals"), F.lit(6))))
    sha_k = _sha(k.cast("string"))
    data_hex = F.when(F.col("l_linenumber") == 7, F.concat(F.lit(FILL_DISC_HEX), F.substring(sha_k, 1, 62)))\
                .otherwise(F.concat(F.lit(FILL_DISC_HEX), sha_k, le_hex_of(F.col("_amt"), 8)))
    logs = F.array(F.lit(f"Program {DESTINATION_PROGRAM_ID} invoke [1]"),
                   _b64_log(F.concat(F.lit(EVENT_DISC_HEX), sha_k)),
                   F.lit(f"Program {DESTINATION_PROGRAM_ID} success"))
    ix = F.struct(F.lit(DESTINATION_PROGRAM_ID).alias("programId"), _encode(data_hex, encoding).alias("data"))
    keys = F.array(F.struct(F.col("s_name").alias("pubkey"), F.lit(True).alias("signer")),
                   F.struct(F.lit("relayer").alias("pubkey"), F.lit(False).alias("signer")))
    m, d, a = F.col("_mint"), F.col("_dec"), F.col("_amt")
    pre_tb = F.array(_balance(1, m, F.col("s_name"), F.lit(0), d))
    post_tb = F.array(_balance(1, m, F.col("s_name"), a, d), _balance(2, F.col("o_address"), F.lit("relayer"), a, d))
    pre_tb, post_tb, pre_sol, post_sol = _balances(k, a, F.col("s_name"), F.col("tok_idx") == 0, pre_tb, post_tb)
    inner = F.array().cast("array<struct<instructions:array<struct<programId:string,data:string>>>>")
    return df.select(
        F.concat(F.lit("f-"), k.cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("signature"),
        k.alias("slot"),
        F.timestamp_diff("SECOND", epoch_ntz(), F.col("l_shipdate")).alias("blockTime"),
        F.struct(F.lit(None).cast("string").alias("err"), logs.alias("logMessages"), inner.alias("innerInstructions"),
                 pre_tb.alias("preTokenBalances"), post_tb.alias("postTokenBalances"),
                 pre_sol.alias("preBalances"), post_sol.alias("postBalances")).alias("meta"),
        F.struct(F.struct(F.array(ix).alias("instructions"), keys.alias("accountKeys")).alias("message"))
         .alias("transaction"),
    )


def raw_transactions_from_tpch(spark: SparkSession, sf_dir: str, encoding: str = "base58",
                               files: tuple[int, int] | None = None) -> DataFrame:
    """Both transaction kinds, in the RAW_TX shape; with ``files``, in that many partitions of each by slot."""
    of_created, of_fulfilled = files or (None, None)
    return created_transactions(spark, sf_dir, encoding, of_created).unionByName(
        fulfilled_transactions(spark, sf_dir, encoding, of_fulfilled))


LOSE_EVERY, CUT_EVERY = 71, 83


def damaged(raw: DataFrame, lose_every: int = LOSE_EVERY) -> DataFrame:
    """``raw`` where the documents of every ``lose_every``-th slot lost their message, as a failed fetch leaves them."""
    return raw.withColumn("transaction", F.when(F.col("slot") % lose_every != 0, F.col("transaction")))


def landed_lines(raw: DataFrame, cut_every: int = CUT_EVERY) -> DataFrame:
    """``raw`` as JSON lines (slot, value), those of every ``cut_every``-th slot broken off in the middle."""
    line = F.to_json(F.struct(*RAW_TX.fieldNames()))
    return (raw.select("slot", line.alias("value"))
            .withColumn("value", F.when(F.col("slot") % cut_every == 0, F.substr("value", F.lit(1), F.floor(F.length("value") / 2).cast("int")))
                        .otherwise(F.col("value"))))
