"""Table schemas and the two small dimension tables (chains, tokens)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# order_events: one row per (signature, event_type) after dedup
# ---------------------------------------------------------------------------
AMOUNT = T.DecimalType(38, 0)

ORDER_EVENTS = T.StructType([
    T.StructField("order_id", T.StringType(), False),
    T.StructField("event_type", T.StringType(), False),
    T.StructField("signature", T.StringType(), False),
    T.StructField("slot", T.LongType(), False),
    T.StructField("block_time", T.TimestampType(), False),
    T.StructField("maker", T.StringType(), True),
    T.StructField("give_token_address", T.StringType(), True),
    T.StructField("give_token_symbol", T.StringType(), True),
    T.StructField("give_amount", AMOUNT, True),
    T.StructField("give_amount_usd", T.DoubleType(), True),
    T.StructField("give_chain_id", T.LongType(), True),
    T.StructField("take_token_address", T.StringType(), True),
    T.StructField("take_token_symbol", T.StringType(), True),
    T.StructField("take_amount", AMOUNT, True),
    T.StructField("take_amount_usd", T.DoubleType(), True),
    T.StructField("take_chain_id", T.LongType(), True),
    T.StructField("receiver", T.StringType(), True),
    T.StructField("taker", T.StringType(), True),
    T.StructField("fulfilled_amount", AMOUNT, True),
    T.StructField("fulfilled_amount_usd", T.DoubleType(), True),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("_version", T.LongType(), False),
])

CHAIN_ID = T.DecimalType(20, 0)     # unsigned 64-bit ids

# The stored table: event rows with wall-clock UTC times and unsigned chain
# ids, always in folders ``batch_id=N/ym=yyyyMM``.
EVENT_DOC = T.StructType([
    T.StructField(f.name, T.TimestampNTZType() if isinstance(f.dataType, T.TimestampType)
                  else CHAIN_ID if f.name.endswith("_chain_id") else f.dataType, True)
    for f in ORDER_EVENTS.fields])
TABLE_PARTITIONS = ("batch_id", "ym")
STORED_EVENTS = T.StructType(EVENT_DOC.fields + [T.StructField("batch_id", T.LongType(), True),
                                                 T.StructField("ym", T.IntegerType(), True)])

EVENT_COLUMNS = [f.name for f in ORDER_EVENTS.fields]
EVENT_TYPES = ("created", "fulfilled")

# Dedup key and the order that picks the surviving row inside a key.  The
# first entry is the version; the rest break version ties (DESC NULLS LAST)
# and finally every remaining column, so the choice is total and the same in
# every engine.
DEDUP_KEY = ("signature", "event_type")
DEDUP_ORDER = (
    "_version", "take_amount_usd", "fulfilled_amount_usd", "taker",
    "take_token_symbol", "take_chain_id", "block_time",
    "order_id", "slot", "maker", "give_token_address", "give_token_symbol",
    "give_amount", "give_amount_usd", "give_chain_id", "take_token_address",
    "take_amount", "receiver", "fulfilled_amount", "created_at",
)

# Stored progress: one row per program and ingest batch with its counts; the total runs over the batches.
STORED_PROGRESS = T.StructType([
    T.StructField("program_id", T.StringType(), True),
    T.StructField("event_type", T.StringType(), True),
    T.StructField("last_signature", T.StringType(), True),
    T.StructField("total_collected", T.LongType(), True),
    T.StructField("updated_at", T.TimestampType(), True),
    T.StructField("delivered", T.LongType(), True),
    T.StructField("inserted", T.LongType(), True),
    T.StructField("errors", T.LongType(), True),
    T.StructField("batch_id", T.LongType(), True),
])

# Documents and lines that collection could not read, as text, by ingest batch.
QUARANTINE = T.StructType([
    T.StructField("reason", T.StringType(), True),
    T.StructField("signature", T.StringType(), True),
    T.StructField("line", T.StringType(), True),
    T.StructField("batch_id", T.LongType(), True),
])


# ---------------------------------------------------------------------------
# raw transaction document (only the fields the decoder touches)
# ---------------------------------------------------------------------------
IX = T.StructType([
    T.StructField("programId", T.StringType(), True),
    T.StructField("data", T.StringType(), True),
])
TOKEN_BALANCE = T.StructType([
    T.StructField("accountIndex", T.IntegerType(), True),
    T.StructField("mint", T.StringType(), True),
    T.StructField("owner", T.StringType(), True),
    T.StructField("uiTokenAmount", T.StructType([
        T.StructField("amount", T.StringType(), True),
        T.StructField("decimals", T.IntegerType(), True),
    ]), True),
])
RAW_TX = T.StructType([
    T.StructField("signature", T.StringType(), True),
    T.StructField("slot", T.LongType(), True),
    T.StructField("blockTime", T.LongType(), True),
    T.StructField("meta", T.StructType([
        T.StructField("err", T.StringType(), True),
        T.StructField("logMessages", T.ArrayType(T.StringType()), True),
        T.StructField("innerInstructions", T.ArrayType(T.StructType([
            T.StructField("instructions", T.ArrayType(IX), True),
        ])), True),
        T.StructField("preTokenBalances", T.ArrayType(TOKEN_BALANCE), True),
        T.StructField("postTokenBalances", T.ArrayType(TOKEN_BALANCE), True),
        T.StructField("preBalances", T.ArrayType(T.LongType()), True),
        T.StructField("postBalances", T.ArrayType(T.LongType()), True),
    ]), True),
    T.StructField("transaction", T.StructType([
        T.StructField("message", T.StructType([
            T.StructField("instructions", T.ArrayType(IX), True),
            T.StructField("accountKeys", T.ArrayType(T.StructType([
                T.StructField("pubkey", T.StringType(), True),
                T.StructField("signer", T.BooleanType(), True),
            ])), True),
        ]), True),
    ]), True),
])

# ---------------------------------------------------------------------------
# Fixed values (must equal the protocol's published constants)
# ---------------------------------------------------------------------------
SOURCE_PROGRAM_ID = "src5qyZHqTqecJV4aY6Cb6zDZLMDzrDKKezs22MPHr4"
DESTINATION_PROGRAM_ID = "dst5MGcFPoBeREFAA5E3tU5ij8m5uVYwkzkSAbsLbNo"
CREATE_ORDER_DISCRIMINATOR_HEX = "828362BE28CE4432"
SOLANA_CHAIN_ID = 7565164
NATIVE_SOL_MINT = "So11111111111111111111111111111111111111112"
MIN_SOL_TRANSFER_LAMPORTS = 10_000_000
STABLECOIN_SYMBOLS = ("USDC", "USDT", "DAI", "BUSD")

# Chain id -> chain name.
CHAINS = [
    (1, "Ethereum"),
    (10, "Optimism"),
    (56, "BSC"),
    (100, "Gnosis"),
    (137, "Polygon"),
    (250, "Fantom"),
    (8453, "Base"),
    (42161, "Arbitrum"),
    (43114, "Avalanche"),
    (7565164, "Solana"),
]

# Solana mints -> (symbol, decimals, estimated USD price).
SOLANA_TOKENS = [
    ("So11111111111111111111111111111111111111112", "SOL", 9, 190.0),
    ("EPjFWdd5AufqSSqeM2qN1xzybapC8G4wEGGkZwyTDt1v", "USDC", 6, 1.0),
    ("Es9vMFrzaCERmJfrF4H2FYD4KCoNkY11McCe8BenwNYB", "USDT", 6, 1.0),
    ("EjmyN6qEC1Tf1JxiG1ae7UTJhUxSwk1TCCb39Xo6rZNH", "ETH", 8, 3400.0),
    ("3NZ9JMVBmGAqocybic2c7LQCJScmgsAZ6vQqTDzcqmJh", "WBTC", 8, 95000.0),
    ("mSoLzYCxHdYgdzU16g5QSh3i5K3z3KZK7ytfqcJm7So", "mSOL", 9, 210.0),
    ("7dHbWXmci3dT8UFYWYZweBLXgycu7Y3iL6trKn1Y7ARj", "stSOL", 9, 200.0),
    ("DezXAZ8z7PnrnRJjz3wXBoRgixCa6xjnB7YaB1pPB263", "BONK", 5, 0.00003),
    ("2M59vuWgsiuHAqQVB6KvuXuaBCJR8138gMAm4uCuR6Du", "USDC", 6, 1.0),
    ("2M59vvrxfJjQvkVrRcaukiLMDLyAVkVStsdo3TzncnFR", "USDC", 6, 1.0),
    ("2M59vw3yujSFV1eVfmv5Af3UCe1FbkSAYpwaB15ZRghu", "USDC", 6, 1.0),
    ("2M59vv9Ub5R2Upy8RdJanjAjy1NAysXCViLtRTzNDBwD", "USDC", 6, 1.0),
    ("2M59vvbm5H6PgSnLrJ4enUh2dkwQRPPYnXYcduwW348X", "USDC", 6, 1.0),
    ("2M59vuaiieUr7KrPTJkcMSB1jVcB8FRLZ1jRYLNzvAeb", "USDC", 6, 1.0),
    ("2M59vw23JFxr587GK7gjf7mnWF98NHq1t1Uy2zEdx9vf", "USDC", 6, 1.0),
    ("2M59vwAZjmxdjuFoHN4LPF6V884pXaVd4tFAPfNHcbhH", "USDT", 6, 1.0),
    ("2M59vvcYYyHFQYh6oLvg2z8q1aqoa1LrNLQZqU4ZKPoD", "USDT", 6, 1.0),
    ("2M59vwKQJKZmd3tzArBHGeyBpXNkrxVuJ4nbSzyvLSLf", "ETH", 18, 3400.0),
    ("2M59vwmBk7XwzDiNXD8m2aMYLdC8asEZ78mcVkTJJxVu", "ETH", 18, 3400.0),
    ("2M59vv8eoRXMEVD8Wmb9RtvYdgx3WvgmNU9dvcHk55bm", "ETH", 18, 3400.0),
    ("2M59vvazzYMLDTQ8baypEm43JvVgWwYWEUHWkYHWfRaf", "ETH", 18, 3400.0),
]

# EVM token addresses (lower case) -> (symbol, decimals, price).
EVM_TOKENS = [
    ("0x0000000000000000000000000000000000000000", "ETH", 18, 3400.0),
    ("0xa0b86991c6218b36c1d19d4a2e9eb0ce3606eb48", "USDC", 6, 1.0),
    ("0xdac17f958d2ee523a2206206994597c13d831ec7", "USDT", 6, 1.0),
    ("0xc02aaa39b223fe8d0a0e5c4f27ead9083c756cc2", "WETH", 18, 3400.0),
    ("0x2260fac5e5542a773aa44fbcfedf7c193bc2c599", "WBTC", 8, 95000.0),
    ("0xff970a61a04b1ca14834a43f5de4533ebddb5cc8", "USDC.e", 6, 1.0),
    ("0xaf88d065e77c8cc2239327c5edb3a432268e5831", "USDC", 6, 1.0),
    ("0xfd086bc7cd5c481dcc9c85ebe478a1c0b69fcbb9", "USDT", 6, 1.0),
    ("0x82af49447d8a07e3bd95bd0d56f35241523fbab1", "WETH", 18, 3400.0),
    ("0x4200000000000000000000000000000000000006", "WETH", 18, 3400.0),
    ("0x833589fcd6edb6e08f4c7c32d4f71b54bda02913", "USDC", 6, 1.0),
    ("0x0b2c639c533813f4aa9d7837caf62653d097ff85", "USDC", 6, 1.0),
    ("0x7f5c764cbc14f9669b88837ca1490cca17c31607", "USDC.e", 6, 1.0),
    ("0x94b008aa00579c1307b0ef2c499ad98a8ce58e58", "USDT", 6, 1.0),
    ("0x2791bca1f2de4661ed88a30c99a7a9449aa84174", "USDC.e", 6, 1.0),
    ("0x3c499c542cef5e3811e1192ce70d8cc03d5c3359", "USDC", 6, 1.0),
    ("0xc2132d05d31c914a87c6611c10748aeb04b58e8f", "USDT", 6, 1.0),
    ("0x7ceb23fd6bc0add59e62ac25578270cff1b9f619", "WETH", 18, 3400.0),
    ("0x8ac76a51cc950d9822d68b83fe1ad97b32cd580d", "USDC", 18, 1.0),
    ("0x55d398326f99059ff775485246999027b3197955", "USDT", 18, 1.0),
    ("0x2170ed0880ac9a755fd29b2688956bd959f933f8", "ETH", 18, 3400.0),
    ("0xb97ef9ef8734c71904d8002f8b6bc66dd9c48a6e", "USDC", 6, 1.0),
    ("0x9702230a8ea53601f5cd2dc00fdbc13d4df4a8c7", "USDT", 6, 1.0),
    ("0x49d5c2bdffac6ce2bfdb6640f4f80f226bc10bab", "WETH.e", 18, 3400.0),
]

CHAINS_SCHEMA = "chain_id BIGINT, chain_name STRING"
TOKENS_SCHEMA = "address STRING, family STRING, symbol STRING, decimals INT, estimated_price DOUBLE"


def chains_df(spark: SparkSession) -> DataFrame:
    """Chain dimension: 10 rows, fixed size, always safe to broadcast."""
    return spark.createDataFrame(CHAINS, CHAINS_SCHEMA)


def tokens_df(spark: SparkSession) -> DataFrame:
    """Token dimension: 45 rows, fixed size, always safe to broadcast."""
    rows = ([(a, "solana", s, d, p) for a, s, d, p in SOLANA_TOKENS]
            + [(a, "evm", s, d, p) for a, s, d, p in EVM_TOKENS])
    return spark.createDataFrame(rows, TOKENS_SCHEMA)
