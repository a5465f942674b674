"""Registered table / landing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fillwise.operators import analytics as A
from fillwise.operators import dedup as D
from fillwise.operators import ui as U
from fillwise.operators.progress import progress_with_count
from fillwise.plans.q_analytics import FIXTURE_AS_OF
from fillwise.plans.catalog import load_ev, register
from fillwise.plans.oracle import EV_RAW, with_ev
from fillwise.sources import io as IO
from fillwise.sources import tpch
from fillwise.streaming.ingest import scratch_dir

# Stored table for the insert queries: everything landed before 1998; the
# batch is the full history delivered again (at-least-once redelivery).
STORED_BEFORE = "1998-01-01 00:00:00"


def _stored(spark, sf):
    raw = tpch.raw_order_events(spark, sf)
    return raw.where(F.col("block_time") < F.lit(STORED_BEFORE).cast("timestamp_ntz"))


_STORED_CTE = f"stored AS (SELECT signature, event_type FROM ev_raw WHERE block_time < TIMESTAMP '{STORED_BEFORE}')"


@register("new_events", with_ev("""
SELECT ev.* FROM ev ANTI JOIN (SELECT DISTINCT signature, event_type FROM stored) s USING (signature, event_type)""", _STORED_CTE))
def q_new_events(spark, sf):
    return D.new_events(tpch.raw_order_events(spark, sf), _stored(spark, sf))


@register("dedup_insert", with_ev("""
SELECT b.batch_rows, n.inserted, b.batch_rows - n.inserted AS duplicates
FROM (SELECT count(*) AS batch_rows FROM ev_raw) b,
     (SELECT count(*) AS inserted FROM ev WHERE NOT EXISTS (
        SELECT 1 FROM stored s WHERE s.signature = ev.signature AND s.event_type = ev.event_type)) n""",
    _STORED_CTE))
def q_dedup_insert(spark, sf):
    return IO.insert_counts(tpch.raw_order_events(spark, sf), _stored(spark, sf))


@register("event_exists", with_ev("""
SELECT count(*) > 0 AS "exists" FROM (SELECT 1 FROM ev WHERE signature = 'f-7-1' AND event_type = 'fulfilled' LIMIT 1) t"""))
def q_event_exists(spark, sf):
    return D.event_exists(load_ev(spark, sf), "f-7-1", "fulfilled")


_NORMALISED = """SELECT order_id, event_type, signature, slot, date_trunc('second', block_time) AS block_time,
  nullif(maker, '') AS maker, nullif(give_token_address, '') AS give_token_address,
  nullif(give_token_symbol, '') AS give_token_symbol, CASE WHEN give_amount != 0 THEN give_amount END AS give_amount,
  CASE WHEN NOT isnan(give_amount_usd) AND give_amount_usd != 0 THEN give_amount_usd END AS give_amount_usd,
  CASE WHEN CAST(give_chain_id AS DECIMAL(20,0)) BETWEEN 0 AND 18446744073709551615
       THEN CAST(give_chain_id AS DECIMAL(20,0)) END AS give_chain_id,
  nullif(take_token_address, '') AS take_token_address, nullif(take_token_symbol, '') AS take_token_symbol,
  CASE WHEN take_amount != 0 THEN take_amount END AS take_amount,
  CASE WHEN NOT isnan(take_amount_usd) AND take_amount_usd != 0 THEN take_amount_usd END AS take_amount_usd,
  CASE WHEN CAST(take_chain_id AS DECIMAL(20,0)) BETWEEN 0 AND 18446744073709551615
       THEN CAST(take_chain_id AS DECIMAL(20,0)) END AS take_chain_id,
  nullif(receiver, '') AS receiver, nullif(taker, '') AS taker,
  CASE WHEN fulfilled_amount != 0 THEN fulfilled_amount END AS fulfilled_amount,
  CASE WHEN NOT isnan(fulfilled_amount_usd) AND fulfilled_amount_usd != 0 THEN fulfilled_amount_usd END
    AS fulfilled_amount_usd,
  created_at, _version FROM ev_raw"""


@register("normalise_event", "WITH " + EV_RAW + "\n" + _NORMALISED)
def q_normalise_event(spark, sf):
    return IO.normalise_events(tpch.raw_order_events(spark, sf))


_SIGS = """sigs AS (SELECT 'c-' || CAST(o_orderkey AS VARCHAR) AS signature, o_orderkey AS slot,
  CAST(epoch(o_orderdate) AS BIGINT) AS blockTime, o_orderstatus = 'P' AS err FROM orders)"""


@register("page_signatures", f"""WITH {_SIGS},
p AS (SELECT * FROM sigs ORDER BY slot DESC, signature DESC LIMIT 1001)
SELECT signature, slot, blockTime, err, (SELECT count(*) FROM p) > 1000 AS has_more
FROM p ORDER BY slot DESC, signature DESC LIMIT 1000""")
def q_page_signatures(spark, sf):
    return IO.page_signatures(tpch.signatures(spark, sf), 1000)


@register("page_signatures_next", f"""WITH {_SIGS}
SELECT signature, slot, blockTime, err, (SELECT count(*) FROM sigs) > 2000 AS has_more
FROM sigs ORDER BY slot DESC, signature DESC LIMIT 1000 OFFSET 1000""")
def q_page_signatures_next(spark, sf):
    """The page before the first one's last row."""
    sigs = tpch.signatures(spark, sf)
    last = IO.page_signatures(sigs, 1000).orderBy("slot", "signature").first()
    return IO.page_signatures(sigs, 1000, (last["slot"], last["signature"]))


@register("valid_signatures", f"""WITH {_SIGS}
SELECT count_if(NOT coalesce(err, false)) AS valid, count_if(coalesce(err, false)) AS failed, count(*) AS total
FROM sigs""")
def q_valid_signatures(spark, sf):
    return IO.valid_signatures(tpch.signatures(spark, sf))


_PROGRESS = """plog AS (SELECT CAST(user_id AS VARCHAR) AS program_id, event_type,
  CAST(event_id AS VARCHAR) AS last_signature, event_id + 1 AS total_collected, ts AS updated_at FROM events),
platest AS (SELECT program_id, event_type, arg_max(last_signature, {'u': updated_at, 't': total_collected, 's': last_signature}) AS last_signature,
  arg_max(total_collected, {'u': updated_at, 't': total_collected, 's': last_signature}) AS total_collected,
  max(updated_at) AS updated_at FROM plog GROUP BY 1, 2)"""


@register("latest_progress", f"WITH {_PROGRESS} SELECT * FROM platest")
def q_latest_progress(spark, sf):
    return D.latest_progress(tpch.progress_log(spark, sf).drop("seq"))


@register("progress_read", f"""WITH {_PROGRESS},
keys AS (SELECT * FROM (VALUES ('8', 'error'), ('8', 'created'), ('46', 'click')) k(program_id, event_type))
SELECT k.program_id, k.event_type, p.last_signature, coalesce(p.total_collected, 0) AS total_collected
FROM keys k LEFT JOIN platest p ON k.program_id = p.program_id AND k.event_type = p.event_type""")
def q_progress_read(spark, sf):
    keys = spark.createDataFrame([("8", "error"), ("8", "created"), ("46", "click")],
                                 "program_id STRING, event_type STRING")
    return IO.progress_read(D.latest_progress(tpch.progress_log(spark, sf).drop("seq")), keys)


@register("progress_with_count", f"""WITH {_PROGRESS},
exact AS (SELECT CAST(user_id AS VARCHAR) AS program_id, event_type, count(*) AS exact_count FROM events GROUP BY 1, 2)
SELECT p.program_id, p.event_type, p.last_signature, p.total_collected, coalesce(e.exact_count, 0) AS exact_count
FROM platest p LEFT JOIN exact e ON p.program_id = e.program_id AND p.event_type = e.event_type""")
def q_progress_with_count(spark, sf):
    collected = tpch.read_table(spark, sf, "events").select(F.col("user_id").cast("string").alias("program_id"), "event_type")
    return progress_with_count(D.latest_progress(tpch.progress_log(spark, sf).drop("seq")), collected)


@register("lookup_in_list", with_ev("SELECT * FROM ev WHERE signature IN ('c-7', 'f-7-1', 'f-7-2', 'c-999999999')"))
def q_lookup_in_list(spark, sf):
    return IO.lookup_in_list(load_ev(spark, sf), ["c-7", "f-7-1", "f-7-2", "c-999999999"])


_SEARCH = """SELECT * FROM ev WHERE event_type = 'fulfilled' AND (
  coalesce(contains(lower(order_id), lower('{q}')), false) OR coalesce(contains(lower(signature), lower('{q}')), false)
  OR coalesce(contains(lower(maker), lower('{q}')), false) OR coalesce(contains(lower(taker), lower('{q}')), false)
  OR coalesce(contains(lower(give_token_symbol), lower('{q}')), false)
  OR coalesce(contains(lower(take_token_symbol), lower('{q}')), false))"""


@register("search_orders", with_ev(_SEARCH.format(q="Promo")))
def q_search_orders(spark, sf):
    return U.search_orders(load_ev(spark, sf), "Promo", "fulfilled")


@register("search_orders_all", with_ev(_SEARCH.replace("event_type = 'fulfilled' AND ", "").format(q="omer#0000001")))
def q_search_orders_all(spark, sf):
    return U.search_orders(load_ev(spark, sf), "omer#0000001", "all")


@register("display_columns", with_ev("""
SELECT order_id, event_type, signature, block_time,
  CASE WHEN event_type = 'created' THEN coalesce(nullif(give_token_symbol, ''), '-')
       ELSE coalesce(nullif(take_token_symbol, ''), nullif(give_token_symbol, ''), '-') END AS display_token,
  CASE WHEN event_type = 'created' THEN give_amount_usd ELSE take_amount_usd END AS display_amount_usd,
  CASE WHEN event_type = 'created' THEN maker ELSE taker END AS display_address
FROM ev"""))
def q_display_columns(spark, sf):
    return U.display_columns(load_ev(spark, sf))


_RECENT = ("order_id, event_type, signature, block_time, give_token_symbol, give_amount_usd, "
           "take_token_symbol, take_amount_usd, maker, taker")


@register("page_orders", with_ev(f"""
SELECT {_RECENT}, (SELECT CAST(ceil(count(*) / 10.0) AS BIGINT) FROM s) AS total_pages
FROM s ORDER BY block_time DESC, signature ASC, event_type ASC LIMIT 10 OFFSET 20""",
    "s AS (" + _SEARCH.format(q="Promo") + ")"))
def q_page_orders(spark, sf):
    return U.page_orders(U.search_orders(load_ev(spark, sf), "Promo", "fulfilled"), page=3, size=10)


@register("page_after", with_ev(f"""
SELECT {_RECENT} FROM s ORDER BY block_time DESC, signature ASC, event_type ASC LIMIT 10 OFFSET 10""",
    "s AS (" + _SEARCH.format(q="Promo") + ")"))
def q_page_after(spark, sf):
    """L3: the second page by keyset, from the last row of the first."""
    found = U.search_orders(load_ev(spark, sf), "Promo", "fulfilled")
    last = U.page_orders(found, page=1, size=10).orderBy(*U.recent_order()).collect()[-1]
    return U.page_after(found, last["block_time"], last["signature"], last["event_type"])


@register("merge_live", with_ev(f"""
SELECT {_RECENT}, position, source FROM (
  SELECT *, 0 AS src, 'update' AS source FROM upd
  UNION ALL
  SELECT *, 1, 'snapshot' FROM snap WHERE order_id NOT IN (SELECT order_id FROM upd))
ORDER BY src, position LIMIT 20""",
    f"""upd AS (SELECT {_RECENT}, row_number() OVER (ORDER BY block_time DESC, signature, event_type) AS position
  FROM (SELECT * FROM ev ORDER BY block_time DESC, signature, event_type LIMIT 5) u)""",
    f"""snap AS (SELECT {_RECENT}, row_number() OVER (ORDER BY block_time DESC, signature, event_type) AS position
  FROM (SELECT * FROM ev ORDER BY block_time DESC, signature, event_type LIMIT 50) s)"""))
def q_merge_live(spark, sf):
    ev = load_ev(spark, sf)
    update = U.with_position(A.recent_orders(ev, 5))
    snapshot = U.with_position(A.recent_orders(ev, 50))
    return U.merge_live(update, snapshot)


_CSV = with_ev("""
SELECT coalesce(order_id, '') AS "Order ID", coalesce(event_type, '') AS "Type",
  coalesce(give_token_symbol, '') AS "Give Token",
  coalesce(regexp_replace(CAST(CAST(give_amount_usd AS DECIMAL(38,6)) AS VARCHAR), '\\.?0+$', ''), '') AS "Give Amount USD",
  coalesce(take_token_symbol, '') AS "Take Token",
  coalesce(regexp_replace(CAST(CAST(take_amount_usd AS DECIMAL(38,6)) AS VARCHAR), '\\.?0+$', ''), '') AS "Take Amount USD",
  coalesce(maker, '') AS "Maker", coalesce(taker, '') AS "Taker",
  strftime(block_time, '%Y-%m-%d %H:%M:%S') AS "Time", coalesce(signature, '') AS "Transaction"
FROM ev""")


@register("export_csv", _CSV)
def q_export_csv(spark, sf):
    return IO.csv_rows(load_ev(spark, sf))


@register("export_csv_file", _CSV)
def q_export_csv_file(spark, sf):
    """The files are written, quoted and escaped, and read back."""
    path = scratch_dir(spark, "csv")
    IO.export_csv(load_ev(spark, sf), path)
    text = ", ".join(f"`{h}` string" for h in IO.CSV_HEADERS)
    back = spark.read.schema(text).option("header", True).option("escape", '"').csv(path)
    return back.select(*[F.coalesce(F.col(f"`{h}`"), F.lit("")).alias(h) for h in IO.CSV_HEADERS])


_WIRE = """order_id, event_type, signature, slot, strftime(block_time, '%Y-%m-%dT%H:%M:%S.%gZ') AS block_time,
  maker, give_token_symbol, CASE WHEN give_amount != 0 THEN CAST(give_amount AS VARCHAR) END AS give_amount,
  give_amount_usd, give_chain_id, take_token_symbol,
  CASE WHEN take_amount != 0 THEN CAST(take_amount AS VARCHAR) END AS take_amount, take_amount_usd, take_chain_id,
  taker, CASE WHEN fulfilled_amount != 0 THEN CAST(fulfilled_amount AS VARCHAR) END AS fulfilled_amount,
  fulfilled_amount_usd"""


@register("wire_events", with_ev(f"SELECT {_WIRE} FROM ev"))
def q_wire_events(spark, sf):
    return IO.to_wire(load_ev(spark, sf))


@register("wire_roundtrip", with_ev("""
SELECT order_id, event_type, signature, slot, block_time, maker, give_token_symbol,
  CASE WHEN give_amount != 0 THEN give_amount END AS give_amount, give_amount_usd,
  CAST(give_chain_id AS DECIMAL(20,0)) AS give_chain_id, take_token_symbol,
  CASE WHEN take_amount != 0 THEN take_amount END AS take_amount, take_amount_usd, CAST(take_chain_id AS DECIMAL(20,0)) AS take_chain_id, taker,
  CASE WHEN fulfilled_amount != 0 THEN fulfilled_amount END AS fulfilled_amount, fulfilled_amount_usd FROM ev"""))
def q_wire_roundtrip(spark, sf):
    return IO.from_wire(IO.wire_json(load_ev(spark, sf)))


@register("camel_project", with_ev("""
SELECT CAST(block_time AS DATE) AS date, count_if(event_type = 'created') AS createdCount,
  coalesce(CAST(sum(CAST(CASE WHEN event_type = 'created' THEN give_amount_usd END AS DECIMAL(28,6))) AS DOUBLE), 0.0) AS createdVolumeUsd,
  count_if(event_type = 'fulfilled') AS fulfilledCount,
  coalesce(CAST(sum(CAST(CASE WHEN event_type = 'fulfilled' THEN take_amount_usd END AS DECIMAL(28,6))) AS DOUBLE), 0.0) AS fulfilledVolumeUsd
FROM ev WHERE block_time >= CAST(CAST(TIMESTAMP '2001-11-05 00:00:00' AS DATE) - INTERVAL 365 DAY AS TIMESTAMP)
GROUP BY 1"""))
def q_camel_project(spark, sf):
    return IO.camel_project(A.daily_volumes(load_ev(spark, sf), 365, FIXTURE_AS_OF),
                            zero_fill=("created_volume_usd", "fulfilled_volume_usd"))
