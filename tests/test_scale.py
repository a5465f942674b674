"""Steps whose cost must follow the rows: number readers, landed files, keys."""

import random

import pytest


def _times_in_plan(df, name):
    return df._jdf.queryExecution().optimizedPlan().toString().count(name)


@pytest.mark.parametrize("query, column", [("borsh_columns", "l_partkey#"), ("borsh_wide_numbers", "o_orderkey#")])
def test_bytes_are_built_once_a_row(spark, sf, query, column):
    import __spark_entry__ as entry
    assert _times_in_plan(entry.queries()[query](spark, sf), column) <= 12


def test_numbers_of_any_width(spark):
    from pyspark.sql import functions as F

    from fillwise.functions import binary as B
    rnd = random.Random(4)
    values = [bytes(rnd.choice([0, 255, rnd.randrange(256)]) for _ in range(40)) for _ in range(60)]
    values += [bytes(40), (10 ** 38).to_bytes(40, "little"), (10 ** 38 - 1).to_bytes(40, "little"), b"\x01", None]
    df, b, widths = spark.createDataFrame([(None if v is None else bytearray(v),) for v in values], "b binary"), F.col("b"), (1, 5, 16, 32, 33)
    cols = [c for w in widths for c in (B.u_le_text(b, 0, w).alias(f"t{w}"), B.u_le_too_wide(b, 0, w).alias(f"w{w}"), B.u_le_hex(b, 0, w).alias(f"h{w}"))]
    for v, r in zip(values, df.select(*cols).collect()):
        for w in widths:
            n = int.from_bytes(v[:w], "little") if v is not None and len(v) >= w else None
            want = (None, None if v is None else False, "") if n is None else (str(n), len(str(n)) > 38, f"{n:0{2 * w}x}")
            assert (r[f"t{w}"], r[f"w{w}"], r[f"h{w}"]) == want


def test_files_and_batches_follow_the_rows():
    from fillwise.streaming import ingest as I
    assert I.file_count(1000, 10) == 10 and I.files_per_batch(10, 10, 3) == 3
    n = I.file_count(300_000_000, 10)
    assert 300_000_000 / n <= I.ROWS_PER_FILE and I.files_per_batch(n, 10, 3) == I.FILES_PER_BATCH
    assert I.files_per_batch(20, 10, 3) == 6


def test_landed_documents_are_compressed(spark, sf, monkeypatch, tmp_path):
    from fillwise.plans import q_decode, q_landing
    from fillwise.streaming import ingest as I
    monkeypatch.setattr(I, "scratch_dir", lambda s, name: str(tmp_path / name))
    monkeypatch.setattr(q_decode, "scratch_dir", lambda s, name: str(tmp_path / name))
    q_landing.q_scan_raw_tx(spark, sf)
    q_decode.q_parse_stats(spark, sf)
    for name in ("rawjson", "parsestats"):
        landed = list((tmp_path / name).glob("part-*"))
        assert landed and all(f.suffix == ".gz" for f in landed)


def test_copies_are_made_after_the_shuffle(spark, tmp_path):
    from fillwise.streaming import ingest as I
    df = spark.sql("SELECT id, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, id) AS block_time FROM range(100)")
    I.land_files(df, str(tmp_path / "in"), 4, ["block_time"], copies=2, compression="gzip")
    back = spark.read.schema(df.schema).json(str(tmp_path / "in"))
    assert sorted(r.id for r in back.collect()) == sorted([*range(100)] * 2)
    assert len(list((tmp_path / "in").glob("part-*.json.gz"))) == 4


def test_wide_rows_are_made_in_bounded_pieces(spark, sf, monkeypatch):
    from fillwise.sources import tpch
    monkeypatch.setattr(tpch, "ROWS_PER_PIECE", 500)
    plain, dealt = tpch.raw_order_events(spark, sf), tpch.raw_order_events(spark, sf, dealt=True)
    assert dealt.rdd.getNumPartitions() >= plain.count() // 500 > plain.rdd.getNumPartitions()
    assert plain.exceptAll(dealt).isEmpty() and dealt.exceptAll(plain).isEmpty()


def test_recent_list_reads_its_batch_once(spark, sf, tmp_path):
    from fillwise.streaming import live as L
    from fillwise.sources import tpch
    few = tpch.raw_order_events(spark, sf).limit(40)
    seen, rows = spark.sparkContext.accumulator(0), few.collect()

    def noted(r):
        seen.add(1)
        return r
    batch = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(noted), few.schema)
    write = L.live_recent_sink(spark, str(tmp_path / "list"))
    write(batch, 0)
    write(batch, 1)
    assert seen.value == 80
    assert [r.position for r in L.read_recent_list(spark, str(tmp_path / "list")).orderBy("position").collect()] == [1, 2, 3, 4, 5]


def test_documents_are_built_after_the_shuffle(spark, sf):
    from fillwise.sources import rawtx as R
    plain, dealt = R.raw_transactions_from_tpch(spark, sf, "hex"), R.raw_transactions_from_tpch(spark, sf, "hex", (2, 3))
    assert dealt.rdd.getNumPartitions() == 5
    assert plain.exceptAll(dealt).isEmpty() and dealt.exceptAll(plain).isEmpty()


def test_landed_raw_documents_are_not_shuffled(spark, sf, monkeypatch):
    from fillwise.plans import q_streaming as Q
    plans = []
    monkeypatch.setattr(Q.I, "run_ingest", lambda *a, **kw: None)
    text = type(spark.range(1).write).text

    def noted(self, *a, **kw):
        plans.append(self._df._jdf.queryExecution().optimizedPlan().toString())
        return text(self, *a, **kw)
    monkeypatch.setattr(type(spark.range(1).write), "text", noted)
    monkeypatch.setattr(Q, "_RUNS", {})
    Q._raw_backfill(spark, sf)
    assert len(plans) == 1
    assert plans[0].index("logMessages") < plans[0].index("RepartitionByExpression")


def test_batches_stay_few_at_many_files():
    from fillwise.streaming import ingest as I
    n = I.file_count(270_000_000, 10)
    assert n / I.files_per_batch(n, 10, 3) <= 10


def test_replayed_batches_are_computed_once(spark, sf, monkeypatch):
    from fillwise.plans import q_streaming as Q
    kept, store = [], Q.I.store_batch

    def noted(s, events, *a, **kw):
        kept.append(events.is_cached)
        return store(s, events, *a, **kw)
    monkeypatch.setattr(Q.I, "store_batch", noted)
    r = Q.q_replayed_batch_progress(spark, sf).first()
    assert kept == [True] * 4 and r.total_collected == r.stored


def test_compaction_ranks_once(spark, sf, monkeypatch, tmp_path):
    from fillwise.sources import io as IO
    from fillwise.sources import snapshots as S
    from fillwise.sources import tpch
    raw, path, plans, write = tpch.raw_order_events(spark, sf), str(tmp_path / "t"), [], IO.write_batch
    IO.append_events(raw.where("slot % 2 = 0"), path, 0)
    IO.append_events(raw, path, 1)

    def noted(rows, *a):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return write(rows, *a)
    monkeypatch.setattr(IO, "write_batch", noted)
    table = S.Snapshots(spark, path)
    assert table.compact() and "InMemoryTableScan" in plans[0]
    assert table.read().count() == table.events().count()


def test_replay_files_hold_no_more_rows_than_the_others(spark, tmp_path):
    from fillwise.streaming import ingest as I
    ev = spark.sql("SELECT id AS slot, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, id) AS block_time FROM range(2400)")
    I.land_event_files(ev, str(tmp_path), parts=8, replay_part=1, replay_of=3)
    rows = {kind: [len(f.read_text().splitlines()) for f in (tmp_path / kind).glob("part-*")] for kind in ("main", "replay")}
    assert sum(rows["main"]) == 2400 and sum(rows["replay"]) == 800
    assert len(rows["main"]) == 8 and max(rows["replay"]) <= 1.2 * max(rows["main"])


def test_compaction_sorts_the_stored_rows_once_in_bounded_pieces(spark, sf, monkeypatch, tmp_path):
    from fillwise.operators.dedup import latest
    from fillwise.sources import io as IO
    from fillwise.sources import tpch
    raw, path, out, plans, write = tpch.raw_order_events(spark, sf), str(tmp_path / "t"), str(tmp_path / "new"), [], IO.write_batch
    IO.append_events(raw, path)

    def noted(rows, *a):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return write(rows, *a)
    monkeypatch.setattr(IO, "write_batch", noted)
    monkeypatch.setattr(IO, "ROWS_PER_SORT", 500, raising=False)
    IO.compact_events(spark, path, out)
    pieces = -(-raw.count() // 500)
    assert plans[0].count("Sort [") == 1 and f", {pieces}), REPARTITION_BY_NUM" in plans[0]
    want, got = latest(IO.stored(spark, path).drop("batch_id")), IO.stored(spark, out).drop("batch_id")
    assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()


def test_hot_keys_are_limited_before_the_shuffle(spark, sf, monkeypatch, tmp_path):
    from pyspark.sql import functions as F

    from fillwise.operators.dedup import latest
    from fillwise.sources import io as IO
    from fillwise.sources import tpch
    raw = IO.table_rows(tpch.raw_order_events(spark, sf))
    key = lambda s: F.when(F.col("slot") % 3 == 0, F.lit("hot")).when(F.col("slot") % 3 == 1, F.lit(s)).otherwise(F.col("signature"))
    monkeypatch.setattr(IO, "ROWS_PER_SORT", 500, raising=False)
    for second in (None, "hot too"):
        rows = raw.withColumn("signature", key(second))
        assert {r.signature for r in IO.hot_keys(rows)} == {"hot", second}
        got, want = IO.latest_of_table(rows), latest(rows)
        text = got._jdf.queryExecution().executedPlan().toString()
        assert "LeftAnti" in text and "LeftSemi" in text and "ENSURE_REQUIREMENTS" in text
        assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()
    assert not IO.hot_keys(raw)



def test_batch_outcomes_read_the_events_once(spark):
    from fillwise.operators import telemetry as T
    seen, rows = spark.sparkContext.accumulator(0), [("a", f"s{i % 40}" if i % 9 else None, i if i % 7 else None) for i in range(200)]

    def noted(r):
        seen.add(1)
        return r
    schema = "event_type string, signature string, slot bigint"
    events = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(noted), schema)
    failed = spark.createDataFrame([("a", 3), ("a", 3), ("b", 900), ("a", None)], "event_type string, slot bigint")
    got = {(r.event_type, r.batch_id, r.processed): (r.inserted, r.duplicates, r.errors) for r in T.batch_outcomes(events, failed, 20).collect()}
    assert seen.value == len(rows)
    batch, first = lambda s: None if s is None else s // 20, {}
    for t, g, s in rows:
        if s is not None:
            first[t, g] = min(first.get((t, g), 10 ** 9), batch(s))
    want = {}
    for b in {batch(s) for _, _, s in rows}:
        n, new = sum(batch(s) == b for _, _, s in rows), sum(f == b for f in first.values())
        want["a", b, n] = (new, n - new, 2 if b == 0 else 0)
    assert got == want | {("b", 45, 0): (0, 0, 1), ("a", None, 0): (0, 0, 1)}


def test_large_tables_are_compacted_in_passes(spark, sf, monkeypatch, tmp_path):
    from fillwise.operators.dedup import latest
    from fillwise.sources import io as IO
    from fillwise.sources import tpch
    raw, path, out, sizes, write = tpch.raw_order_events(spark, sf), str(tmp_path / "t"), str(tmp_path / "new"), [], IO.write_batch
    raw = raw.unionByName(raw.where("slot % 50 = 0").selectExpr("* EXCEPT (signature)", "CAST(NULL AS STRING) AS signature"))
    IO.append_events(raw, path)
    IO.append_events(raw.where("slot < 50"), out)                      # left by an earlier attempt

    def noted(rows, *a):
        sizes.append(rows.count())
        return write(rows, *a)
    monkeypatch.setattr(IO, "write_batch", noted)
    monkeypatch.setattr(IO, "ROWS_PER_PASS", raw.count() // 3, raising=False)
    IO.compact_events(spark, path, out)
    want, got = latest(IO.stored(spark, path).drop("batch_id")), IO.stored(spark, out).drop("batch_id")
    assert len(sizes) == 4 and max(sizes) < sum(sizes) / 2
    assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()



def test_tail_rows_are_dealt_by_key(spark, sf, monkeypatch):
    from fillwise.plans.catalog import load_ev
    from fillwise.sources import io as IO
    from fillwise.sources import tpch
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plain, dealt = load_ev(spark, sf), load_ev(spark, sf, dealt=True)
    assert "hashpartitioning(signature#" not in plan(dealt) and plan(dealt).count("REPARTITION_BY_NUM") == 2
    assert plain.exceptAll(dealt).isEmpty() and dealt.exceptAll(plain).isEmpty()
    # A key that holds most rows is not dealt into one piece.
    read = tpch.read_table

    def repeated(s, d, name):
        rows = read(s, d, name)
        return rows.where("o_orderkey = 1").crossJoin(s.range(400)).drop("id").unionByName(rows) if name == "orders" else rows
    monkeypatch.setattr(tpch, "read_table", repeated)
    monkeypatch.setattr(IO, "ROWS_PER_SORT", 500)
    hot = load_ev(spark, sf, dealt=True)
    assert "ENSURE_REQUIREMENTS" in plan(hot)
    assert plain.exceptAll(hot).isEmpty() and hot.exceptAll(plain).isEmpty()

def test_documents_are_parsed_once_for_events_and_quarantine(spark, sf, tmp_path):
    from fillwise.operators import decode as X
    from fillwise.sources import rawtx as R
    from fillwise.streaming import ingest as I
    R.landed_lines(R.damaged(R.raw_transactions_from_tpch(spark, sf, "hex").where("slot < 900"))).select("value").write.text(str(tmp_path / "in"))
    raw = R.read_raw_transactions(spark, str(tmp_path / "in"))
    both = I.decoded_or_aside(spark, raw, "hex")
    assert both._jdf.queryExecution().executedPlan().toString().count("FileScan json") == 1
    rows = lambda df: sorted(map(str, df.collect()))
    bad = both.where("reason IS NOT NULL").select(*I.UNREADABLE)
    assert rows(bad) == rows(I.unreadable(raw)) and {r[0] for r in bad.select("reason").collect()} == {"malformed", "failed"}
    want = X.decode_events(spark, raw.where("_corrupt_record IS NULL"), "hex").drop("ix_pos", "block_time")
    assert rows(both.where("reason IS NULL").drop("reason", "line", "block_time")) == rows(want) != []


def test_raw_files_hold_few_documents(spark):
    from fillwise.streaming import ingest as I
    assert I.file_count(1_000_000, 2, I.DOCS_PER_FILE) == 10
    files = I.file_count(270_000_000, 8, I.DOCS_PER_FILE)
    assert I.files_per_batch(files, 8, 3, I.DOC_FILES_PER_BATCH) * I.DOCS_PER_FILE <= 16_000_000


def test_a_batch_keeps_no_wide_rows(spark, sf, monkeypatch, tmp_path):
    from fillwise.sources import io as IO
    from fillwise.sources import tpch
    from fillwise.streaming import ingest as I
    kept, freed, persist, release = [], [], type(spark.range(1)).persist, IO.release
    monkeypatch.setattr(type(spark.range(1)), "persist", lambda self, *a: (kept.append(len(self.columns)), persist(self, *a))[1])
    monkeypatch.setattr(IO, "release", lambda s: (freed.append(1), release(s))[1])
    paths, report, raw = I.IngestPaths.under(str(tmp_path)), I.IngestReport(), tpch.raw_order_events(spark, sf)
    I.store_batch(spark, raw, 0, paths, "p", report)
    assert not kept and freed and report.inserted == IO.stored(spark, paths.table).count()
    I.store_batch(spark, raw, 1, paths, "p", report)                   # a batch that inserts nothing
    assert report.last["inserted"] == 0 and report.last["duplicates"] == report.last["batch_rows"] and report.total == report.inserted