"""The keys of the stored events, bucketed by signature: inserts that don't shuffle what is stored (S5, J4), and lookups
that open few files (P8, P12).

Below one folder lies a Parquet table of the keys and where their rows lie (``ym``, ``batch_id``), clustered into a fixed
number of buckets and partitioned into *runs*: a run holds the keys that the batches ``first`` to ``last`` inserted.  A
batch adds one small run; ``FANOUT`` runs of a level become one of the next, so after n batches about ``FANOUT · log n``
runs exist and a key is rewritten ``log n`` times.  ``seen`` joins a batch to the runs of earlier batches bucket by bucket:
the batch is shuffled into the buckets, the stored keys are read where they lie.  ``find`` reads the buckets of the asked
signatures only, and ``rows`` then only the table's folders that the keys name.

A run counts once its marker file exists.  A batch that is tried again overwrites its own run and looks only at runs of
earlier batches; runs are merged only when every one of their batches is earlier than the current one, so a retry always
finds the keys it found before.  One writer at a time.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwise.schema import DEDUP_KEY
from fillwise.sources.io import stored

FANOUT = 8
COLUMNS = ("signature", "event_type", "ym", "batch_id")
KEYS = "signature STRING, event_type STRING, ym INT, batch_id BIGINT"
_RUN = re.compile(r"(\d+)_(-?\d+)_(-?\d+)")


class KeyStore:
    """The key table under ``root``.

    ``buckets`` (default: the session's shuffle partitions) counts only when
    the store is made.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.root, self.fanout = spark, root.rstrip("/"), fanout
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        made = [int(n.partition("=")[2]) for n in self._names("_made") if n.startswith("buckets=")]
        self.buckets = made[0] if made else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not made:
            self._mark(f"_made/buckets={self.buckets}")
        self.table = f"fillwise_keys_{zlib.crc32(self.root.encode()):08x}"
        spark.sql(f"""CREATE TABLE IF NOT EXISTS {self.table} (signature STRING, event_type STRING, ym INT, batch_id BIGINT, run STRING) USING parquet
            PARTITIONED BY (run) CLUSTERED BY (signature) SORTED BY (signature) INTO {self.buckets} BUCKETS
            LOCATION '{self.root}/keys'""")

    # -- runs --------------------------------------------------------------
    def _names(self, folder: str) -> list[str]:
        p = self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def _mark(self, name: str) -> None:
        self._fs.create(self._path(f"{self.root}/{name}"), True).close()

    def runs(self, before: int) -> list[str]:
        """Names of the runs that hold the keys of batches earlier than ``before``, each batch in one of them."""
        found = sorted(((int(m[2]), int(m[3]), -int(m[1]), m[0]) for m in map(_RUN.fullmatch, self._names("_done")) if m and int(m[3]) < before),
                       key=lambda r: (r[0], -r[1], r[2]))
        out, covered = [], None
        for first, last, _, name in found:
            if covered is None or first > covered:        # a merged run stands before the runs it was made of
                out.append(name)
                covered = last
        return out

    def _read(self, names: list[str]) -> DataFrame:
        for name in names:
            self.spark.sql(f"ALTER TABLE {self.table} ADD IF NOT EXISTS PARTITION (run = '{name}') LOCATION '{self.root}/keys/run={name}'")
        return self.spark.table(self.table).where(F.col("run").isin(names)).select(*COLUMNS)

    def _write(self, keys: DataFrame, name: str) -> None:
        """A run, in at most one file a bucket; an earlier attempt is replaced."""
        for left in (f"_done/{name}", f"keys/run={name}"):
            self._fs.delete(self._path(f"{self.root}/{left}"), True)
        view = f"{self.table}_run"
        keys.select(*COLUMNS).repartition(self.buckets, "signature").createOrReplaceTempView(view)
        keys.sparkSession.sql(f"INSERT INTO {self.table} PARTITION (run = '{name}') SELECT {', '.join(COLUMNS)} FROM {view}")
        self._mark(f"_done/{name}")

    # -- the store ---------------------------------------------------------
    def seen(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Keys of ``batch`` that earlier batches inserted, each once."""
        names = self.runs(batch_id)
        if not names:
            return batch.select(*DEDUP_KEY).limit(0)
        # The signature alone is joined on, as the table is clustered by it; the kind is a condition beside it.
        wanted = batch.groupBy(F.col("signature").alias("s")).agg(F.collect_set("event_type").alias("kinds"))
        stored = self._read(names)
        same = (stored["signature"] == F.col("s")) & F.array_contains("kinds", stored["event_type"])
        return stored.join(wanted.hint("shuffle_hash"), same, "left_semi").select(*DEDUP_KEY).distinct()

    def find(self, signatures: Sequence[str], before: int = 1 << 62) -> DataFrame:
        """The stored keys of a short list of signatures; only their buckets' files are opened."""
        names = self.runs(before)
        return self._read(names).where(F.col("signature").isin(list(signatures))) if names else self.spark.createDataFrame([], KEYS)

    def rows(self, table: str, signatures: Sequence[str]) -> DataFrame:
        """P12 over the stored table: the events of a short list of signatures, read from the folders they lie in.

        The folders are at most two for each signature.
        """
        places = self.find(signatures).select("batch_id", "ym").distinct().collect()
        rows = stored(self.spark, table).where(F.col("signature").isin(list(signatures)))
        here = F.lit(False)
        for p in places:
            here = here | ((F.col("batch_id") == p["batch_id"]) & (F.col("ym") == p["ym"]))
        return rows.where(here)

    def add(self, inserted: DataFrame, batch_id: int) -> None:
        """Keys (with ``ym``) that batch ``batch_id`` inserted; then levels that are full are merged."""
        self._write(inserted.withColumn("batch_id", F.lit(int(batch_id)).cast("bigint")), f"0_{int(batch_id)}_{int(batch_id)}")
        while True:
            levels: dict[int, list[str]] = {}
            for name in self.runs(batch_id):
                levels.setdefault(int(name.partition("_")[0]), []).append(name)
            full = next((names for _, names in sorted(levels.items()) if len(names) >= self.fanout), None)
            if full is None:
                return
            level = int(full[0].partition("_")[0]) + 1
            parts = self.spark.read.parquet(*[f"{self.root}/keys/run={n}" for n in full])
            self._write(parts, f"{level}_{full[0].split('_')[1]}_{full[-1].split('_')[2]}")

    def drop_merged(self, before: int) -> None:
        """Delete runs that a merged run stands for; not needed for right results."""
        live = set(self.runs(before))
        for name in self._names("_done"):
            m = _RUN.fullmatch(name)
            if m and int(m[3]) < before and name not in live:
                self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS PARTITION (run = '{name}')")
                self._fs.delete(self._path(f"{self.root}/_done/{name}"), False)
                self._fs.delete(self._path(f"{self.root}/keys/run={name}"), True)
