"""Language identification by compression: the language whose dictionary encodes the text in the fewest bytes.

``train`` builds one Zstandard raw-content dictionary per language from a bounded sample of labelled rows:
of the first ``SAMPLE_CHARS`` characters of each text the ``SAMPLE_ROWS`` with the smallest hash (one of each set of
equal ones), cut to ``DICT_BYTES``. ``identify`` encodes every whole text against every dictionary, in consecutive
blocks of ``BLOCK`` bytes that each start afresh from the dictionary. (In one frame the text's own history soon takes
the dictionary's place, so that only the head would tell languages apart and the margin would vanish with length.) The
smallest sum of sizes names the language; the score is the margin to the second smallest, as a share of it. A text is
rejected (``accepted`` false) when that margin is below ``MIN_MARGIN`` or ``MIN_BYTES``.

Null texts and texts without a letter are ``und`` with score 0 and not accepted. Equal sizes (a tie) go to the
first language by name and are rejected. With no labelled row every text is ``und``. With a single language the score
is 1. Rows with a null doc_id are predicted but never learned from, and their ``held_out`` is null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillwise.llm.common import utf8

FOLDS = 5
SAMPLE_ROWS = 400        # labelled rows per language that a dictionary may draw on
SAMPLE_CHARS = 4_000     # most of a text that it draws on
DICT_BYTES = 32 << 10    # size of a dictionary
MAX_LANGUAGES = 1_000    # dictionaries are broadcast: at most 32 MB; more languages raise an error
BLOCK = 2 << 10          # bytes of a text encoded from the dictionary alone; far below its size, so that all count alike
LEVEL = 6
MIN_MARGIN = 0.002       # narrowest margin, as a share of the second smallest size ...
MIN_BYTES = 2            # ... and in bytes


#: ASCII characters that tell nothing about the language: digits, marks and control characters but the space.
DROPPED = bytes(c for c in range(128) if not chr(c).isalpha() and c != 32)


def letters(text: str) -> bytes:
    """The whole text in lower case, without ``DROPPED``: what dictionaries hold and what is encoded."""
    return utf8(text.lower()).translate(None, DROPPED)


def held_out() -> Column:
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS) == 0


def _dictionary(pdf: pd.DataFrame) -> pd.DataFrame:
    """One language's sample -> its dictionary. zstd favours the end, so the smallest hashes come last."""
    data = b" ".join(letters(t) for t in pdf.sort_values(["h", "text"], ascending=False)["text"])
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "content": [data[-DICT_BYTES:]]})


def train(labelled: DataFrame) -> list[tuple[str, bytes]]:
    """(lang, dictionary), sorted by lang, from rows with ``text`` and ``lang``; nulls are left out."""
    rows = (labelled.select("lang", "text").filter("lang is not null and text is not null")
            .filter(F.length("text") > 0).withColumn("text", F.substring("text", 1, SAMPLE_CHARS)).withColumn("h", F.xxhash64("text")))
    # Per task at most SAMPLE_ROWS different texts of a language leave the map side (WindowGroupLimit by dense rank).
    w = Window.partitionBy("lang").orderBy("h", "text")
    sample = (rows.withColumn("r", F.dense_rank().over(w)).filter(F.col("r") <= SAMPLE_ROWS)
              .groupBy("lang", "text").agg(F.min("h").alias("h")))
    dicts = (sample.groupBy("lang").applyInPandas(_dictionary, "lang string, content binary")
             .limit(MAX_LANGUAGES + 1).collect())
    if len(dicts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: dictionaries would outgrow a broadcast")
    return sorted((r["lang"], bytes(r["content"])) for r in dicts)


class Classifier:
    """Compressors of one Python worker."""

    def __init__(self, dicts: list[tuple[str, bytes]]):
        self.langs = [k for k, _ in dicts]
        self.compressors = []
        for _, content in dicts:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False))

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        if not self.langs or text is None or not any(map(str.isalpha, text)):
            return "und", 0.0, False
        data = letters(text)
        blocks = [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]
        best = int(np.argmin(sizes))
        if len(sizes) == 1:
            return self.langs[0], 1.0, True
        second = min(s for i, s in enumerate(sizes) if i != best)
        gain = second - sizes[best]
        return self.langs[best], gain / second, gain >= MIN_BYTES and gain >= MIN_MARGIN * second


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, accepted."""
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    dicts = train(docs.filter(~held_out()))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, accepted boolean"
    return rows.mapInArrow(_arrow(docs.sparkSession.sparkContext.broadcast(dicts)), schema)


def _arrow(dicts):
    """Arrow batches, so that ids pass through as they are (pandas would turn a BIGINT with nulls into DOUBLE)."""
    def run(batches):
        c = Classifier(dicts.value)
        for b in batches:
            out = [c.classify(t) for t in b.column("text").to_pylist()]
            cols = [b.column(i) for i, n in enumerate(b.schema.names) if n != "text"]
            names = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()),
                 pa.array([x[2] for x in out], pa.bool_())], names=[*names, "lang_pred", "score", "accepted"])
    return run


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, with all their columns; the label column is left as it is."""
    dicts = docs.sparkSession.sparkContext.broadcast(train(docs.filter(~held_out())))
    cache: list[Classifier] = []

    @F.pandas_udf(T.BooleanType())
    def accepted(text: pd.Series) -> pd.Series:
        if not cache:
            cache.append(Classifier(dicts.value))
        return pd.Series([cache[0].classify(t)[2] for t in text], dtype=bool)

    return docs.filter(accepted("text"))
