import base64
import hashlib
import io
import random

import pyarrow as pa
import pytest
import zstandard
from llm_helpers import prose

from fillwise.llm import warc as W
from fillwise.llm.common import shared_folder

PAGES = "page_id long, url string, html string, sha string, first long, bundle string"


def expected(rows, min_bytes=0):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == data and r[0] is not None]
        refer = max(same) if same and len(data) >= min_bytes else None
        if refer == page:
            refer = None
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if refer is not None else "response", refer))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 4])
def test_archives_read_back(spark, min_bytes):
    rnd = random.Random(1)
    texts = [prose(rnd, rnd.choice([1, 30, 900])) for _ in range(30)] + ["", None, "é\r\n\r\nWARC/1.1\r\n\r\n", "abc"]
    rows = [(i, rnd.choice([None, "http://a/b c\r\nX: y", "http://é"]), rnd.choice(texts)) for i in range(120)] + [(500, "u", "twice"), (500, "u", "twice"), (None, None, "twice"), (None, None, "alone")]
    folder = shared_folder(spark, "warc-test")
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], PAGES).repartition(3)
    index = W.write(df, folder, min_bytes, frame_bytes=3000)
    got = W.read(index, folder).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows, min_bytes)
    html = {r[0]: (r[2] or "").encode() for r in rows if r[0] is not None}
    assert all(bytes(r.payload) == html[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)
    assert index.select("record_id").distinct().count() == len(rows) and index.select("bundle", "frame").distinct().count() > 6
    one = W.read(index.filter("page_id = 7"), folder).collect()
    assert [r.page_id for r in one] == [7]


def test_a_bundle_is_plain_zstandard_to_other_readers():
    class Kept(io.BytesIO):
        def close(self):
            pass
    sink = Kept()
    w = W.BundleWriter(sink)
    records = [W.record(f"urn:page:{i}", "http://x", b"p" * i, None) for i in range(5)]
    places = [w.add(r) for r in records[:3]]
    w.flush()
    places += [w.add(r) for r in records[3:]]
    w.close()
    raw = sink.getvalue()
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read() == b"".join(records)
    reader = W.BundleReader(pa.BufferReader(raw))
    assert [f for f, _ in places] == [0, 0, 0, 1, 1]
    assert all(reader.frame(f)[o:o + len(r)] == r for (f, o), r in zip(places, records))
    broken = bytearray(raw)
    broken[-9 - 12 * 2 + 8] ^= 1
    with pytest.raises(ValueError):
        W.BundleReader(pa.BufferReader(bytes(broken))).frame(0)


def test_empty_table(spark):
    folder = shared_folder(spark, "warc-test")
    assert W.read(W.write(spark.createDataFrame([], "page_id long, url string, html string"), folder), folder).count() == 0
