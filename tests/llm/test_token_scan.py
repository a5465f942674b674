import random

import numpy as np
import public_tokenizers as P
import pyarrow.fs as pafs
import pytest
from llm_helpers import doc, frame, odd_rows, prose

from fillwise.llm import bpe, token_scan as T
from fillwise.llm.common import shared_folder

END = 9


def files_of(spark, contents):
    folder = shared_folder(spark, "tokens-test")
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    for name, ids in contents.items():
        with fs.open_output_stream(f"{base}/{name}.bin") as f:
            f.write(np.array(ids, "<u2").tobytes())
    return folder


def brute(ids):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == END:
            out.append((len(out), start, i - start, True))
            start = i + 1
    return out + ([(len(out), start, len(ids) - start, False)] if start < len(ids) else [])


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_scan_against_a_plain_loop(spark, block):
    rnd = random.Random(block)
    contents = {f"f{k}": [rnd.choice([1, 2, 3, END]) if rnd.random() < 0.6 else 5 for _ in range(n)] for k, n in enumerate([0, 1, 13, 14, 60])}
    contents |= {"ends": [END] * 9, "none": [1] * 20, "long": [1] * 30 + [END] + [2] * 3}
    folder = files_of(spark, contents)
    got = {}
    for r in T.scan(T.files(spark, folder), folder, END, block).collect():
        got.setdefault(r.file.removesuffix(".bin"), []).append((r.ordinal, r.start, r.n_tokens, r.terminated))
    assert {k: sorted(v) for k, v in got.items()} == {k: brute(v) for k, v in contents.items() if v}


def test_counts_of_written_documents(spark):
    rnd = random.Random(2)
    rows = odd_rows() + [doc(100 + i, prose(rnd, rnd.choice([1, 50, 400]))) for i in range(20)]
    path, folder = P.path("byte_bpe_50k.tiktoken"), shared_folder(spark, "tokens-test")
    encoded = bpe.encode(frame(spark, rows, clashing=True).repartition(3), path, P.PATTERN)
    order = T.write(encoded, folder, 50_256)
    got = T.named(T.scan(T.files(spark, folder, names=order.select("file").distinct()), folder, 50_256, block=777), order).collect()
    c = bpe.codec(path, P.PATTERN)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(r[0]), len(c.encode(r[1] or "")) // 4) for r in rows)
    assert all(r.terminated for r in got)


@pytest.mark.parametrize("bad", [70_000, -1, 1])
def test_ids_that_do_not_fit_are_refused(spark, bad):
    encoded = spark.createDataFrame([(1, [2, 3, bad])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="ids must fit"):
        T.write(encoded, shared_folder(spark, "tokens-test"), 1)


def test_empty_table(spark):
    folder = shared_folder(spark, "tokens-test")
    order = T.write(spark.createDataFrame([], "doc_id long, ids array<int>"), folder, 1)
    assert T.named(T.scan(T.files(spark, folder, names=order.select("file").distinct()), folder, 1), order).count() == 0
