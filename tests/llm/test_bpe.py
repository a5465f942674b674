import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from llm_helpers import doc, frame, odd_rows, prose

from fillwise.llm import bpe as B

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def stitched(c, text, chunk, overlap):
    spans = B.chunk_spans(text, chunk, overlap)
    heads, tails = [1, *[e for _, e in spans[:-1]]], [*[s for s, _ in spans[1:]], len(text)]
    return B.stitch([B.encode_chunk(c, text[s:e], s, h, t, k == len(spans) - 1) for k, ((s, e), h, t) in enumerate(zip(spans, heads, tails))])


def test_chunks_give_the_ids_of_the_whole_text(plain):
    rnd, c = random.Random(1), B.codec(PATH, P.PATTERN)
    signs = ["a", "b", "é", "1", " ", "  ", "\n", "'s", "!", "\x1c", "日", "\t", "　", "'re", "\xa0", "'"]
    for _ in range(600):
        text = "".join(rnd.choice(signs) for _ in range(rnd.choice([0, 1, 5, 60, 400, 1500])))
        want = np.array(plain.encode_ordinary(text), "<i4")
        assert stitched(c, text, 40, 8) == want.tobytes(), repr(text)
        assert c.decode(want) == text.encode()


def test_long_runs_without_a_boundary(plain):
    c = B.codec(PATH, P.PATTERN)
    for text in ("x" * 3000, " " * 3000, "a " + " " * 900 + "b", "日" * 2000, ("y" * 700 + " ") * 5, "!" * 999 + "\n"):
        assert stitched(c, text, 100, 16) == np.array(plain.encode_ordinary(text), "<i4").tobytes()


@pytest.mark.parametrize("chunk", [B.CHUNK, 500, None])
def test_round_trip_of_a_table(spark, plain, chunk):
    rnd = random.Random(2)
    rows = odd_rows() + [doc(100 + i, prose(rnd, rnd.choice([5, 700]), "fr")) for i in range(12)] + [doc(50, prose(rnd, 900))] * 2
    df = B.decode(B.encode(frame(spark, rows, clashing=True).repartition(3), PATH, P.PATTERN, chunk), PATH, P.PATTERN)
    got = sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in df.collect())
    assert got == sorted((str(r[0]), plain.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows)


def test_empty_table(spark):
    assert B.decode(B.encode(frame(spark, []), PATH, P.PATTERN), PATH, P.PATTERN).count() == 0
