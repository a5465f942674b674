import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from llm_helpers import doc, frame, odd_rows, prose

from fillwise.llm import resampling as R

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def grams(text):
    words = WORD.findall(lower(text))
    return words, [" ".join(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute(rows, target):
    """Rows (doc_id, n_words, n_features, weight, score, rank), plainly."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(), Counter()
    for counts, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            counts.update(map(bucket, grams(text)[1]))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in range(10_000)}
    out = []
    for r in rows:
        words, features = grams(r[1])
        h = int(hashlib.sha256(f"42:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in features)
        out.append([r[0], len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0], -r[3], -r[2]))
    for k, r in enumerate(fit):
        r.append(k + 1 if k < 5 * len(fit) // 100 else None)
    return [tuple(r) if len(r) == 6 else (*r, None) for r in out]


def corpus():
    rnd = random.Random(4)
    rows = [doc(i, prose(rnd, rnd.choice([3, 19, 20, 21, 60, 200]), rnd.choice(["en", "de", "fr"]))) for i in range(150)]
    rows += [doc(200, "w" * 70 + " " + "é" * 200 + " x " + "y" * 1000 + " end " * 30), doc(201, "A-B_c[d]e{f}0/9:z\x7fé\x80 nul\x00nul " * 9)]
    return rows + odd_rows(), [prose(rnd, 80) for _ in range(20)] + [None, "", "w" * 70]


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:5], r[5] or 0)


@pytest.mark.parametrize("block", [R.BLOCK, 200])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK", block)
    rows, target = corpus()
    got = R.resample(frame(spark, rows, clashing=True).repartition(7), spark.createDataFrame([(t, 1) for t in target], "text string, k1 int")).collect()
    want = brute(rows, target)
    assert sum(1 for r in want if r[5]) >= 4
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_pieces_of_long_texts_have_the_same_features(monkeypatch):
    text = lower(corpus()[0][10][1] * 30 + "x" * 500 + " end of it").encode()
    whole = R.features([text], R.Checksums())
    monkeypatch.setattr(R, "BLOCK", 64)
    found = [R.features(parts, R.Checksums(), 3, context) for _, parts, context in R.blocks([text], 3)]
    assert len(found) > 20
    assert Counter(whole[1].tolist()) == Counter(x for f in found for x in f[1].tolist())
    assert whole[2].sum() == sum(f[2].sum() for f in found)


def test_few_remembered_words_change_nothing(monkeypatch):
    texts = [lower(r[1]).encode() for r in corpus()[0][:40]]
    want = R.features(texts, R.Checksums())
    monkeypatch.setattr(R, "REMEMBERED", 10)
    small = R.Checksums()
    R.features(texts[:20], small)
    got = R.features(texts, small)
    assert all((a == b).all() for a, b in zip(got, want))


def test_ties_go_to_the_smaller_id_and_repeated_rows_are_drawn_each(spark):
    rows = [doc(7, "one two " * 20)] * 60 + [doc(None, "one two " * 20)] * 2
    got = R.resample(frame(spark, rows), spark.createDataFrame([("one two",)], "text string"), percent=100).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 63)) and len({r["weight"] for r in got}) == 1


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert R.resample(empty, empty).count() == 0
    got = R.resample(frame(spark, [doc(1, None), doc(2, "a b")]), empty).collect()
    assert [(r["doc_id"], r["n_features"], r["weight"] == 0, r["rank"]) for r in sorted(got)] == [(1, 0, True, None), (2, 3, False, None)]
