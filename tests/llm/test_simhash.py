import random

import numpy as np
import pytest
import xxhash
from llm_helpers import doc, frame, odd_rows, prose

from fillwise.llm import simhash as S


def brute_fingerprint(text):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fps = [brute_fingerprint(r[1]) for r in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 2 and label[j] < label[i]:
                    label[i], changed = label[j], True
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((rows[i][0], f"{fps[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(7)
    base = [prose(rnd, rnd.choice([1, 2, 3, 20, 300])) for _ in range(30)]
    near = [t[:-4] + rnd.choice(["", "end"]) for t in base for _ in range(3)]
    return [doc(i, t) for i, t in enumerate([*base, *near, base[0].upper(), "", "", "  "])]


def test_matches_brute_force(spark):
    rows = corpus() + [(None if r[0] is None else r[0] + 500, *r[1:]) for r in odd_rows() if not r[1] or len(r[1]) < 9000]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(frame(spark, rows, clashing=True)).collect()), key=str)
    assert got == brute_components(rows)


def close_fingerprints(n, seed=3):
    """Many fingerprints one or two bits apart in chains, and as many strangers."""
    rnd = random.Random(seed)
    out, x = [], rnd.getrandbits(64)
    for _ in range(n):
        x ^= 1 << rnd.randrange(64)
        if rnd.random() < 0.3:
            x ^= 1 << rnd.randrange(64)
        if rnd.random() < 0.1:
            x = rnd.getrandbits(64)
        out.append(x)
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("split", [S.SPLIT, 4])
def test_links_connect_all_close_fingerprints(spark, monkeypatch, split):
    monkeypatch.setattr(S, "SPLIT", split)
    rnd = random.Random(8)
    core = rnd.getrandbits(64)
    hot = [core ^ (1 << a) for a in range(24)]                       # one bucket with many
    fps = list(dict.fromkeys(close_fingerprints(300) + hot))
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    edges = [(int(np.int64(r.a).view(np.uint64)), int(np.int64(r.b).view(np.uint64))) for r in S.links(df).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in edges)
    import collections
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        parent[root(a)] = root(b)
    mine = collections.defaultdict(set)
    for x in fps:
        mine[root(x)].add(x)
    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= 2:
                assert root(x) == root(y)


def test_pivots_never_discard_a_close_pair():
    fps = np.array(close_fingerprints(400, 11), np.uint64)
    i, j = S.close_pairs(fps, fps)
    want = {(a, b) for a in range(len(fps)) for b in range(len(fps)) if int(fps[a] ^ fps[b]).bit_count() <= 2}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_rows_that_share_an_id_are_judged_by_their_own_groups(spark):
    rnd = random.Random(6)
    a, b, c = (prose(rnd, 60) for _ in range(3))
    rows = [doc(1, a), doc(1, b), doc(2, a), doc(3, b), doc(None, c), doc(None, c), doc(None, a), doc(4, None), doc(5, "")]
    kept = sorted((str(r.doc_id), r.text or "") for r in S.keep_one(frame(spark, rows, clashing=True)).collect())
    assert kept == sorted([("1", a), ("1", b), ("None", c), ("4", "")])


def test_one_document_of_each_group_stays(spark):
    rows = corpus() + [doc(900, "repeated row"), doc(900, "repeated row"), doc(None, "no id"), doc(None, None)]
    df = frame(spark, rows, clashing=True)
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted({c for i, _, c in brute_components(rows) if i is not None and i == c})
    # The row without an id and without text is of the group of the empty texts, where a document has an id.
    assert [r.text for r in kept.filter("doc_id is null").collect()] == ["no id"]
    assert S.keep_one(frame(spark, [])).count() == 0 and S.near_duplicates(frame(spark, [])).count() == 0
