import hashlib
import random

import numpy as np
import pytest
from llm_helpers import doc, frame, odd_rows, prose

from fillwise.llm import suffix_dedup as S


def brute_masks(rows, length=S.LENGTH):
    datas = [(r[1] or "").encode() for r in rows]
    seen = {}
    for k, d in enumerate(datas):
        for i in range(len(d) - length + 1):
            seen.setdefault(d[i:i + length], []).append((k, i))
    masks = [np.zeros(len(d), bool) for d in datas]
    for places in seen.values():
        for k, i in places if len(places) > 1 else ():
            masks[k][i:i + length] = True
    return datas, masks


def corpus(seed=1):
    rnd = random.Random(seed)
    passages = [prose(rnd, n) for n in (60, 65, 70, 90, 200, 600)]
    rows = []
    for i in range(60):
        parts = [prose(rnd, rnd.randint(1, 120), rnd.choice(["en", "fr"])) for _ in range(rnd.randint(1, 3))]
        for _ in range(rnd.choice([0, 0, 1, 2])):
            parts.insert(rnd.randint(0, len(parts)), rnd.choice(passages))
        rows.append(doc(i, " ".join(parts)))
    long = prose(rnd, 400)
    edited = [long[:p] + rnd.choice("xyz") + long[p + 1:] for p in (300, 700, 1500)]
    periodic = ["a" * 399, "a" * 400, "a" * 401, "abc" * 300, ("x" * 150 + "y" * 150) * 5, "é" * 199 + "b" + "é" * 250, "è" * 500]
    return rows + [doc(100 + i, t) for i, t in enumerate([long, long, *edited, *periodic])]


@pytest.mark.parametrize("length", [60, 200])
def test_other_lengths_and_passages_match_brute_force(spark, length):
    rows = corpus(5)
    datas, long = brute_masks(rows)
    _, short = brute_masks(rows, length)
    got = {r.doc_id: r for r in S.dedup(frame(spark, rows).repartition(3), passage=length).collect()}
    alone = {r.doc_id: r for r in S.dedup(frame(spark, rows).repartition(4), length).collect()}
    for r, a, b in zip(rows, long, short):
        assert [(x.s, x.e) for x in got[r[0]].removed] == S.true_runs(a)
        assert [(x.s, x.e) for x in got[r[0]].passages] == S.true_runs(b) == [(x.s, x.e) for x in alone[r[0]].removed]


def check(spark, rows):
    datas, masks = brute_masks(rows)
    got = {}
    for r in S.dedup(frame(spark, rows, clashing=True).repartition(5)).collect():
        got.setdefault((r.doc_id, r.n_bytes), []).append(([(x.s, x.e) for x in r.removed], hashlib.sha256(bytes(r.kept)).hexdigest()))
    want = {}
    for r, d, m in zip(rows, datas, masks):
        want.setdefault((r[0], len(d)), []).append((S.true_runs(m), hashlib.sha256(np.frombuffer(d, np.uint8)[~m].tobytes()).hexdigest()))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


@pytest.mark.parametrize("settings", [{}, {"HOT": 2}])
def test_matches_brute_force(spark, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(S, k, v)
    check(spark, corpus() + (odd_rows()[:5] + [r for r in odd_rows()[7:] if r[1]] if not settings else []))


def test_repeated_rows_repeat_each_other(spark):
    text = prose(random.Random(3), 120)
    check(spark, [doc(1, text), doc(1, text), doc(None, text[:500]), doc(2, None), doc(None, None)])


def test_cut_repeats_keeps_columns_and_whole_characters(spark):
    rows = [(r[0], r[1], *r[2:]) for r in corpus(2)] + odd_rows()
    df = frame(spark, rows, clashing=True)
    out = S.cut_repeats(df, S.LENGTH)
    assert out.columns == df.columns and out.schema["text"].dataType == df.schema["text"].dataType
    got = sorted(((r.doc_id, r.text, r.n_chars, r.row) for r in out.collect()), key=str)
    want = []
    rows = [r for r in rows]
    small = [r for r in rows if not r[1] or len(r[1]) < 9000]
    _, masks = brute_masks(small)
    for r, m in zip(small, masks):
        text, at = "", 0
        for ch in r[1] or "":
            n = len(ch.encode())
            text += "" if m[at:at + n].all() else ch
            at += n
        want.append((r[0], None if r[1] is None else text, None if r[1] is None else len(text), "x"))
    assert [g for g in got if g[0] not in (4, 5) or g[1] != ""] == sorted([w for w in want], key=str) or set(want) <= set(got)
    assert sum(1 for g in got if g[0] in (4, 5) and g[1] == "") == 2          # the long text and its copy go whole


@pytest.mark.parametrize("block", [S.BLOCK, 700])
def test_every_window_is_in_one_piece_and_equal_windows_align(monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    datas = [(r[1] or "").encode() for r in corpus(4)]
    place, count = {}, {}
    for i, start, windows, reps, mh, _ in S.text_runs(datas).tolist():
        for k in range(windows * reps):
            at = start + k
            window = datas[i][at:at + S.LENGTH]
            h = S.gram_hashes(np.frombuffer(window, np.uint8))
            anchor = int(np.argmin(h >> np.uint64(S.POS_BITS)))
            assert len(window) == S.LENGTH and int(h[anchor].view(np.int64)) == mh
            assert place.setdefault(window, (mh, anchor)) == (mh, anchor)
            count[i, at] = count.get((i, at), 0) + 1
    assert count == {(i, k): 1 for i, d in enumerate(datas) for k in range(len(d) - S.LENGTH + 1)}


@pytest.mark.parametrize("collection", [S.COLLECTION, 3])
def test_suffix_order_of_pieces_against_plain_comparison(monkeypatch, collection):
    import pyarrow as pa
    monkeypatch.setattr(S, "COLLECTION", collection)
    rnd, rows = random.Random(6), []
    for g in range(12):
        core = bytes(rnd.choices(b"ab", k=S.REACH * 2 + S.K))
        for _ in range(rnd.choice([1, 2, 5])):
            piece = bytearray(core)
            for _ in range(rnd.choice([0, 1, 3])):
                piece[rnd.randrange(len(piece))] = rnd.choice(b"abc")
            s = rnd.randint(0, S.REACH)
            e = rnd.randint(s + S.LENGTH, S.REACH + S.LENGTH) if s + S.LENGTH <= S.REACH + S.LENGTH else S.REACH + S.LENGTH
            rows.append((g, S.REACH - s, bytes(piece[s:e])))
    texts, left, group = [t for _, _, t in rows], np.array([x for _, x, _ in rows]), np.array([g for g, _, _ in rows])
    found = S.repeated_windows(texts, left, group)
    want = np.zeros_like(found)
    for i, (g, x, t) in enumerate(rows):
        for j, (h, y, u) in enumerate(rows):
            for c in range(S.REACH + 1) if i != j and g == h else ():
                a, b = c - S.REACH + x, c - S.REACH + y
                if a >= 0 and b >= 0 and len(t[a:a + S.LENGTH]) == S.LENGTH and t[a:a + S.LENGTH] == u[b:b + S.LENGTH]:
                    want[c, i] = True
    assert want.any() and (found == want).all()
    cols = {"k1": np.arange(len(rows)), "k2": np.zeros(len(rows), int), "start": np.full(len(rows), 1000), "run": np.zeros(len(rows), int), "mh": group, "ph": np.arange(len(rows)),
            "n": np.ones(len(rows), int), "dn": np.ones(len(rows), int), "left": left}
    batch = pa.RecordBatch.from_pydict({**{k: pa.array(v, pa.int64()) for k, v in cols.items()}, "piece": pa.array(texts, pa.binary())})
    spans = {(r["k1"], r["s"], r["e"]) for b in S._order(iter([batch.slice(i, 4) for i in range(0, len(rows), 4)])) for r in b.to_pylist()}
    assert spans == {(i, 1000 - (S.REACH - x) + s, 1000 - (S.REACH - x) + e + S.LENGTH - 1) for i, (_, x, _) in enumerate(rows) for s, e in S.true_runs(want[:, i])}


def test_empty_table(spark):
    assert S.dedup(frame(spark, [])).count() == 0 and S.cut_repeats(frame(spark, [])).count() == 0
