import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import doc, frame, odd_rows, prose

from fillwise.llm import periodic_runs as P
from fillwise.llm import queries
from fillwise.llm.recompression import Grammar

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute_runs(w):
    """Runs (start, length, period) of a list of words: for each period the maximal stretches of agreement."""
    best = {}
    for q in range(1, len(w) // 2 + 1):
        s = None
        for i in range(len(w) - q + 1):
            if i < len(w) - q and w[i] == w[i + q]:
                s = i if s is None else s
            elif s is not None:
                length = i - s + q
                if length >= 2 * q:
                    best.setdefault((s, length), q)
                s = None
    return sorted((s, n, q) for (s, n), q in best.items() if n >= 12)


def brute(doc_id, text, plant=False):
    w = WORD.findall(text or "")
    n = len(w)
    if plant and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = set()
    for s, length, q in runs:
        gone.update(range(s + q, s + length))
    return runs, " ".join(x for i, x in enumerate(w) if i not in gone), n


@pytest.mark.parametrize("letters", [1, 2, 3, 12])
def test_extensions_against_plain_comparison(letters):
    rng = np.random.default_rng(letters)
    for round_ in range(60):
        n = int(rng.integers(1, 90))
        s = rng.integers(0, letters, n)
        if round_ % 3 == 0:
            s = np.resize(s[:int(rng.integers(1, 9))], n)
            s[rng.integers(0, n)] = letters
        i, j = np.triu_indices(n + 1, 1)
        got = Grammar(s).extension(i, j)
        for a, b, g in zip(i.tolist(), j.tolist(), got.tolist()):
            k = 0
            while b + k < n and s[a + k] == s[b + k]:
                k += 1
            assert g == k, (s, a, b)


def test_levels_shrink():
    for s in (np.random.default_rng(0).integers(0, 500, 20_000), np.zeros(20_000, np.int64), np.resize(np.arange(7), 20_000)):
        g = Grammar(s)
        assert sum(len(x.symbols) for x in g.levels) < 6 * len(s) and len(g.levels) < 60


@pytest.mark.parametrize("points", [P.POINTS, 50])
def test_runs_against_brute_force(monkeypatch, points):
    monkeypatch.setattr(P, "POINTS", points)
    monkeypatch.setattr(P, "HELD", points)
    rnd = random.Random(2)
    texts = []
    for _ in range(400):
        letters = rnd.choice(["a", "ab", "abc", "abcdefgh"])
        base = rnd.choices(letters, k=rnd.randint(0, 70))
        if rnd.random() < 0.5 and base:
            unit = rnd.choices("abcdefghijk", k=rnd.randint(1, 9))
            base[rnd.randint(0, len(base)):0] = (unit * 9)[:rnd.randint(1, 9 * len(unit))]
        texts.append(" ".join(base))
    flat, words, ends = P.words_of(pa.array(texts))
    rows = P.find_runs(words, ends).tolist()
    want = [[k, *r] for k, t in enumerate(texts) for r in brute_runs(t.split())]
    assert rows == want and len(want) > 200
    assert P.collapsed(flat, ends, np.array(rows)).to_pylist() == [brute(None, t)[1] for t in texts]


def corpus():
    rnd = random.Random(9)
    unit = prose(rnd, 7)
    rows = [doc(i, prose(rnd, rnd.choice([0, 1, 5, 11, 12, 40, 200])) + (" " + unit) * rnd.choice([0, 0, 1, 2, 5])) for i in range(120)]
    return rows + [doc(300, "x " * 500), doc(301, "\t a b \v a b\f" * 9), doc(302, "a b " * 3000 + "c " * 20)] + [
        r for r in odd_rows() if not r[1] or len(r[1]) < 9000]


def test_operator_and_its_odd_rows(spark):
    rows = corpus()
    got = P.periodic_runs(frame(spark, rows, clashing=True).repartition(6)).collect()
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got)
    want = []
    for r in rows:
        runs, text, n = brute(r[0], r[1])
        want.append((str(r[0]), n, runs, text))
    assert got == sorted(want)


def test_a_very_long_text(spark):
    rnd = random.Random(1)
    unit = prose(rnd, 1000).split()
    text = " ".join(unit * 40 + ["end"] + prose(rnd, 30_000).split())
    r = P.periodic_runs(frame(spark, [doc(1, text)])).first()
    assert (0, 40_000, 1000) in [tuple(x) for x in r.runs] and len(r.collapsed.split()) <= 31_001


def test_query_against_brute_force(spark, tmp_path):
    rows = corpus()
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    want = {}
    planted = 0
    for r in rows:
        runs, text, n = brute(r[0], r[1], plant=True)
        planted += r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0 and n > 20
        s, length, q = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        want.setdefault(r[0], []).append((len(runs), s, length, q, 1000 * length // q if runs else None,
                                          hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert planted > 4
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}


def test_empty_table(spark):
    assert P.periodic_runs(frame(spark, [])).count() == 0
