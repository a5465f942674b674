import difflib
import random

from llm_helpers import doc, frame, odd_rows, prose

from fillwise.llm import license_scan as L


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def test_increasing_subsequence():
    rnd = random.Random(1)
    for _ in range(200):
        x = [rnd.randrange(30) for _ in range(rnd.randrange(12))]
        got = [x[k] for k in L.increasing(x)]
        assert all(a < b for a, b in zip(got, got[1:]))
        want = 0
        for mask in range(1 << len(x)):
            pick = [x[k] for k in range(len(x)) if mask >> k & 1]
            if all(a < b for a, b in zip(pick, pick[1:])):
                want = max(want, len(pick))
        assert len(got) == want


def test_alignment_is_an_increasing_match_close_to_the_longest():
    rnd = random.Random(2)
    short = 0
    for _ in range(200):
        b = [rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(1, 25))]
        a = [w for w in b if rnd.random() < 0.8] + [rnd.choice("abcxyz") for _ in range(rnd.randrange(6))]
        got = L.align(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(i < k and j < m for (i, j), (k, m) in zip(got, got[1:]))
        short += lcs(a, b) - len(got)
    assert short < 60 and L.align([], ["a"]) == [] == L.align(["a"], [])


def test_planted_notices_and_texts_are_found_and_prose_is_not(spark):
    rnd = random.Random(3)
    rows, want = [], set()
    for i in range(60):
        text = prose(rnd, rnd.choice([3, 200, 2000]))
        if i % 2:
            name = rnd.choice(sorted(L.TEMPLATES))
            words = L.TEMPLATES[name].split()
            if len(words) > 20:                                   # one word in twenty is lost or changed
                words = [w for w in words if rnd.random() > 0.05]
            at = rnd.randrange(len(text))
            text = text[:at] + "\n" + " ".join(words).swapcase() + "\n" + text[at:]
            want.add((i, name))
        rows.append(doc(i, text))
    got = L.scan(frame(spark, rows)).collect()
    found = {(r.doc_id, r.license) for r in got}
    assert want <= found
    related = {"apache-2.0": {"apache-2.0-notice"}, "gpl-3.0": {"gpl-3.0-notice"}}
    assert {(i, n) for i, n in found - want} <= {(i, n) for i, w in want for n in related.get(w, set())}
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        span = [w for w, _, _ in L.words_of(texts[r.doc_id][r.start:r.end])]
        template = [w for w, _, _ in L.words_of(L.TEMPLATES[r.license])]
        assert r.matched <= sum(m.size for m in difflib.SequenceMatcher(None, span, template, False).get_matching_blocks()) + 5
        assert r.coverage == r.matched / r.template_words >= L.COVERAGE


def test_no_reachable_match_is_passed_over():
    """Coverage of every window, by plain longest common subsequence, against the scanner's."""
    rnd = random.Random(4)
    s = L.Scanner({"t": "one two three four five six seven eight nine ten"}, 0.8)
    words = "one two three four five six seven eight nine ten x y".split()
    for _ in range(300):
        text = rnd.choices(words, k=rnd.randrange(0, 14))
        if rnd.random() < 0.5:
            text = [w for w in words[:10] if rnd.random() < 0.9] + text
        full = lcs(text, words[:10])
        got = s.scan(" ".join(text))
        if len(set(text)) == len(text):                            # without repeats patience finds the longest
            assert bool(got) == (full >= 8) and (not got or got[0][2] == full)
        assert not got or got[0][2] <= full


def test_odd_rows_and_empty_table(spark):
    rows = odd_rows() + [doc(None, "All rights reserved."), doc(70, "ALL RIGHTS, reserved"), doc(70, "ALL RIGHTS, reserved"), doc(71, "license " * 3000)]
    got = sorted((str(r.doc_id), r.license, r.start, r.end) for r in L.scan(frame(spark, rows, clashing=True)).collect())
    assert got == [("70", "all-rights-reserved", 0, 20)] * 2 + [("None", "all-rights-reserved", 0, 19)]
    assert L.scan(frame(spark, [])).count() == 0
