import random

import numpy as np
from llm_helpers import doc, frame, odd_rows, prose

from fillwise.llm import quality as Q


def brute_stats(text):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_base_statistics_against_plain_definitions():
    rnd = random.Random(1)
    texts = [None, "", " ", "a b c", "a b c d e f g h " * 3, "x\ny\nx\n \nx", "é#\xa0b\x1c| <i>", "w " * 9, "w " * 8]
    texts += [" ".join(rnd.choices(["a", "b", "c#"], k=rnd.randint(1, 60))) + rnd.choice(["", "\n\n", "\na\na"]) for _ in range(60)]
    for t in texts:
        assert Q.text_stats(t)[:5] == brute_stats(t), repr(t)


def test_chi_square_quantiles():
    import math
    from statistics import NormalDist
    assert abs(NormalDist().cdf(math.sqrt(Q.chi2_quantile(0.95, 1))) - 0.975) < 1e-9
    assert abs(Q.chi2_quantile(0.99, 2) + 2 * math.log(0.01)) < 1e-9          # two degrees: exponential


def corpus(clean=320, junk=16):
    rnd = random.Random(2)
    rows = [doc(i, prose(rnd, rnd.randint(40, 400), lang) + "\n" + prose(rnd, 30, lang), lang, src)
            for i, (lang, src) in enumerate((lang, src) for lang in ("en", "de") for src in ("a", "b") for _ in range(clean // 4))]
    bad = [doc(1000 + i, " ".join(w + rnd.choice(["###", "%%%", "***"]) for w in prose(rnd, 120).split()), "en", "a") for i in range(junk // 2)]
    bad += [doc(2000 + i, prose(rnd, 120).upper(), "en", "a") for i in range(junk // 2)]
    return rows, bad


def test_outliers_go_and_clean_texts_stay(spark):
    rows, bad = corpus()
    got = {r.doc_id: r for r in Q.quality(frame(spark, rows + bad)).collect()}
    assert not any(got[r[0]].kept for r in bad)
    assert sum(got[r[0]].kept for r in rows) >= len(rows) - 1
    assert all(r.distance > 5 for r in got.values() if r.doc_id >= 1000)


def test_a_small_language_is_judged_by_the_scatter_of_all_rows(spark):
    """Junk of a language with few rows goes; its clean rows stay, though their words are unlike the others'."""
    rows, bad = corpus()
    rnd = random.Random(4)
    few = [doc(3000 + i, " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(7, 12))) for _ in range(rnd.randint(60, 200))), "xx", "a") for i in range(20)]
    junk = [doc(4000 + i, " ".join(w + rnd.choice(["###", "%%%"]) for w in prose(rnd, 120).split()).upper(), "xx", "a") for i in range(3)]
    got = {r.doc_id: r for r in Q.quality(frame(spark, rows + bad + few + junk)).collect()}
    assert all(got[r[0]].kept for r in few) and not any(got[r[0]].kept for r in junk + bad)
    assert sum(got[r[0]].kept for r in rows) >= len(rows) - 1
    alone = Q.quality(frame(spark, few + junk)).collect()
    assert all(r.kept for r in alone)                                          # fewer rows than an estimate takes


def test_estimate_is_close_to_a_plain_mcd(spark):
    """Location and scatter of one group against an exhaustive run of concentration steps from many random starts."""
    rnd = np.random.default_rng(3)
    x = np.round(rnd.normal([1.4, 0.1, 0.2, 0.3, 0.4], [0.2, 0.1, 0.15, 0.1, 0.1], (400, 5)) * Q.UNIT)
    x[:60] += np.round(np.array([2.0, 1.0, 1.0, 1.0, 1.0]) * Q.UNIT)
    rows = spark.createDataFrame([("k", *map(int, r)) for r in x], "g string, " + ", ".join(f"x{i} long" for i in range(5)))
    got = Q.fit(rows.repartition(3)).first()
    y, h, best = x / Q.UNIT, 300, None
    for _ in range(30):
        pick = rnd.choice(400, 8, replace=False)
        for _ in range(40):
            mean, cov = y[pick].mean(0), np.cov(y[pick].T, bias=True) + np.diag(np.square(Q.FLOOR))
            d = np.einsum("ij,jk,ik->i", y - mean, np.linalg.inv(cov), y - mean)
            pick = np.argsort(d, kind="stable")[:h]
        best = min(best or (9e9,), (np.linalg.slogdet(cov)[1], *mean))
    assert got.logdet <= best[0] + 0.2          # whole distance buckets: a little more than h rows
    assert np.allclose([got[f"m{i}"] for i in range(5)], best[1:], atol=0.03)


def test_odd_rows_empty_table_and_clashing_columns(spark):
    rows, bad = corpus(80, 4)
    df = frame(spark, rows + bad + odd_rows(), clashing=True)
    got = Q.quality(df).collect()
    assert len(got) == df.count()
    assert not any(r.kept for r in got if r.n_words < 20)
    kept = Q.keep_good(df)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in got)
    assert Q.quality(frame(spark, [])).count() == 0 and Q.keep_good(frame(spark, [])).count() == 0


def test_result_does_not_depend_on_partitions(spark):
    rows, bad = corpus(80, 8)
    a = Q.quality(frame(spark, rows + bad).repartition(1)).collect()
    b = Q.quality(frame(spark, rows + bad).repartition(7)).collect()
    assert {(r.doc_id, r.kept, r.distance) for r in a} == {(r.doc_id, r.kept, r.distance) for r in b}
