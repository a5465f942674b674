import random
import zlib

from llm_helpers import doc, frame, odd_rows, prose

from fillwise.llm import langid as L


def corpus(n=200):
    rnd = random.Random(4)
    return [doc(i, prose(rnd, rnd.randint(25, 200), lang), lang) for i, lang in ((i, ("en", "de", "fr")[i % 3]) for i in range(n))]


def test_held_out_accuracy(spark):
    rows = corpus()
    got = {r.doc_id: r for r in L.identify(frame(spark, rows)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r.held_out} == {r[0] for r in held}
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.97 * len(held)
    assert sum(r.accepted for r in got.values()) >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in got.values())


def test_prediction_ignores_label_source_and_id(spark):
    rows = corpus(90)
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    held = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 5 == 0)
    other = next(i for i in range(held + 1, 3000) if zlib.crc32(str(i).encode()) % 5 == 0)
    text = prose(random.Random(9), 60, "fr")
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(frame(spark, [*train, doc(held, text, "en", "s"), doc(other, text, None, None)])).collect()}
    assert got[held] == got[other] and got[held][0] == "fr"


def test_narrow_margins_are_rejected(spark):
    c = L.Classifier([("a", b"same words here"), ("b", b"same words here")])
    assert c.classify("same words here") == ("a", 0.0, False)


def classifier():
    return L.Classifier([(lang, L.letters(prose(random.Random(i), 12_000, lang))[-L.DICT_BYTES:]) for i, lang in enumerate(("de", "en", "fr"))])


def test_all_of_a_long_text_counts_alike():
    rnd, c = random.Random(12), classifier()
    for head, n, rest, m in (("de", 10_000, "en", 20_000), ("fr", 20_000, "en", 300_000), ("en", 20_000, "de", 300_000)):
        text = prose(rnd, n // 3, head)[:n] + " " + prose(rnd, m // 3, rest)[:m]
        assert c.classify(text)[0] == rest, (head, n, rest, m)
    de, en = prose(rnd, 40_000, "de")[:120_000], prose(rnd, 40_000, "en")[:60_000]
    assert c.classify(de + en)[0] == c.classify(en + de)[0] == "de"


def test_margin_does_not_fall_with_length():
    c = classifier()
    for lang in ("en", "de"):
        text = prose(random.Random(13), 500_000, lang)
        assert len(text) > 3_000_000
        short, whole = c.classify(text[:20_000]), c.classify(text)
        assert short[0] == whole[0] == lang and short[2] and whole[2] and whole[1] > 0.8 * short[1]


def test_language_of_long_texts_only_has_a_dictionary(spark):
    rnd = random.Random(14)
    rows = corpus(60) + [doc(100 + k, prose(rnd, 1_500, "fr"), "xx") for k in range(3)]
    rows = [r for r in rows if r[2] != "fr"]
    assert all(len(r[1]) > L.SAMPLE_CHARS for r in rows if r[2] == "xx")
    dicts = L.train(frame(spark, rows))
    assert [k for k, _ in dicts] == ["de", "en", "xx"] and all(0 < len(c) <= L.DICT_BYTES for _, c in dicts)
    assert L.Classifier(dicts).classify(prose(rnd, 200, "fr"))[0] == "xx"


def test_odd_rows(spark):
    rows = [(r[0] + 100, *r[1:]) for r in corpus(60)]
    df = frame(spark, rows + odd_rows(), clashing=True)
    got = L.identify(df).collect()
    assert len(got) == df.count() and {r.lang_pred for r in got} <= {"en", "de", "fr", "und"}
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    assert all(r.held_out is None for r in got if r.doc_id is None)
    kept = L.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == sum(r.accepted for r in got)
    assert L.identify(frame(spark, [])).count() == 0 and L.keep_identified(frame(spark, [])).count() == 0
    assert {r.lang_pred for r in L.identify(frame(spark, odd_rows()[2:5])).collect()} == {"und"}     # nothing to learn from
