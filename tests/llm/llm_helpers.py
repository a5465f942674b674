"""Small corpora for the tests of the corpus operators."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Further columns whose names the operators use themselves.
CLASHING = ", row string, rest string, g string, s string, p string, k1 long, k2 long, fp long, first boolean, n long, z string, spans string, h long, ids string"
SYLLABLES = {"en": "th er on an re he in ed nd ha at en es of or nt ea ti to it", "de": "sch ei ung der ich keit ber au en ver zu ge st ein lich",
             "fr": "eau oi eux tion ment que elle an ou ai les pa ier tre on"}


def prose(rnd: random.Random, n: int, lang: str = "en") -> str:
    syllables = SYLLABLES[lang].split()
    words = ["".join(rnd.choices(syllables, k=rnd.randint(1, 4))) for _ in range(n)]
    return " ".join(w + ("." if rnd.random() < 0.1 else "") for w in words)


def doc(i, text, lang="en", source="a"):
    return (i, text, lang, source, None if text is None else len(text))


def frame(spark, rows, clashing=False):
    if clashing:
        return spark.createDataFrame([(*r, *["x" if " string" in c else True if "boolean" in c else 7 for c in CLASHING.split(",")[1:]]) for r in rows], DOCS + CLASHING)
    return spark.createDataFrame(rows, DOCS)


def odd_rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids."""
    rnd = random.Random(5)
    long = prose(rnd, 30_000)
    return [doc(None, None, None, None), doc(None, "same text of a null id", None, None), doc(1, None), doc(2, ""), doc(3, " \n\t "), doc(4, long), doc(5, long),
            doc(6, "x"), doc(6, "x"), doc(7, "日本語のテキスト" * 80), doc(8, "é" * 900), doc(9, "ab" * 1000 + "\n" + "ab" * 700), doc(10, "#" * 500 + " ok"),
            doc(11, "Same Text Of A Null Id"), doc(12, "a\x1cb\xa0c d " * 40)]
