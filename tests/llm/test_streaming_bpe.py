import hashlib
import random
from array import array

import public_tokenizers as P
import pytest
from llm_helpers import doc, frame, odd_rows, prose
from tokenizers import Tokenizer

from fillwise.llm import queries
from fillwise.llm import streaming_bpe as B

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def strange_texts():
    rnd = random.Random(3)
    kinds = ["aAbB", "the an in er re on", "'srtvmld ", "é́à̂ñ", "日本語のテキスト中文", "가각ㄱ각", "a1 2\t3\n", "!?.…'\"<|>", "ΣςσİIı", "ก็ำ", "اَلْعَرَ", "  \u0085\x1c\x00",
             "😂❤️🇺🇸", "ﬁǅ²½Ⅷ"]
    out = ["", " ", "'", "'r", "it's we're they'LL 'tis 'RE", "<|startoftext|>a<|endoftext|>", "x<|startoftex <|endoftext|><|endoftext|>́é", "<|", "<|endoftext|", "a" * 5000,
           "ab" * 4000, "thethe" * 1500, "!" * 3000 + "'s", "a" * 4096 + "'re", "日本" * 5000, "é" * 4099, "가" * 4200, "e" + "́" * 50, "😂" * 1500]
    for _ in range(300):
        out.append("".join(rnd.choice(rnd.choice(kinds)) for _ in range(rnd.randint(1, 60))))
    for kind in kinds:
        out.append("".join(rnd.choices(kind, k=9000)))
    return out + ["".join(rnd.choices("theanirongstlydc", k=20_000))]


def test_ids_and_text_equal_the_library(library):
    transducer, decoder = B.Transducer(B.Rules(PATH), PATH), B.Decoder(B.Rules(PATH))
    for text in strange_texts():
        want = library.encode(text, add_special_tokens=False).ids
        assert transducer.whole(text) == want, text[:80]
        assert decoder.feed(want) + decoder.finish() == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("size", [1, 2, 7, 500])
def test_any_chunks_give_the_same_ids(monkeypatch, library, size):
    monkeypatch.setattr(B, "CHUNK", 40)        # pre-tokens beyond it are streamed
    transducer = B.Transducer(B.Rules(PATH), PATH)
    for text in strange_texts():
        if len(text) > 3000 * size:
            continue
        out = []
        for i in range(0, len(text), size):
            out += transducer.feed(text[i:i + size])
        out += transducer.finish()
        assert out == library.encode(text, add_special_tokens=False).ids, text[:80]


def test_a_long_pre_token_is_held_in_a_window_only(library):
    rules = B.Rules(PATH)
    text = "".join(random.Random(8).choices("theanirongstlydc", k=60_000))
    token, ids, most = B.PreToken(rules, B.Transducer(rules, PATH).merge), [], 0
    for i in range(0, len(text), 100):
        ids += token.feed(text[i:i + 100])
        most = max(most, len(token.held))
    assert ids + token.finish() == library.encode(text, add_special_tokens=False).ids
    assert most <= 2 * rules.lookahead + 101


def naive(merges, symbols):
    symbols = list(symbols)
    for x, y in merges:
        i = 0
        while i < len(symbols) - 1:
            if symbols[i] == x and symbols[i + 1] == y:
                symbols[i:i + 2] = [x + y]
            i += 1
    return symbols


def test_lookahead_is_enough_for_any_merge_list():
    """Over random proper merge lists: tokens that end ``lookahead`` symbols before the end never change."""
    rnd, used = random.Random(5), set()
    for _ in range(150):
        tokens, merges = list("abc"), []
        for _ in range(rnd.randint(1, 14)):
            x, y = rnd.choice(tokens), rnd.choice(tokens)
            if x + y not in tokens and len(x + y) < 9:
                tokens.append(x + y)
                merges.append((x, y))
        ahead = B.lookahead(merges, len)
        for _ in range(40):
            text = "".join(rnd.choices("abc", k=60))
            whole = naive(merges, text)
            n = rnd.randint(ahead, 60) if ahead <= 60 else 60
            at, part = 0, naive(merges, text[:n])
            for k, t in enumerate(part):
                at += len(t)
                if at > n - ahead:
                    break
                assert whole[k] == t, (merges, text, n, ahead)
            used.add(n - ahead > 0 and whole[:len(part)] != part)
    assert used == {True, False}


def test_lookahead_of_a_chain():
    # abcd e ... : each rule takes the place one token further to the left, once what follows is known.
    chain = [("d", "e"), ("c", "d"), ("b", "c"), ("a", "b")]
    assert B.lookahead(chain, len) == 4 and naive(chain, "abcd")[0] != naive(chain, "abcde")[0]
    with pytest.raises(ValueError):
        B.lookahead([("ab", "c"), ("a", "b")], len)
    with pytest.raises(ValueError):
        B.lookahead([("a", "b"), ("ab", "c"), ("b", "c"), ("a", "bc")], len)


def test_surface_decoding_gives_words_back_whatever_the_chunks():
    rules = B.Rules(PATH)
    transducer, decoder = B.Transducer(rules, PATH), B.Decoder(rules, surface=True)
    ids = transducer.whole("Ünï 日本語 😂 words")
    text = "".join(decoder.feed([i]) for i in ids) + decoder.finish()
    assert text == "ünï 日本語 😂 words " and decoder.feed(ids) + decoder.finish() == text
    byte = next(i for i, t in rules.strings.items() if t == B.byte_letters()[0xE6])
    assert decoder.feed([byte]) == "" and decoder.finish() == "�"


def test_few_remembered_words_change_nothing(monkeypatch, library):
    monkeypatch.setattr(B, "REMEMBERED", 3)
    import pyarrow as pa
    texts = [prose(random.Random(i), 30, "fr") for i in range(20)]
    words = B.WordIds(B.Transducer(B.Rules(PATH), PATH))
    for text in texts:
        assert B.encode_texts(pa.array([text]), words) == [array("I", library.encode(text, add_special_tokens=False).ids).tobytes()]


def test_query_against_the_library(spark, tmp_path, library):
    rows = [doc(100 + i, t) for i, t in enumerate(strange_texts())] + odd_rows()
    frame(spark, rows, clashing=True).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(map(str, r)) for r in queries.op13_streaming_bpe(spark, str(tmp_path)).collect())
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((str(r[0]), str(len(ids)), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)


def test_empty_table(spark):
    assert B.decode(B.encode(frame(spark, []), PATH), PATH).count() == 0
