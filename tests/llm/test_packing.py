import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from llm_helpers import doc, frame, odd_rows, prose
from tokenizers import Tokenizer

from fillwise.llm import packing as K

PATH = P.path("word_bpe_49k.json")


def test_ids_are_the_tokenizers(spark):
    rnd, e, t = random.Random(3), K.WordEncoder(PATH), Tokenizer.from_file(PATH)
    signs = ["a", "Bc", "é", "É", "1", "23", " ", "\n", "'s", "'S", "!", "\x1c", "日", "Σ", "ß", "́", "<|endoftext|>", "<|EndOfText|>", "\xa0", "'re", "'", ".", "İ", "ÿ", "Ÿ", "ªµº", "×", "\t\r"]
    plain = [s for s in signs if K.PLAIN.fullmatch(s) and "<|" not in s]
    texts = ["".join(rnd.choice(rnd.choice([signs, plain])) for _ in range(rnd.choice([0, 1, 5, 40]))) for _ in range(1500)]
    texts += ["".join(rnd.choices(plain, k=30)) for _ in range(500)]
    got = e.encode(pa.array([*texts, None]))
    assert got[-1] == b""
    for text, ids in zip(texts, got):
        assert ids == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_level_is_the_one_with_the_smallest_sum_of_squares():
    rnd = random.Random(4)
    for _ in range(200):
        p = K.Packer(0, 16)
        p.levels[1:16] = [rnd.choice([0, 0, 1, 2, 5]) for _ in range(15)]
        size = rnd.randint(1, 15)

        def after(h):
            n = p.levels.copy()
            if h:
                n[h] -= 1
            if h + size < 16:
                n[h + size] += 1
            return int((n[1:16] ** 2).sum())
        choices = [0] + [h for h in range(1, 17 - size) if p.levels[h]]
        best = min(after(h) for h in choices)
        assert p.best_level(size) == max(h for h in choices if after(h) == best)


def check(rows, pieces, capacity):
    t = Tokenizer.from_file(PATH)
    want = sorted(((str(r[0]), tuple(t.encode(r[1] or "", add_special_tokens=False).ids) + (1,)) for r in rows))
    by_doc, fill = {}, {}
    for r in pieces:
        ids = tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())
        assert len(ids) == r.length
        by_doc.setdefault((str(r.doc_id), r.doc_tokens), []).append((r.start, ids))
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == capacity or at & (at - 1) == 0 and at <= capacity
    got = []
    for (doc_id, total), parts in by_doc.items():
        copies = sum(s == 0 for s, _ in parts)
        whole = [()] * copies
        for start, ids in sorted(parts):
            k = next(k for k in range(copies) if len(whole[k]) == start)
            whole[k] += ids
        assert all(len(w) == total for w in whole)
        got += [(doc_id, w) for w in whole]
    assert sorted(got) == want


def test_every_id_lies_in_one_piece_and_no_sequence_is_padded(spark):
    rnd = random.Random(5)
    rows = [doc(i, prose(rnd, rnd.choice([1, 10, 60, 300, 2500]))) for i in range(120)] + [r for r in odd_rows() if r[0] not in (4, 5)]
    for capacity in (64, 2048):
        check(rows, K.pack(frame(spark, rows, clashing=True).repartition(3), PATH, capacity).collect(), capacity)


def test_empty_table(spark):
    assert K.pack(frame(spark, []), PATH).count() == 0
