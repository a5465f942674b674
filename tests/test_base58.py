"""The batch conversion against the plain big-integer one."""

import random

from fillwise.functions import base58 as B


def test_batches_equal_single_conversions():
    rnd = random.Random(1)
    for length in (1, 2, 7, 31, 32, 33, 40, 64, 88, 200):
        data = [bytes(rnd.choice([0, 0, rnd.randrange(256), 255]) for _ in range(length)) for _ in range(40)] + [b"\x00" * length, b"\xff" * length]
        assert B._encode_many(data, length) == [B.b58encode(d) for d in data]
        texts = ["".join(rnd.choice(B.ALPHABET + ("0" if rnd.random() < 0.02 else "")) for _ in range(length)) for _ in range(40)]
        texts += ["1" * length, "z" * length, "1" * (length - 1) + "2"]
        assert B._decode_many(texts, length) == [B.b58decode(t) for t in texts]
    mixed = [None, "", "é111", *(B.b58encode(bytes([i, 1, 2])) for i in range(9)), "0OIl"] * 3
    assert B.by_length(mixed, B.b58decode, B._decode_many) == [B.b58decode(t) for t in mixed]
