"""Base58 (Bitcoin alphabet) as Arrow-batched pandas UDFs.

Spark has no base58 built-in, so this is the one Python path of the decode
job.  Each call converts a whole Arrow batch: values of one length form a
matrix of digits, and one multi-word multiplication per digit group converts
all of them together.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the Bitcoin base58 alphabet.
ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_INDEX = {c: i for i, c in enumerate(ALPHABET)}


def b58decode(text: str | None) -> bytes | None:
    if text is None:
        return None
    n = 0
    for ch in text:
        d = _INDEX.get(ch)
        if d is None:
            return None
        n = n * 58 + d
    body = n.to_bytes((n.bit_length() + 7) // 8, "big") if n else b""
    pad = len(text) - len(text.lstrip("1"))
    return b"\x00" * pad + body


def b58encode(data: bytes | None) -> str | None:
    if data is None:
        return None
    data = bytes(data)
    n = int.from_bytes(data, "big")
    out = []
    while n:
        n, r = divmod(n, 58)
        out.append(ALPHABET[r])
    pad = len(data) - len(data.lstrip(b"\x00"))
    return "1" * pad + "".join(reversed(out))


def convert(digits: np.ndarray, base: int, group: int, out_base: int, out_len: int) -> np.ndarray:
    """Rows of big-endian ``base`` digits -> rows of ``out_len`` big-endian ``out_base`` digits.

    ``group`` digits are taken at a time; base**group * out word stays below 2**63.
    """
    n, length = digits.shape
    words = np.zeros((out_len, n), np.int64)                    # little-endian
    bits = out_base.bit_length() - 1 if out_base & (out_base - 1) == 0 else 0
    for s in range(0, length, group):
        part = digits[:, s:s + group]
        factor = base ** part.shape[1]
        carry = part @ np.array([base ** k for k in range(part.shape[1] - 1, -1, -1)], np.int64)
        for w in range(out_len):
            carry += words[w] * factor
            if bits:
                words[w] = carry & (out_base - 1)
                carry >>= bits
            else:
                carry, words[w] = np.divmod(carry, out_base)
    return words[::-1].T


_CODE = np.full(256, -1, np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(58)
_TEXT = np.frombuffer(ALPHABET.encode(), np.uint8)
LONGEST = 4096      # longer values go one by one: their cost is in the value, not in the batch


def by_length(values: list, one: Callable, many: Callable) -> list:
    """Apply ``many`` to the values of each length together (``one`` to long and rare ones)."""
    out: list = [None] * len(values)
    lengths: dict[int, list[int]] = {}
    for i, v in enumerate(values):
        if v is not None:
            lengths.setdefault(len(v), []).append(i)
    for length, at in lengths.items():
        group = [values[i] for i in at]
        done = many(group, length) if 0 < length <= LONGEST and len(at) > 3 else [one(v) for v in group]
        for i, v in zip(at, done):
            out[i] = v
    return out


def _decode_many(texts: list[str], length: int) -> list[bytes | None]:
    if not all(map(str.isascii, texts)):
        return [b58decode(t) for t in texts]
    digits = _CODE[np.frombuffer("".join(texts).encode(), np.uint8).reshape(len(texts), length)]
    good = (digits >= 0).all(axis=1)
    digits[~good] = 0
    size = length * 733 // 1000 + 1                              # log(58) / log(256)
    rows = convert(digits, 58, 6, 1 << 24, -(-size // 3))
    raw = np.stack([rows >> 16, rows >> 8 & 255, rows & 255], axis=2).astype(np.uint8).reshape(len(texts), -1)
    zeros = np.where((digits != 0).any(axis=1), (digits != 0).argmax(axis=1), length).tolist()
    first = np.where((raw != 0).any(axis=1), (raw != 0).argmax(axis=1), raw.shape[1]).tolist()
    data, width = raw.tobytes(), raw.shape[1]
    return [b"\x00" * z + data[i * width + f:(i + 1) * width] if ok else None
            for i, (z, f, ok) in enumerate(zip(zeros, first, good.tolist()))]


def _encode_many(values: list[bytes], length: int) -> list[str]:
    digits = np.frombuffer(b"".join(map(bytes, values)), np.uint8).reshape(len(values), length).astype(np.int64)
    size = length * 138 // 100 + 1                               # log(256) / log(58)
    rows = convert(digits, 256, 4, 58 ** 5, -(-size // 5))
    raw = np.stack([rows // 58 ** k % 58 for k in (4, 3, 2, 1, 0)], axis=2).reshape(len(values), -1)
    zeros = np.where((digits != 0).any(axis=1), (digits != 0).argmax(axis=1), length).tolist()
    first = np.where((raw != 0).any(axis=1), (raw != 0).argmax(axis=1), raw.shape[1]).tolist()
    text, width = _TEXT[raw].tobytes().decode(), raw.shape[1]
    return ["1" * z + text[i * width + f:(i + 1) * width] for i, (z, f) in enumerate(zip(zeros, first))]


def _values(s: pd.Series) -> list:
    return [None if v is None or v is pd.NA else v for v in s.tolist()]


@F.pandas_udf(T.BinaryType())
def base58_decode(s: pd.Series) -> pd.Series:
    """BINARY from base58 text; NULL for NULL or invalid text."""
    return pd.Series(by_length(_values(s), b58decode, _decode_many), index=s.index, dtype=object)


@F.pandas_udf(T.StringType())
def base58_encode(b: pd.Series) -> pd.Series:
    """Base58 text from BINARY (used to land fixtures in the wire encoding)."""
    return pd.Series(by_length(_values(b), b58encode, _encode_many), index=b.index, dtype=object)


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def base58_decode_all(s: pd.Series) -> pd.Series:
    """``base58_decode`` of every text of an array; the texts of all rows are decoded together."""
    lists = [[] if v is None else list(v) for v in s.tolist()]
    flat = by_length([t for texts in lists for t in texts], b58decode, _decode_many)
    out, at = [], 0
    for v, texts in zip(s.tolist(), lists):
        out.append(None if v is None else flat[at:at + len(texts)])
        at += len(texts)
    return pd.Series(out, index=s.index, dtype=object)
