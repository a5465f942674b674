"""Sum-of-squares online packing of documents into sequences of ``CAPACITY`` tokens.

Documents come in the order in which a task reads them. Whole windows are cut off a long document as sequences of
their own. What remains goes to the fill level that makes the sum of the squared counts of partially filled windows
smallest: a level array N counts the open windows by fill, and moving a window from level h to h + size changes the sum
by 2 (N[h + size] - N[h]) + 2, filling it up by 1 - 2 N[h], and opening one by 2 N[size] + 1. Ties go to the fullest.

At the end of a task its open windows are cut anew: their pieces, in order, fill whole windows, and the last rest
is split into powers of two, which need no padding. So a sequence is always full or a power of two.

Each task packs what it reads, with a level array of its own: nothing is shuffled, and memory holds the open windows
only. Sequence ids carry the task's number above 40 bits; a repeated task yields the same rows.

Null texts are empty: their one token is the end mark. Repeated rows are packed once each. doc_id may be null.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

CAPACITY = 2_048
END_ID = 1
#: Words, and pre-tokens, a worker remembers the ids of; it starts anew beyond that.
REMEMBERED = 200_000
#: Texts encoded together.
BATCH = 512


#: Text of ASCII and precomposed Latin letters, which normalising only puts into lower case ...
PLAIN = re.compile(r"[!-~À-ÖØ-öø-þ \t\n\r\x0b\x0c]*")
#: ... and the pre-tokens of such a text, as the tokenizer file's pattern has them.
PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^a-zß-öø-ÿ0-9 \t\n\r\x0b\x0c]+")


def byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes are themselves, the others follow from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


class WordEncoder:
    """Ids of texts for a tokenizer that lower-cases, drops white space and encodes each pre-token on its own.

    Pre-tokens of plain texts are encoded by the tokenizer's model, each different one once. Other texts go through
    the whole tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def forget(self) -> None:
        self.known.clear()
        self.words.clear()

    def piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else "".join(self.letters[b] for b in piece.encode())
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a plain word in lower case."""
        out = []
        for piece in PIECE.findall(word):
            ids = self.known.get(piece)
            if ids is None:
                if len(self.known) > REMEMBERED:
                    self.known.clear()
                ids = self.known[piece] = self.piece(piece)
            out.append(ids)
        return b"".join(out)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; nulls are empty. Each different word is looked up once."""
        plain = [t is not None and "<|" not in t and PLAIN.fullmatch(t) is not None for t in texts.to_pylist()]
        lower = pc.utf8_lower(pc.if_else(pa.array(plain), texts, ""))
        split = pc.ascii_split_whitespace(lower)
        words = split.flatten().dictionary_encode()
        different = words.dictionary.to_pylist()
        ids = list(map(self.words.get, different))
        if None in ids:
            if len(self.words) > REMEMBERED:
                self.words.clear()
            for k, found in enumerate(ids):
                if found is None:
                    ids[k] = self.words[different[k]] = self.word(different[k])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        of = words.indices.to_numpy()
        taken, starts = sizes[of], (np.cumsum(sizes) - sizes)[of]
        ends = np.cumsum(taken)
        data = flat[np.repeat(starts - ends + taken, taken) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        cuts = (4 * np.concatenate([[0], ends])[np.asarray(split.offsets) - split.offsets[0].as_py()]).tolist()
        out = [data[s:e] for s, e in zip(cuts, cuts[1:])]
        for k in [k for k, ok in enumerate(plain) if not ok]:
            text = texts[k].as_py()
            out[k] = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() if text else b""
        return out


class Packer:
    """Level array and open windows of one task. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, first_id: int, capacity: int = CAPACITY):
        self.capacity = capacity
        self.levels = np.zeros(capacity + 1, np.int64)           # N: open windows by fill
        self.open: dict[int, list[list]] = {}
        self.next_id = first_id
        self.done: list[tuple] = []

    def close(self, pieces: list) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            self.done.append((doc_id, start, len(ids) // 4, total, self.next_id, at, ids))
            at += len(ids) // 4
        self.next_id += 1

    def best_level(self, size: int) -> int:
        """Fill level to place ``size`` tokens at; 0 opens a window."""
        n, cap = self.levels, self.capacity
        delta = 2 * (n[size:cap + 1] - n[:cap + 1 - size]) + 2    # by level h: h + size <= capacity
        delta[0] = 2 * n[size] + 1 if size < cap else 0
        delta[-1] = 1 - 2 * n[cap - size] if size < cap else 0
        delta[1:][n[1:cap + 1 - size] == 0] = np.iinfo(np.int64).max
        return int(len(delta) - 1 - np.argmin(delta[::-1]))

    def add(self, doc_id, ids: bytes) -> None:
        total, width = len(ids) // 4, 4 * self.capacity
        for s in range(0, len(ids) - width + 1, width):
            self.close([(doc_id, s // 4, ids[s:s + width], total)])
        rest = ids[len(ids) - len(ids) % width:]
        if not rest:
            return
        size, start = len(rest) // 4, total - len(rest) // 4
        h = self.best_level(size)
        window = self.open[h].pop() if h else []
        if h:
            self.levels[h] -= 1
        window.append((doc_id, start, rest, total))
        if h + size == self.capacity:
            self.close(window)
        else:
            self.levels[h + size] += 1
            self.open.setdefault(h + size, []).append(window)

    def finish(self) -> None:
        """Cut what the open windows hold into full windows and a rest of powers of two."""
        pieces = [p for h in sorted(self.open, reverse=True) for w in self.open[h] for p in w]
        left = sum(len(p[2]) for p in pieces) // 4
        room, window = 0, []
        for doc_id, start, ids, total in pieces:
            while ids:
                if not room:
                    room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                part, ids = ids[:4 * room], ids[4 * room:]
                window.append((doc_id, start, part, total))
                n = len(part) // 4
                start, room, left = start + n, room - n, left - n
                if not room:
                    self.close(window)
                    window = []
        self.open.clear()
        self.levels[:] = 0


_encoders: dict[str, WordEncoder] = {}


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian 32-bit)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, WordEncoder(path))
        packer = Packer(TaskContext.get().partitionId() << 40, capacity)
        kind = None

        def flush() -> pa.RecordBatch:
            cols = list(zip(*packer.done)) or [()] * 7
            packer.done = []
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:6]), pa.array(cols[6], pa.binary())], names=names)

        for b in batches:
            kind = b.schema.field("doc_id").type
            for i in range(0, b.num_rows, BATCH):
                part = b.slice(i, BATCH)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text"))):
                    packer.add(doc_id, ids + end)
                if len(packer.done) >= 512:
                    yield flush()
        if kind is not None:
            packer.finish()
            yield flush()
        encoder.forget()         # workers live on; later stages need the memory

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
