"""BPE by a streaming transducer with bounded lookahead, and decoding by a byte-to-text state machine.

**Lookahead.** A merge list decides left to right but for a bounded number of symbols: rule (x, y) can move the place up to
which two continuations of a text agree only by the length of x, and only if y stands at that place, which is then the
start of x. So from one moving rule to the next, the left part of the earlier is y itself or begins it. ``lookahead`` sums
the lengths along the worst such chain of rules of rising rank. Tokens that end so many symbols before the last known one
are the same whatever follows.

**Transducer.** Text comes in chunks of any size. Special tokens are taken out of the raw text; what lies between is cut
where no normalisation reaches across, normalised, and split into pre-tokens by the tokenizer file's own rules. A pre-token
of any length goes through the merges in windows: its stable tokens leave, the others stay with the next symbols. (The
library's model merges a window's symbols; that it takes its last one for the word's end is one of the possible
continuations, none of which changes a stable token.) What is held is a chunk and a window of twice the lookahead (and a run of combining marks, which cannot be normalised in parts).

**Decoder.** Ids come in chunks; their bytes run through a UTF-8 state machine that keeps at most three bytes of an unfinished
character and yields text.

White space leaves the transducer's state empty, so a task encodes each different white-space separated word once, short
ones together, and remembers a bounded number of them. Null texts are empty and have no ids. Repeated rows and null ids are kept.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from fillwise.llm.packing import byte_letters

#: Characters fed to the transducer at once.
CHUNK = 4_096
#: Characters of a word, or of a pre-token, up to which its ids are remembered, and how many are.
SHORT, REMEMBERED = 48, 150_000
#: Words that go through the file's rules together.
TOGETHER = 2_000
#: Bytes of text a task takes at once, and ids it decodes at once.
BLOCK, IDS = 2 << 20, 1 << 16


# --- the merge list -------------------------------------------------------------------------------------------------

def lookahead(merges: list[tuple[str, str]], size) -> int:
    """Symbols after a place that can change the tokens up to it, for a list of (left, right) in order of rank.

    ``size``: number of symbols of a token. Each token must be made by one rule, whose parts are made by earlier ones.
    """
    left_part: dict[str, str] = {}
    moved: dict[str, int] = {}            # by left part: the longest chain that ends with a rule of that left part
    longest = 0
    for x, y in merges:
        if x + y in left_part:
            raise ValueError(f"two rules make {x + y!r}: no bound is known")
        chain, t = 0, y
        while t is not None:
            chain, t = max(chain, moved.get(t, 0)), left_part.get(t)
        chain += size(x)
        moved[x] = max(moved.get(x, 0), chain)
        longest = max(longest, chain)
        left_part[x + y] = x
    made: set[str] = set()
    later = set(left_part)
    for x, y in merges:
        if any(t in later and t not in made for t in (x, y)):
            raise ValueError(f"{x!r} {y!r} comes before the rules of its parts: no bound is known")
        made.add(x + y)
    return longest


class Rules:
    """Vocabulary, merges and special tokens of a tokenizers file of BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = (spec := json.load(f))["model"]
        self.end: str = model["end_of_word_suffix"] or ""
        vocabulary: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.length = {v: len(t.removesuffix(self.end) or t) for t, v in vocabulary.items()}
        self.lookahead = lookahead(merges, lambda t: len(t.removesuffix(self.end) or t))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {v: t for t, v in {**vocabulary, **self.special}.items()}


# --- text to ids ----------------------------------------------------------------------------------------------------

def starts_afresh(c: str) -> bool:
    """Whether normalising the text from this character on never depends on what stands before it."""
    if c < "̀":
        return True
    first = unicodedata.normalize("NFD", c)[0]
    jamo = "ᄀ" <= first <= "ᇿ" or "ꥠ" <= first <= "꥿" or "ힰ" <= first <= "퟿"
    return unicodedata.category(c)[0] in "LNPSZ" and unicodedata.category(first)[0] != "M" and (not jamo or "가" <= c <= "힣")


class PreToken:
    """The tokens of one pre-token whose symbols come bit by bit; they leave once they are stable.

    ``merge``: the tokens of a whole window of symbols, by the library's merges.
    """

    def __init__(self, rules: Rules, merge: Callable[[str], list[int]]):
        self.rules, self.merge = rules, merge
        self.held = ""

    def feed(self, symbols: str) -> list[int]:
        """More symbols, which the pre-token need not end with."""
        self.held += symbols
        # The last symbol may turn out to end the word, so it is not known yet.
        known, at = len(self.held) - 1 - self.rules.lookahead, 0
        out: list[int] = []
        if known > self.rules.lookahead:
            for t in self.merge(self.held):
                if at + self.rules.length[t] > known:
                    break
                at += self.rules.length[t]
                out.append(t)
            self.held = self.held[at:]
        return out

    def finish(self) -> list[int]:
        held, self.held = self.held, ""
        return self.merge(held) if held else []


class Transducer:
    """Ids of a text that comes in chunks: ``feed`` what there is, then ``finish``."""

    def __init__(self, rules: Rules, path: str):
        self.rules = rules
        tokenizer = Tokenizer.from_file(path)
        self.normalise = tokenizer.normalizer.normalize_str
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        model = tokenizer.model
        self.merge = lambda symbols: [t.id for t in model.tokenize(symbols)]
        self.special = re.compile("|".join(map(re.escape, sorted(rules.special, key=len, reverse=True))) or r"(?!)")
        self.raw = ""                         # not normalised yet
        self.text = ""                        # normalised, not split yet
        self.run: PreToken | None = None      # a pre-token too long to wait for its end ...
        self.like = ""                        # ... and a character of its kind
        self.known: dict[str, list[int]] = {}

    def feed(self, chunk: str) -> list[int]:
        self.raw += chunk
        out: list[int] = []
        while True:
            found = self.special.search(self.raw)
            if not found:
                break
            out += self._segment(self.raw[:found.start()], True)
            out.append(self.rules.special[found[0]])
            self.raw = self.raw[found.end():]
        end = len(self.raw)
        for s in self.rules.special:          # a special token may have begun
            end = min([end, *(len(self.raw) - k for k in range(1, len(s)) if self.raw.endswith(s[:k]))])
        while end > 0 and not (end < len(self.raw) and starts_afresh(self.raw[end])):
            end -= 1
        if end:
            out += self._segment(self.raw[:end], False)
            self.raw = self.raw[end:]
        return out

    def finish(self) -> list[int]:
        raw, self.raw = self.raw, ""
        return self._segment(raw, True)

    def whole(self, text: str) -> list[int]:
        """Ids of a whole text."""
        if not self.special.search(text):
            return self._segment(text, True) if len(text) <= CHUNK else self._chunks(text)
        return self._chunks(text)

    def many(self, words: list[str]) -> list[list[int]]:
        """Ids of different short words, each a text of its own, with one call of the file's rules for all.

        Words without inner white space come back from one text as they are, as no rule reaches across a space.
        """
        joined = " ".join(words)
        text = self.normalise(joined)
        if joined.split() != words or text.count(" ") != len(words) - 1 or self.special.search(joined):
            return [self.whole(w) for w in words]
        pieces = self.split(text)
        spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
        of = np.searchsorted(spaces, np.fromiter((span[0] for _, span in pieces), np.int64, len(pieces))).tolist()
        out: list[list[int]] = [[] for _ in words]
        for (symbols, _), k in zip(pieces, of):
            out[k] += self._piece(symbols)
        return out

    def _chunks(self, text: str) -> list[int]:
        out = []
        for i in range(0, len(text), CHUNK):
            out += self.feed(text[i:i + CHUNK])
        return out + self.finish()

    def _segment(self, raw: str, last: bool) -> list[int]:
        """Raw text between special tokens, cut where normalisation allows; ``last``: its segment ends."""
        text = self.normalise(raw) if raw else ""
        out: list[int] = []
        if self.run is not None:
            # How far the pre-token goes on: a character of its kind in front makes the rules treat the text as its rest.
            more = self.split(self.like + text)[0][1][1] - 1 if text else 0
            out += self.run.feed(self._symbols(text[:more]))
            if more == len(text) and not last:
                return out
            out += self.run.finish()
            self.run, text = None, text[more:]
        self.text += text
        pieces = self.split(self.text)
        if last:
            self.text = ""
        elif pieces:
            text = self.text
            if pieces[-1][1][1] < len(text):       # white space ended the last one
                self.text = ""
            else:
                keep = 1
                if len(pieces) > 1 and text[slice(*pieces[-2][1])] == "'":      # 'r may become 're
                    keep = 2
                kept, pieces = pieces[-keep:], pieces[:-keep]
                self.text = text[kept[0][1][0]:]
                if len(self.text) > CHUNK:
                    for symbols, _ in kept[:-1]:
                        pieces.append((symbols, None))
                    symbols, (a, b) = kept[-1]
                    self.like = "a" if len(self.split("a" + text[b - 1])) == 1 else "!"
                    for p, _ in pieces:
                        out += self._piece(p)
                    self.run, self.text = PreToken(self.rules, self.merge), ""
                    return out + self.run.feed(symbols)
        else:
            self.text = ""
        for symbols, _ in pieces:
            out += self._piece(symbols)
        return out

    def _symbols(self, text: str) -> str:
        letters = byte_letters_cached()
        return "".join([letters[b] for b in text.encode("utf-8")])

    def _piece(self, symbols: str) -> list[int]:
        """Ids of a whole pre-token."""
        ids = self.known.get(symbols)
        if ids is None:
            if len(symbols) <= SHORT:
                ids = self.merge(symbols)
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[symbols] = ids
            else:
                token = PreToken(self.rules, self.merge)
                ids = []
                for i in range(0, len(symbols), CHUNK):
                    ids += token.feed(symbols[i:i + CHUNK])
                ids += token.finish()
        return ids


_letters: list[str] = []


def byte_letters_cached() -> list[str]:
    if not _letters:
        _letters.extend(byte_letters())
    return _letters


# --- ids to text ----------------------------------------------------------------------------------------------------

class Decoder:
    """Text of ids that come in chunks.

    As the library decodes a file that names no decoder, tokens are joined by spaces, with their word ends and byte letters
    as they stand in the vocabulary. With ``surface``, byte letters are bytes again and word ends are spaces.
    """

    def __init__(self, rules: Rules, surface: bool = False):
        self.surface = surface
        if surface:
            byte = {c: bytes([b]) for b, c in enumerate(byte_letters())}
            special = set(rules.special.values())
            self.table = {v: t.encode() if v in special else b"".join(byte[c] for c in t.removesuffix(rules.end)) + (b" " if t.endswith(rules.end) else b"")
                          for v, t in rules.strings.items()}
        else:
            self.table = {v: t.encode() for v, t in rules.strings.items()}
        self.reset()

    def reset(self) -> None:
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids: Iterable[int]) -> str:
        pieces = [self.table[i] for i in ids]
        if not pieces:
            return ""
        data = (b"" if self.surface else b" ").join(pieces)
        if self.begun and not self.surface:
            data = b" " + data
        self.begun = True
        return self.machine.decode(data)

    def finish(self) -> str:
        text = self.machine.decode(b"", final=True)
        self.reset()
        return text


# --- the Spark job --------------------------------------------------------------------------------------------------

_workers: dict[str, tuple[Rules, Transducer]] = {}


def worker(path: str) -> tuple[Rules, Transducer]:
    if path not in _workers:
        rules = Rules(path)
        _workers[path] = rules, Transducer(rules, path)
    return _workers[path]


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK, side="right")))
        yield batch.slice(at, to - at)
        at = to


class WordIds:
    """Little-endian 32-bit ids of white-space separated words; remembers a bounded number of short ones."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}          # what was known before the last start anew

    def of(self, words: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        known, out = self.known, list(map(self.known.get, words))
        new = []
        for k, ids in enumerate(out):
            if ids is None:
                word = words[k]
                ids = self.before.get(word)
                if ids is not None:
                    out[k] = known[word] = ids
                elif 0 < len(word) <= SHORT:
                    new.append(k)
                else:
                    out[k] = array("I", self.transducer.whole(word)).tobytes()
        for i in range(0, len(new), TOGETHER):
            some = new[i:i + TOGETHER]
            for k, ids in zip(some, self.transducer.many([words[k] for k in some])):
                out[k] = known[words[k]] = array("I", ids).tobytes()
        return out


def encode_texts(texts: pa.Array, words: WordIds) -> list[bytes]:
    """Ids of each text; nulls are empty."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = split.flatten().dictionary_encode()
    table = words.of(coded.dictionary.to_pylist())
    flat, size = np.frombuffer(b"".join(table), "<u4"), np.fromiter(map(len, table), np.int64, len(table)) // 4
    word = coded.indices.to_numpy()
    taken, begin = size[word], (np.cumsum(size) - size)[word]
    ends = np.concatenate([[0], np.cumsum(taken)])
    data = flat[np.repeat(begin - ends[:-1], taken) + np.arange(ends[-1])].tobytes()
    cuts = (4 * ends[split.offsets.to_numpy() - split.offsets[0].as_py()]).tolist()
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (little-endian unsigned 32-bit)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = worker(path)[1]
        words = WordIds(transducer)
        for b in batches:
            for part in _blocks(b):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(encode_texts(part.column("text"), words), pa.binary())], names=["doc_id", "ids"])
        transducer.known.clear()               # workers live on; later stages need the memory

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, ids binary")


def decode(encoded: DataFrame, path: str, surface: bool = False) -> DataFrame:
    """``encoded`` with the text of its ids in ``decoded``."""
    id_type = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(worker(path)[0], surface)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = []
                for ids in part.column("ids").to_pylist():
                    numbers = np.frombuffer(ids, "<u4")
                    pieces = [decoder.feed(numbers[k:k + IDS].tolist()) for k in range(0, len(numbers), IDS)]
                    texts.append("".join([*pieces, decoder.finish()]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, ids binary, decoded string")
