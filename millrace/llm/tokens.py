"""Token ids of whole texts, by the tokenizers library, with a bounded store of words already encoded."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np

WORDS_KEPT, CHUNK, KEY = 1_000_000, 1 << 19, 16
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], "u8")
#: What the tokenizer's file must say for words to be encoded one by one.
WORD_WISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
LATIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")  # letters of ASCII and of U+00C0 to U+00FF, in UTF-8
LATIN_LOWER = bytes(c + 32 if 0x80 <= c <= 0x9E else c for c in range(256))
BYTE_LEVEL = dict(zip((c for c in range(256) if not (33 <= c <= 126 or 161 <= c <= 172 or 174 <= c)), range(256, 512)))  # bytes that aren't their own character
MARK, ENDS = np.zeros(256, bool), np.zeros(256, bool)
MARK[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True
ENDS[[c for c in range(128) if chr(c).isalnum()]] = True
_open: dict[str, "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Store:
    """Words of up to KEY bytes, none of them zero, in open addressing: their bytes as two integers, so nothing is taken
    for another word, and the place and number of their ids. Longer words are in a dict."""

    def __init__(self) -> None:
        self.slots = np.zeros((1 << 14, 3), "u8")
        self.long: dict[bytes, int] = {}
        self.ids, self.used, self.words = np.zeros(1 << 16, "<u4"), 0, 0

    def append(self, ids: list[list[int]]) -> np.ndarray:
        """Take in the ids of some words; place << 32 | number of each."""
        n = np.array([len(x) for x in ids], "u8")
        flat = np.array([i for x in ids for i in x], "<u4")
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        place = (np.cumsum(n) - n + np.uint64(self.used)) << np.uint64(32) | n
        self.used += len(flat)
        return place

    def probe(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each word, or the empty one where it would go."""
        with np.errstate(over="ignore"):
            h = (a ^ b * B) * A
            h = (h ^ h >> np.uint64(29)) * B
        mask = len(self.slots) - 1
        at = (h >> np.uint64(32)).astype("i8") & mask
        found = self.slots[at]
        todo = np.nonzero((found[:, 0] != a) | (found[:, 1] != b))[0]
        todo = todo[found[todo, 0] != 0]
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            found = self.slots[at[todo]]
            todo = todo[(found[:, 0] != 0) & ((found[:, 0] != a[todo]) | (found[:, 1] != b[todo]))]
        return at

    def insert(self, rows: np.ndarray) -> None:
        """Different words that aren't here yet, as rows like those of slots."""
        while 2 * (self.words + len(rows)) > len(self.slots):
            old = self.slots[self.slots[:, 0] != 0]
            self.slots = np.zeros((2 * len(self.slots), 3), "u8")
            self._place(old)
        self._place(rows)
        self.words += len(rows)

    def _place(self, rows: np.ndarray) -> None:
        while len(rows):
            at, first = np.unique(self.probe(rows[:, 0], rows[:, 1]), return_index=True)
            self.slots[at] = rows[first]
            rows = np.delete(rows, first, 0)


class Words:
    """Ids of words in two generations: at `kept` words the older one goes, so memory is bounded and what recurs stays."""

    def __init__(self, encode: Callable[[bytes], list[int]], kept: int) -> None:
        self.encode, self.kept, self.now, self.older = encode, kept, Store(), Store()

    def trim(self) -> None:
        if self.now.words > self.kept:
            self.now, self.older = Store(), self.now

    def short(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """place << 32 | number, in now.ids, of words given as two integers."""
        found = self.now.slots[self.now.probe(a, b), 2]
        new = np.nonzero(found == 0)[0]
        if len(new):
            order = new[np.lexsort((b[new], a[new]))]
            x, y = a[order], b[order]
            first = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            x, y = x[first], y[first]
            known = self.older.slots[self.older.probe(x, y), 2]
            raw = np.stack([x, y], 1).astype("<u8").tobytes()
            ids = [self.recall(k) if k else self.encode(raw[i : i + KEY].rstrip(b"\0")) for i, k in zip(range(0, len(raw), KEY), known.tolist())]
            place = self.now.append(ids)
            self.now.insert(np.stack([x, y, place], 1))
            found[order] = place[np.cumsum(first) - 1]
        return found

    def recall(self, place: int) -> list[int]:
        return self.older.ids[place >> 32 : (place >> 32) + (place & 0xFFFFFFFF)].tolist()

    def other(self, word: bytes) -> int:
        """As short(), of a word of any bytes."""
        place = self.now.long.get(word)
        if place is None:
            known = self.older.long.get(word)
            place = self.now.long[word] = int(self.now.append([self.encode(word) if known is None else self.recall(known)])[0])
            self.now.words += 1
        return place


def _pieces(texts: list[bytes], most: int) -> Iterator[tuple[int, bytes]]:
    """Index and bytes of the texts, long ones cut at white space."""
    for i, t in enumerate(texts):
        lo = 0
        while len(t) - lo > most:
            at = max(t.rfind(b" ", lo, lo + most), t.rfind(b"\n", lo, lo + most))
            if at <= lo:
                at = min((x for x in (t.find(b" ", lo + most), t.find(b"\n", lo + most)) if x >= 0), default=len(t))
            yield i, t[lo:at]
            lo = at
        yield i, t[lo:]


def _marks_apart(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words from lo to hi, marks at their ends cut off (see Encoder)."""
    cut = hi.copy()
    todo = np.nonzero(MARK[data[hi - 1]])[0]
    while len(todo):
        cut[todo] -= 1
        todo = todo[cut[todo] > lo[todo]]
        todo = todo[MARK[data[cut[todo] - 1]]]
    last = data[cut - 1]
    latin = (data[cut - 2] == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
    apart = (cut < hi) & (cut > lo) & (ENDS[last] | latin)
    at = np.arange(len(lo)) + np.cumsum(apart) - apart
    starts, ends = (np.empty(len(lo) + int(apart.sum()), "i8") for _ in range(2))
    starts[at], ends[at] = lo, np.where(apart, cut, hi)
    starts[at[apart] + 1], ends[at[apart] + 1] = cut[apart], hi[apart]
    return starts, ends


class Encoder:
    """Encodes as Tokenizer.encode(text, add_special_tokens=False) does.

    With a normalizer and pre-tokenizer as in WORD_WISE, white space is dropped and nothing joins across it, and ASCII case
    does not matter, so a text's ids are the ids of its words in turn, marks at a word's end taken for a word of their own
    where a letter or digit of ASCII, or a letter of U+00C0 to U+00FF, precedes them. A word of such letters alone is one
    piece for the model. Texts with "<|" may hold an added token's string and are encoded whole, as all texts are with any
    other tokenizer.
    """

    def __init__(self, path: str, words_kept: int = WORDS_KEPT) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.word_wise = all(said.get(k) == v for k, v in WORD_WISE.items()) and all("<|" in t["content"] for t in said["added_tokens"])
        self.model = self.tokenizer.model
        self.words = Words(self.word, words_kept)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def word(self, word: bytes) -> list[int]:
        """word: its ASCII letters in lower case."""
        if word.isalpha():
            return [t.id for t in self.model.tokenize(word.decode())]
        if LATIN.fullmatch(word):
            return [t.id for t in self.model.tokenize(word.translate(LATIN_LOWER).decode("latin-1").translate(BYTE_LEVEL))]
        return self.whole(word.decode("utf-8", "surrogatepass"))

    def batch(self, texts: list[str], end_id: int | None = None) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, with end_id last if given."""
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        out: list[list[bytes]] = [[] for _ in texts]
        plain = []
        for i, t in enumerate(texts):
            raw = t.encode("utf-8", "surrogatepass")
            if not self.word_wise or b"<|" in raw or b"\0" in raw:
                out[i].append(np.array(self.whole(t), "<u4").tobytes())
                raw = b""
            plain.append(raw)
        held: list[tuple[int, bytes]] = []
        size = 0
        for piece in _pieces(plain, CHUNK):
            if held and size + len(piece[1]) > CHUNK:
                self._encode(held, out)
                held, size = [], 0
            held.append(piece)
            size += len(piece[1])
        self._encode(held, out)
        return [b"".join(x) + end for x in out]

    def _encode(self, pieces: list[tuple[int, bytes]], out: list[list[bytes]]) -> None:
        """Add each piece's ids to those of its text."""
        self.words.trim()
        raw = b"\n" + b"\n".join(p for _, p in pieces).lower() + b"\n" + bytes(KEY)
        data = np.frombuffer(raw, "u1")
        gap = (data == 32) | (data == 10)
        gap[-KEY:] = True
        edge = np.nonzero(gap[1:] != gap[:-1])[0] + 1
        lo, hi = _marks_apart(data, edge[::2], edge[1::2])
        size = hi - lo
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
        a = eight[lo] & MASKS[np.minimum(size, 8)]
        b = np.zeros(len(a), "u8")
        more = np.nonzero(size > 8)[0]
        b[more] = eight[lo[more] + 8] & MASKS[np.minimum(size[more] - 8, 8)]
        long = np.nonzero(size > KEY)[0]
        a[long], b[long] = np.uint64(97), 0
        place = self.words.short(a, b)
        for i in long.tolist():
            place[i] = self.words.other(raw[lo[i] : hi[i]])
        n = (place & np.uint64(0xFFFFFFFF)).astype("i8")
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.words.now.ids[np.repeat((place >> np.uint64(32)).astype("i8") - ends[:-1], n) + np.arange(ends[-1])]
        sizes = np.array([len(p) + 1 for _, p in pieces])
        first = np.searchsorted(lo, np.cumsum(sizes) - sizes + 1)
        cuts = [*ends[first].tolist(), len(ids)]
        for (i, _), x, y in zip(pieces, cuts, cuts[1:]):
            out[i].append(ids[x:y].tobytes())


def encoder(path: str) -> Encoder:
    """One a worker process."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]
