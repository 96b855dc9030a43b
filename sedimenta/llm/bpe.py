"""Byte-level BPE ids of whole texts by the tokenizers library, without encoding the same stretch twice.

The borders of the byte-level pattern's pre-tokens follow from the classes of neighbouring characters, so they are
found for all texts of a batch at once by array operations over its bytes. Merges never cross pre-tokens, so the ids of
a text are the ids of its pre-tokens, one after another, and equal pre-tokens have equal ids. Stretches with special
strings or with characters whose class may depend on the version of Unicode are taken as one and left to the library;
they are cut at single spaces between two characters that are no white space, where a pre-token starts in any case.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex

# The characters that stand for bytes in the vocabulary of byte-level BPE, and the classes that the
# public pattern ('s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+) tells apart.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPACE, LETTER, DIGIT, SIGN, UNSETTLED, UNSETTLED_SPACE = range(6)
SHORT = b"stmd"
LONG = (b"re", b"ve", b"ll")

CUT = re.compile(r" (?=\S)")
FENCE = b"\xc0"
# characters whose classes are the same in every version of Unicode: the first ones, and letters of Greek, Cyrillic,
# Hebrew, Arabic, kana, Han and Hangul; behind the last there is no white space
SETTLED, LAST = 0x250, 0xD7A4
LETTERS = [
    (0x391, 0x3A1), (0x3A3, 0x3A9), (0x3B1, 0x3C9), (0x401, 0x40C), (0x40E, 0x44F), (0x451, 0x45C), (0x45E, 0x481), (0x5D0, 0x5EA),
    (0x621, 0x63A), (0x641, 0x64A), (0x3041, 0x3094), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
]


def _byte_names() -> dict[int, str]:
    rest = iter(range(256, 512))
    return {b: chr(b if b in PRINTABLE else next(rest)) for b in range(256)}


def _classes() -> np.ndarray:
    kind = np.full(LAST + 1, UNSETTLED, np.uint8)
    kind[[0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = UNSETTLED_SPACE
    for first, last in LETTERS:
        kind[first:last + 1] = LETTER
    patterns = {SPACE: r"\s", LETTER: r"\p{L}", DIGIT: r"\p{N}", SIGN: r"[^\s\p{L}\p{N}]"}
    for c in range(SETTLED):
        kind[c] = next(k for k, p in patterns.items() if regex.match(p, chr(c)))
    return kind


CLASSES = _classes()


def classes(data: np.ndarray) -> np.ndarray:
    """Class of the character that each byte of UTF-8 belongs to."""
    kind = CLASSES[:256][data]
    high = np.flatnonzero(data >= 0x80)
    lead = high[data[high] >= 0xC0]
    if len(lead):
        first, second = data[lead].astype(np.int32), data[lead + 1].astype(np.int32) & 0x3F
        point = (first & 0x1F) << 6 | second
        wide = first >= 0xE0
        point[wide] = (first[wide] & 0xF) << 12 | second[wide] << 6 | data[lead[wide] + 2] & 0x3F
        point[first >= 0xF0] = LAST
        found = CLASSES[np.minimum(point, LAST)]
        kind[lead] = kind[lead + 1] = found
        kind[lead[wide] + 2] = found[wide]
        kind[lead[first >= 0xF0] + 3] = UNSETTLED
    return kind


def pretokens(data: np.ndarray, begins: np.ndarray, special: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where the pre-tokens of texts begin, and which of them are stretches for the library.

    ``data``: the texts' UTF-8, one after another; ``begins``: where each text begins that is not empty.
    """
    kind = classes(data)
    opens = np.zeros(len(data) + 2, bool)
    opens[begins] = True
    starts = opens.copy()
    starts[1:len(data)] |= kind[1:] != kind[:-1]

    # of white space before something else the last character stands apart, and a space goes with what follows
    after = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE)) + 1
    after = after[~opens[after]]
    starts[after - 1 - (data[after - 1] >= 0x80)] = True
    starts[after[data[after - 1] == 0x20]] = False

    quote = np.flatnonzero(data == 0x27)
    quote = quote[starts[quote] & ~opens[quote + 1] & (quote + 1 < len(data))]
    if len(quote):
        one = data[quote + 1]
        two = np.where(opens[quote + 2] | (quote + 2 >= len(data)), 0, data[np.minimum(quote + 2, len(data) - 1)])
        short = np.isin(one, list(SHORT))
        long = np.logical_or.reduce([(one == a) & (two == b) for a, b in LONG])
        starts[quote[short | long] + 1] = False
        starts[quote[short] + 2] = starts[quote[long] + 3] = True

    odd = [np.flatnonzero(kind >= UNSETTLED)]
    text = data.tobytes() if special else b""
    for s in special:
        odd.append(np.array([m.start() for m in re.finditer(re.escape(s), text)], np.int64))
    odd = np.concatenate(odd)
    if len(odd):
        free = (kind != SPACE) & (kind != UNSETTLED_SPACE)
        cut = np.flatnonzero((data[1:-1] == 0x20) & free[:-2] & free[2:]) + 1
        cut = cut[~opens[cut] & ~opens[cut + 1]]
        borders = np.sort(np.r_[begins, cut, len(data)])
        stretch = np.unique(np.searchsorted(borders, odd, side="right"))
        inside = np.zeros(len(data) + 1, np.int8)
        inside[borders[stretch - 1]] += 1
        inside[borders[stretch]] -= 1
        starts[:len(data)] &= np.cumsum(inside[:-1], dtype=np.int8) == 0
        starts[borders[stretch - 1]] = True
    places = np.flatnonzero(starts[:len(data)])
    whole = np.zeros(len(places), bool)
    if len(odd):
        whole[np.searchsorted(places, borders[stretch - 1])] = True
    return places, whole


class Encoder:
    """``encode_all(texts)``: ids of whole texts.

    Special strings inside a text become their special ids, the default of the library. Of a batch of texts only the
    distinct pre-tokens are looked at. They are remembered between batches; with more than ``keep`` of them, or
    twenty times as many ids, the half not used for longest is forgotten. A tokenizer of another kind than plain byte-level BPE is given whole texts.
    """

    def __init__(self, path: str, keep: int = 400_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self._model = self.library.model
        about = json.loads(self.library.to_str())
        pre, added = about["pre_tokenizer"] or {}, about["added_tokens"]
        self.special = [t["content"].encode() for t in added]
        self.cuts = (
            about["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex")
            and not pre.get("add_prefix_space")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added)
        )
        self._names = _byte_names()
        # a byte that no merge takes keeps pre-tokens apart in one call of the model
        fence = self._names[FENCE[0]]
        self._fence = None if any(fence in t and t != fence for t in about["model"]["vocab"]) else about["model"]["vocab"].get(fence)
        # number of each remembered pre-token, and by number: its ids, how many, the batch it was last used in
        self._keep, self._batch, self._number = keep, 0, {}
        self._ids, self._sizes, self._used = np.zeros(0, "<u4"), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def whole(self, text: str) -> bytes:
        """By one call of the library, as bytes of little-endian 32-bit numbers."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _merged(self, tokens: list[bytes]) -> tuple[list[np.ndarray], list[int]]:
        """Ids of pre-tokens, many in one call of the library's model, and how many each has."""
        parts, sizes = [], []
        step = 2000 if self._fence is not None else 1
        for k in range(0, len(tokens), step):
            spelled = FENCE.join(tokens[k:k + step]).decode("latin-1").translate(self._names)
            ids = np.array([t.id for t in self._model.tokenize(spelled)], "<u4")
            fences = np.flatnonzero(ids == self._fence) if step > 1 else np.zeros(0, np.int64)
            parts.append(np.delete(ids, fences))
            sizes.extend((np.diff(np.r_[-1, fences, len(ids)]) - 1).tolist())
        return parts, sizes

    def _numbers(self, names: list[bytes], whole: np.ndarray) -> np.ndarray:
        """Numbers of distinct pre-tokens and stretches; those not remembered are encoded."""
        number = self._number
        if max(len(number), len(self._ids) // 20) > self._keep:
            last = np.sort(np.argsort(self._used, kind="stable")[len(number) // 2:])
            known, starts = list(number), np.cumsum(self._sizes) - self._sizes
            self._number = number = {known[k]: i for i, k in enumerate(last.tolist())}
            self._ids = self._ids[_ranges(starts[last], self._sizes[last])]
            self._sizes, self._used = self._sizes[last], self._used[last]
        found = np.array([number.get(n, -1) for n in names], np.int64)
        new = found < 0
        if new.any():
            plain = [names[k] for k in np.flatnonzero(new & ~whole).tolist()]
            odd = [names[k] for k in np.flatnonzero(new & whole).tolist()]
            parts, sizes = self._merged(plain)
            others = [np.frombuffer(self.whole(s.decode()), "<u4") for s in odd]
            first = len(number)
            number.update(zip(plain + odd, range(first, first + len(plain) + len(odd))))
            found[np.r_[np.flatnonzero(new & ~whole), np.flatnonzero(new & whole)]] = np.arange(first, len(number))
            self._ids = np.concatenate([self._ids, *parts, *others])
            self._sizes = np.r_[self._sizes, np.array(sizes + [len(p) for p in others], np.int32)]
            self._used = np.r_[self._used, np.zeros(len(number) - first, np.int32)]
        self._batch += 1
        self._used[found] = self._batch
        return found

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (non-null strings), one after another, and where each text's ids end."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        if not self.cuts:
            parts = [self.whole(t) for t in texts.to_pylist()]
            return np.frombuffer(b"".join(parts), "<u4"), np.cumsum([len(p) // 4 for p in parts])
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1]
        if offsets[0] == offsets[-1]:
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        data, offsets = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]
        places, whole = pretokens(data, offsets[:-1][np.diff(offsets) > 0], self.special)
        bounds = np.append(places, len(data)).astype(np.int32)
        tokens = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        index = tokens.indices.to_numpy()
        odd = np.zeros(len(tokens.dictionary), bool)
        odd[index[whole]] = True
        number = self._numbers(tokens.dictionary.to_pylist(), odd)[index]
        counts = self._sizes[number]
        flat = self._ids[_ranges((np.cumsum(self._sizes) - self._sizes)[number], counts)]
        return flat, np.r_[0, np.cumsum(counts)][np.searchsorted(places, offsets[1:])]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges (start, count), one range after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
