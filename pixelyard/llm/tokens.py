"""Whole-text encoding with a public tokenizer, a cached piece at a time.

A text is cut where its white space makes the rest independent of what came before; every distinct
piece is encoded once per worker by the tokenizers library, a plain word by its model alone, and the
pieces' ids are joined. The ids equal those of the whole text: that holds for texts of the characters
up to U+024F, but for one that becomes two in lower case and for the mark that special tokens begin
with. Any other text is given to the library whole.
"""

from __future__ import annotations

import gc
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: The code points of Unicode's White_Space, which the tokenizers' patterns call \s.
WHITE_POINTS = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
WHITE = "".join(map(chr, WHITE_POINTS))
#: Pieces that keep the white space before them: in byte-level BPE it belongs to the next token.
LEADING = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Texts that a split at single blanks and line ends would not cut like LEADING.
UNEVEN = f"[{WHITE}][{WHITE}]|\\x00"
#: Texts that are encoded whole: normalising or composing may join what a cut would part.
UNPROVEN = "[^\\x00-\\x{24F}]|\\x{130}|<\\|"
#: Marks that end a run of letters in both tokenizers' patterns (an apostrophe may not).
MARKS = "!#$%&*+,-./:;=?@|~)"
#: Letters up to here have one form only, so that a word of them goes straight to the model.
PLAIN = chr(0x17F)
#: Known keys of a worker, an estimated 90 MB with their ids. When there are more, those looked up most often are kept.
CACHE_KEYS, KEPT_KEYS = 500_000, 250_000
#: Bytes of text that are encoded at once; what lies between text and ids is some thirty times as large.
PART_BYTES = 4 << 20


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level BPE: the byte's own if it's visible, else the next free one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()


class Encoder:
    """Encodes whole texts to little-endian unsigned 32-bit ids.

    Keys: a run of letters stands for itself after a blank (byte-level BPE) or alone (tokenizers that drop
    white space). In byte-level BPE any other key stands for itself after a blank too, but for one that
    starts with a line end (itself) or a NUL (the rest of it). ``places`` has each known key's place in
    ``ids``, its ids, and in ``hits``, how many parts had it. Laying the ids of a part's words end to end
    is one Arrow call.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.drops_white = not self.tokenizer.encode(" \n ", add_special_tokens=False).ids
        self.line_end = b"" if self.drops_white else self._full("\n")
        self.places = {"": 0}
        self.ids = pa.array([b"" if self.drops_white else self._full(" ")], pa.binary())
        self.hits = np.zeros(1, dtype=np.int32)

    def _full(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str, blank: bool) -> bytes:
        ascii_ = word.isascii()
        if not ascii_ and (max(word) > PLAIN or "\u0130" in word):
            return self._full(" " + word if blank else word)
        if self.drops_white:
            word, blank = word.lower(), False
        letters = word if ascii_ else word.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [x.id for x in self.tokenize(BYTE_LETTERS[32] + letters if blank else letters)]).tobytes()

    def _key(self, key: str) -> bytes:
        if key.isalpha():
            return self._letters(key, not self.drops_white)
        if self.drops_white:
            return self._full(key)
        head = b""
        if key[0] == "\n":  # a line end before a word is a token of its own
            head, key = self.line_end, "\0" + key[1:]
        if key[0] != "\0":
            return self._full(" " + key)
        word = key[1:].rstrip(MARKS)
        tail = key[1 + len(word) :]
        if not word.isalpha():
            return head + self._full(key[1:])
        return head + self._letters(word, False) + (self._full(tail) if tail else b"")

    def _find(self, keys: pa.Array) -> np.ndarray:
        """The places of ``keys``, which are all different, among the known ones; new ones are encoded."""
        names, known = keys.to_numpy(zero_copy_only=False).tolist(), self.places
        at = np.array([known.get(x, -1) for x in names], dtype=np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            missing = [names[i] for i in new.tolist()]
            at[new] = len(known) + np.arange(len(new))
            self.ids = pa.concat_arrays([self.ids, pa.array([self._key(x) for x in missing], pa.binary())])
            self.hits = np.append(self.hits, np.zeros(len(new), dtype=np.int32))
            known.update(zip(missing, at[new].tolist(), strict=True))
        self.hits[at] += 1
        return at

    def _forget(self) -> None:
        """Keep the first key, which stands for a blank alone, and those that most parts had."""
        kept = np.append(0, 1 + np.sort(np.argpartition(-self.hits[1:], KEPT_KEYS)[:KEPT_KEYS]))
        names = list(self.places)  # in the order of their places
        self.places = {names[i]: place for place, i in enumerate(kept.tolist())}
        self.ids, self.hits = self.ids.take(pa.array(kept)), self.hits[kept] >> 1

    def _cut(self, column: pa.Array) -> pa.ListArray:
        """The keys of texts that have no run of white space but single blanks and line ends."""
        if self.drops_white:
            return pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        return pc.split_pattern(pc.binary_join_element_wise("\0", pc.replace_substring(column, "\n", " \n"), ""), " ")

    def _encode(self, cut: pa.ListArray) -> list[bytes]:
        """Each row's ids. A key is looked up once, however often it stands in the batch."""
        encoded = cut.flatten().dictionary_encode()
        keys = encoded.dictionary
        stems = pc.utf8_rtrim(keys, characters=MARKS)
        alpha = pc.utf8_is_alpha(stems)
        # a word and the marks after it are two keys: the patterns part them
        marked = pc.and_(alpha, pc.not_equal(pc.binary_length(stems), pc.binary_length(keys)))
        tails = pc.replace_substring_regex(keys.filter(marked), "^\\p{L}+", "")
        if self.drops_white:
            stems = pc.if_else(alpha, pc.ascii_lower(stems), stems)
        else:
            tails = pc.binary_join_element_wise("\0", tails, "")
        both = pa.concat_arrays([pc.if_else(alpha, stems, keys), tails]).dictionary_encode()
        places = self._find(both.dictionary)
        found = self.ids.take(pa.array(places)).take(both.indices)
        heads, tails = found.slice(0, len(keys)), found.slice(len(keys))
        after = np.cumsum(marked.to_numpy(zero_copy_only=False)) - 1
        tails = tails.take(pc.if_else(marked, pa.array(after), None))
        of_key = pc.binary_join_element_wise(heads, tails, b"", null_handling="replace", null_replacement=b"")
        ids = of_key.cast(pa.large_binary()).take(encoded.indices)
        _, offsets, values = ids.buffers()
        at = np.frombuffer(offsets, dtype=np.int64, count=len(ids) + 1)
        ends = at[cut.offsets.to_numpy() - cut.offsets[0].as_py()].tolist()
        values = memoryview(values or b"")
        return [values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        out: list[bytes] = []
        while len(out) < len(texts):
            first = len(out)
            before = upto[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(upto, before + PART_BYTES, side="right")))
            out += self._encode_part(texts.slice(first, last - first))
        pa.default_memory_pool().release_unused()
        return out

    def _encode_part(self, texts: pa.Array) -> list[bytes]:
        if len(self.places) > CACHE_KEYS:
            self._forget()
        collects = gc.isenabled()
        gc.disable()  # lists of strings hold no cycles, and there are very many of them
        try:
            column = pc.fill_null(texts, "")
            whole = pc.match_substring_regex(column, UNPROVEN).to_numpy(zero_copy_only=False)
            odd = ~whole & (pc.match_substring_regex(column, UNEVEN).to_numpy(zero_copy_only=False) if not self.drops_white else False)
            empty = pc.equal(column, "").to_numpy(zero_copy_only=False)
            out = np.full(len(column), b"", dtype=object)
            for i in np.flatnonzero(whole).tolist():
                out[i] = self._full(column[i].as_py())
            for rows, cut in ((~odd & ~empty & ~whole, self._cut), (odd, _leading)):
                if rows.any():
                    part = column.filter(pa.array(rows))
                    for i, ids in zip(np.flatnonzero(rows).tolist(), self._encode(cut(part)), strict=True):
                        out[i] = ids
            return out.tolist()
        finally:
            if collects:
                gc.enable()


def _leading(column: pa.Array) -> pa.ListArray:
    return pa.array([["\0" + x for x in LEADING.findall(text)] for text in column.to_pylist()], pa.list_(pa.string()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, kept with its cache between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
