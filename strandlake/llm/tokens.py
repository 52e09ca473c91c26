"""Whole texts to token ids with the tokenizers library, remembering what words encode to.

Both tokenizers part a text where white space follows something else before they look for merges, so a
text's ids are its pieces' ids in a row, and a piece met before need not be encoded again. Pieces of
plain letters, digits and marks are parted further, as the tokenizers would: for many texts at once, as
classes of their bytes. The runs are numbered by Arrow, each different run is looked up once, and the
library's BPE model is asked for those not met before; any other piece goes through the whole tokenizer.

What a Python worker has met is kept for its next tasks, in two generations of a bounded size; that changes
speed only. Tasks of other steps let go of it (`_common.let_go`), as Spark hands them the same workers.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa

#: White space as the tokenizers see it: Python's, but for the four separators that Python adds.
_SPACE, _OTHER = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"

#: Letters whose class, case and normal form are the same to Python and the tokenizers; marks that start no contraction.
_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"

#: White space other than the space and the line feed, and runs of three of these.
_RARE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_WIDE = "\x85\xa0                　"
_RUNS = tuple(a + b + c for a in " \n" for b in " \n" for c in " \n")


#: Classes of bytes. BREAK is dropped; pieces with an ODD byte stay whole.
_BREAK, _BLANK, _LINE, _ALPHA, _DIGIT, _SIGN, _ODD = range(7)


def _kinds(drops_space: bool) -> np.ndarray:
    """Class of each byte of UTF-8; 0xFF stands between texts. 0xC3 leads the letters from U+00C0 on, and two marks."""
    out = np.full(256, _ODD, np.uint8)
    for kind, those in ((_ALPHA, f"[{_LETTER}]"), (_DIGIT, "[0-9]"), (_SIGN, f"[{_MARK}]")):
        out[[b for b in range(128) if re.match(those, chr(b))]] = kind
    out[0x80:0xC0] = out[0xC3] = _ALPHA
    out[[0x20, 0x0A, 0xFF]] = _BREAK if drops_space else (_BLANK, _LINE, _BREAK)
    return out


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class _Table(dict):
    """Key -> ids as bytes, in two generations; a key that neither has is made when it is looked up."""

    def __init__(self, limit: int, make) -> None:
        self.limit, self.make, self.older = limit, make, {}

    def turn(self) -> None:
        """A new generation, if this one is full."""
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found


class Encoder:
    """ids(texts): token ids of each text as little-endian unsigned 16-bit bytes.

    drops_space says that the tokenizer ignores white space and case (and ends words with a mark of their
    own); otherwise a piece keeps the space before it.
    """

    LIMIT = 400_000  # entries of a generation of a table; bounds memory, not results
    CHUNK = 2_000_000  # characters of the texts that are parted at once, but for the text that crosses it

    def __init__(self, path: str, drops_space: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit into 16 bits")
        self.model = self.tokenizer.model
        self.drops_space = drops_space
        self.pattern = re.compile(f"{_OTHER}+" if drops_space else f"{_SPACE}*{_OTHER}+|{_SPACE}+\\Z")
        self.parts = re.compile(f"[{_LETTER}]+|[0-9]|[{_MARK}]+" if drops_space else f" ?[{_LETTER}]+| ?[0-9]+| ?[{_MARK}]+").findall
        self.letters = _byte_letters()
        self.kinds, self.small = _kinds(drops_space), np.arange(256, dtype=np.uint8)
        self.small[0x41:0x5B] += 0x20
        self.pieces_known, self.parts_known = _Table(self.LIMIT, self._piece), _Table(self.LIMIT, self._part)

    @classmethod
    def kept(cls, path: str, drops_space: bool) -> Encoder:
        """This worker's encoder for the file: tasks that follow each other in one worker share it."""
        import tokenizers

        found = tokenizers.__dict__.setdefault("_kept_encoders", {})
        if (path, drops_space) not in found:
            found[path, drops_space] = cls(path, drops_space)
        return found[path, drops_space]

    def forget(self) -> None:
        """Empties the tables."""
        for table in (self.pieces_known, self.parts_known):
            table.clear()
            table.older = {}

    def _plain(self, text: str) -> bool:
        """Whether only spaces and line feeds part the text and, where they count, each stands alone or joins what follows."""
        if any(c in text for c in _RARE) or not text.isascii() and any(c in text for c in _WIDE):
            return False
        return self.drops_space or not (text[-2:].isspace() or any(r in text for r in _RUNS))

    def _runs(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(different runs and odd pieces of plain texts, the number among them of each that occurs, how many occur up to each text's end)."""
        data = np.frombuffer(b"\xff".join([*(t.encode() for t in texts), b""]), np.uint8)
        kind, small = self.kinds[data], self.small[data] if self.drops_space else data
        if not all(map(str.isascii, texts)):
            after = np.flatnonzero(data == 0xC3) + 1
            second = data[after]
            signs = (second == 0x97) | (second == 0xB7)
            kind[after[signs]] = _ODD
            if self.drops_space:
                small[after[(second < 0x9F) & ~signs]] += 0x20
        kind[np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))] = _ODD  # "<|" may begin an added token
        odd = np.flatnonzero(kind == _ODD)
        if len(odd):
            edge = np.flatnonzero(np.diff(kind >= _ALPHA, prepend=False))
            which = np.unique(np.searchsorted(edge[0::2], odd, "right") - 1)
            for a, b in zip(edge[0::2][which].tolist(), edge[1::2][which].tolist(), strict=True):
                kind[a:b] = _ODD
                if self.drops_space:
                    small[a:b] = data[a:b]
        first = np.ones(len(data), bool)
        np.not_equal(kind[1:], kind[:-1], out=first[1:])
        if self.drops_space:
            first |= kind == _DIGIT
        else:
            first |= kind < _ALPHA
            first[1:] &= (kind[:-1] != _BLANK) | (kind[1:] < _ALPHA)  # a space joins what follows
        start = np.flatnonzero(first)
        kept = kind[start] != _BREAK
        size, start = np.diff(start, append=len(data))[kept], start[kept]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        runs = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(small[kind != _BREAK])]).dictionary_encode()
        return runs.dictionary.to_numpy(zero_copy_only=False).tolist(), runs.indices.to_numpy(), np.searchsorted(start, np.flatnonzero(data == 0xFF))

    def _piece(self, p: str) -> bytes:
        small = p.lower() if self.drops_space else p
        if p.isascii() and (p if self.drops_space or p[:1] != " " else p[1:]).isalpha():
            return self._part(small)
        if p not in ("\n", ""):
            parts = self.parts(small)
            if len("".join(parts)) == len(small) == len(p) and "<|" not in p:
                return self._part(small) if len(parts) == 1 else b"".join([self.parts_known[x] for x in parts])
        return array("H", self.tokenizer.encode(p, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        letters = self.letters
        if part.isascii():  # of these only the space has another letter
            word = part if part[0] != " " else letters[32] + part[1:]
        else:
            word = "".join([letters[b] for b in part.encode()])
        return array("H", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _many(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts."""
        runs, index, until = self._runs(texts)
        self.pieces_known.turn()
        found = list(map(self.pieces_known.__getitem__, runs))
        size = np.fromiter(map(len, found), np.int64, len(found)) >> 1
        many, at = size[index], (np.cumsum(size) - size)[index]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(many)])
        ids = np.frombuffer(b"".join(found), np.uint16)[np.repeat(at - ends[:-1], many) + np.arange(ends[-1])].tobytes()
        cuts = (2 * ends[until]).tolist()
        return [ids[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def ids(self, texts: list[str]) -> list[bytes]:
        out, held, size = [b""] * len(texts), [], 0
        for k, text in enumerate(texts):
            if self._plain(text):
                held.append(k)
                size += len(text)
            else:
                self.pieces_known.turn()
                self.parts_known.turn()
                out[k] = b"".join(map(self.pieces_known.__getitem__, self.pattern.findall(text)))
            if held and (size >= self.CHUNK or k == len(texts) - 1):
                for i, found in zip(held, self._many([texts[i] for i in held]), strict=True):
                    out[i] = found
                held, size = [], 0
        return out
