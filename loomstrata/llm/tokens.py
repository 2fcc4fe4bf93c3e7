"""Token ids of whole texts with a public tokenizer, many texts at a time.

A text is cut at single blanks and line ends, where both pre-tokenizers cut as well, and at a mark behind an ASCII letter.
The ids of each piece, which the library gave, are kept in a bounded table of arrays, so the library encodes a frequent
piece once. A text where such a cut could change the result goes to the library whole, or in parts cut at safe blanks.
"""

from __future__ import annotations

import codecs
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

from .shingles import mix


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file's place, through the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Marks that both pre-tokenizers split off after a letter or digit.
TAIL = ".,!?;:%$&*#|)"
#: Characters of a part of a long text, about, and bytes of parts that are cut at once.
PART, BLOCK = 1 << 18, 1 << 19
#: Blanks that part a text wherever they stand alone between two other characters.
_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: White space other than the blank and the line end, in any reading of the term.
_OTHER_SPACE = re.compile(r"[^\S \n]")
#: Letters up to here are letters in every edition of Unicode that a library may follow.
_SETTLED = 0x530

_tail = np.zeros(256, bool)
_tail[[ord(c) for c in TAIL]] = True
_ascii_letter = np.zeros(256, bool)
_ascii_letter[[*range(65, 91), *range(97, 123)]] = True
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_HIGH = np.uint64(0x8080808080808080)


def _byte_letters() -> str:
    """The letters that stand for the 256 bytes in a byte-level vocabulary: printable ones for themselves, the others in
    turn from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return "".join(chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256))


_LETTERS = _byte_letters()


def _settled(folded: bool):
    """A test for words of letters below _SETTLED; folded: of such as lower-casing and composition leave alone."""
    letters = [c for c in map(chr, range(_SETTLED)) if c.isalpha() and not (folded and (c.lower() != c or not unicodedata.is_normalized("NFC", c)))]
    return re.compile(f"[{''.join(letters)}]+").fullmatch


def _lower(x: np.ndarray) -> np.ndarray:
    """Eight ASCII characters in each number, A-Z in lower case."""
    up = (x + np.uint64(0x3F3F3F3F3F3F3F3F)) & ~(x + np.uint64(0x2525252525252525)) & _HIGH
    return x | (up >> np.uint64(2))


class _Table:
    """Pieces of up to 15 bytes, as two numbers that hold all their bytes, and where their ids lie. Open addressing in one
    array of 24 bytes a place; it doubles when it is 55 % full and is emptied beyond `most` pieces."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.places, self.n = np.zeros((1 << 12, 3), np.uint64), 0
        self.pool, self.used = np.zeros(1 << 14, np.uint16), 0
        self.long: dict[tuple[bytes, bool], int] = {}

    def _slot(self, k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
        return (mix(k0 ^ mix(k1)) & np.uint64(len(self.places) - 1)).astype(np.int64)

    def find(self, k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
        """Each piece's (first id << 16 | number of ids), 0 where it isn't there."""
        out, rest, slot = np.zeros(len(k0), np.uint64), np.arange(len(k0)), self._slot(k0, k1)
        while len(rest):
            got = self.places.take(slot, axis=0)
            hit = (got[:, 0] == k0) & (got[:, 1] == k1)
            out[rest[hit]] = got[hit, 2]
            on = np.flatnonzero(~hit & (got[:, 1] != 0))
            rest, slot, k0, k1 = rest[on], (slot[on] + 1) & (len(self.places) - 1), k0[on], k1[on]
        return out

    def _put(self, k0: np.ndarray, k1: np.ndarray, value: np.ndarray) -> None:
        slot = self._slot(k0, k1)
        while len(slot):
            free = np.flatnonzero(self.places[slot, 1] == 0)
            _, one = np.unique(slot[free], return_index=True)
            now = free[one]
            self.places[slot[now]] = np.stack([k0[now], k1[now], value[now]], axis=1)
            rest = np.ones(len(slot), bool)
            rest[now] = False
            taken = np.flatnonzero(rest)
            slot, k0, k1, value = (slot[taken] + 1) & (len(self.places) - 1), k0[taken], k1[taken], value[taken]

    def add_ids(self, ids: list[bytes]) -> np.ndarray:
        """Puts ids into the pool; each one's (first id << 16 | number of ids)."""
        n, new = np.array([len(x) // 2 for x in ids], np.int64), np.frombuffer(b"".join(ids), "<u2")
        while self.used + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(new)] = new
        first = self.used + np.cumsum(n) - n
        self.used += len(new)
        return (first << 16 | n).astype(np.uint64)

    def add(self, k0: np.ndarray, k1: np.ndarray, value: np.ndarray) -> None:
        """New pieces, none of them twice."""
        self.n += len(k0)
        while self.n > 0.55 * len(self.places):
            old = self.places[self.places[:, 1] != 0]
            self.places = np.zeros((2 * len(self.places), 3), np.uint64)
            self._put(old[:, 0], old[:, 1], old[:, 2])
        self._put(k0, k1, value)


class Encoder:
    """Ids as little-endian unsigned 16-bit bytes. words: the tokenizer drops white space and folds case (no blank belongs
    to a token); otherwise a blank is the first character of the next token. most: pieces kept in the table, of about 50
    bytes each."""

    def __init__(self, path: str, most: int = 1_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.words = self.library.normalizer is not None
        self.table = _Table(most)
        self.model, self.settled = self.library.model, _settled(self.words)
        self.pair = [k.to_bytes(2, "little") for k in range(self.library.get_vocab_size())]
        self.new_line, self.marks = self._whole("\n"), {c: self._whole(c) for c in ("", *TAIL)}
        if any(len(self.marks[c]) != 2 for c in TAIL) or len(self.new_line) != (0 if self.words else 2):
            raise ValueError("a mark or a line end is not one token")
        self.mark = np.zeros(256, np.uint16)
        for c in TAIL:
            self.mark[ord(c)] = int.from_bytes(self.marks[c], "little")

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _split(self, word: str) -> str | None:
        """Letters alone as the library's model reads them, one pre-token; None: the library has to split or fold them."""
        if word.isascii():
            return (word.lower() if self.words else word) if word.isalpha() else None
        return codecs.charmap_decode(word.encode(), "strict", _LETTERS)[0] if self.settled(word) else None

    def _encoded(self, heads: str, words: list[str]) -> list[bytes]:
        """The ids of words that are one pre-token each, with what stands before them, from the library's model."""
        pair, tokenize = self.pair, self.model.tokenize
        return [b"".join([pair[t.id] for t in tokenize(heads + w)]) for w in words]

    def _learn(self, pieces: list[bytes], blank: bool) -> list[bytes]:
        """The ids of any pieces; blank: one stands before each."""
        words = [p.decode("utf-8", "surrogatepass") for p in pieces]
        cores = [w.rstrip(TAIL) for w in words]
        splits = [self._split(c) for c in cores]
        known = iter(self._encoded("\u0120" if blank else "", [x for x in splits if x is not None]))
        out = [b"" if x is None else next(known) + self._marks(w[len(c) :]) for x, w, c in zip(splits, words, cores)]
        hard = [(i, " " + words[i] if blank else words[i]) for i, x in enumerate(splits) if x is None]
        if hard:
            e = self.library.encode([w for _, w in hard], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(e.ids, "<u2").tobytes()
            ends = np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(hard)), "right") * 2
            at = 0
            for (i, _), end in zip(hard, ends.tolist()):
                out[i] = ids[at:end]
                at = end
        return out

    def _marks(self, tail: str) -> bytes:
        if tail not in self.marks:
            if len(self.marks) > 10_000:
                self.marks = {c: self.marks[c] for c in ("", *TAIL)}
            self.marks[tail] = self._whole(tail)
        return self.marks[tail]

    def _folded(self, piece: bytes) -> bytes:
        return piece.lower() if self.words and piece.isascii() else piece

    def _cut(self, parts: list[bytes], inner: list[bool]) -> list[bytes | None]:
        """The ids of each part; None: it has to go to the library whole. inner: it goes on after a blank."""
        raw = b" ".join(parts) + b" "
        data = np.frombuffer(raw + bytes(16), np.uint8)
        end = np.flatnonzero((data[: len(raw)] == 32) | (data[: len(raw)] == 10))
        begin = np.concatenate([[0], end[:-1] + 1])
        size = end - begin
        stops = np.searchsorted(end, np.cumsum([len(p) + 1 for p in parts]) - 1) + 1
        starts = np.concatenate([[0], stops[:-1]])
        last, before = data[end - 1], data[end - 2]
        marked = (size > 1) & _tail[last] & _ascii_letter[before]
        core = size - marked
        blank, line = np.zeros(len(end), bool), np.zeros(len(end), np.int64)
        if not self.words:
            line[1:] = data[begin[1:] - 1] == 10
            line[starts] = 0
            blank = line == 0
            blank[starts] = inner
        value = np.zeros(len(end), np.uint64)
        short = np.flatnonzero((core > 0) & (core < 16))
        eight = np.ndarray((len(raw) + 8,), "<u8", data, strides=(1,))
        at, n = begin[short], core[short]
        k0, k1 = eight[at] & _MASK[np.minimum(n, 8)], eight[at + 8] & _MASK[np.maximum(n - 8, 0)]
        if self.words:
            ascii_ = ((k0 | k1) & _HIGH) == 0
            k0, k1 = np.where(ascii_, _lower(k0), k0), np.where(ascii_, _lower(k1), k1)
        k1 |= (n.astype(np.uint64) | (blank[short].astype(np.uint64) << np.uint64(4))) << np.uint64(56)
        value[short] = self.table.find(k0, k1)

        low = raw.lower() if self.words else raw
        lacks = np.flatnonzero(value[short] == 0)
        if len(lacks):
            letters = np.cumsum(_ascii_letter[data], dtype=np.int32)
            where = short[lacks]
            alone = letters[begin[where] + core[where] - 1] - letters[begin[where] - 1] == core[where]  # begin 0 reads the zeros at the end
            alone[begin[where] == 0] = False
            for plain in (True, False):
                for head in (False, True):
                    some = lacks[(alone == plain) & (blank[where] == head)]
                    if len(some):
                        at, to = begin[short[some]].tolist(), (begin + core)[short[some]].tolist()
                        if plain:
                            new = dict(zip([low[a:b] for a, b in zip(at, to)], some.tolist()))
                            ids = self._encoded("\u0120" if head else "", b" ".join(new).decode().split(" "))
                        else:
                            new = dict(zip([self._folded(raw[a:b]) for a, b in zip(at, to)], some.tolist()))
                            ids = self._learn(list(new), head)
                        one = np.array(list(new.values()))
                        self.table.add(k0[one], k1[one], self.table.add_ids(ids))
            value[where] = self.table.find(k0[lacks], k1[lacks])
        longer = np.flatnonzero(core > 15)
        for head in (False, True):
            some = longer[blank[longer] == head]
            if len(some):
                named = [(self._folded(raw[a:b]), head) for a, b in zip(begin[some].tolist(), (begin + core)[some].tolist())]
                lack = [p for p in dict.fromkeys(named) if p not in self.table.long]
                self.table.long.update(zip(lack, self.table.add_ids(self._learn([p for p, _ in lack], head)).tolist()))
                value[some] = np.array([self.table.long[p] for p in named], np.uint64)

        n = (value & np.uint64(0xFFFF)).astype(np.int64)
        each = line + n + marked
        to = np.cumsum(each)
        ids = np.empty(to[-1], np.uint16)
        to -= each
        seen = np.cumsum(n) - n
        place = np.arange(n.sum())
        ids[place + np.repeat(to + line - seen, n)] = self.table.pool[place + np.repeat((value >> np.uint64(16)).astype(np.int64) - seen, n)]
        if not self.words:
            ids[to[line > 0]] = int.from_bytes(self.new_line, "little")
        on = np.flatnonzero(marked)
        ids[to[on] + line[on] + n[on]] = self.mark[last[on]]
        bounds = np.append(to, len(ids))
        unsure = np.zeros(len(parts), bool)
        if not self.words:  # two blanks in a row, or one at an end, belong to tokens of their own
            unsure = np.add.reduceat(size == 0, starts) > 0
            unsure &= np.array([len(p) > 0 for p in parts])
        return [None if bad else ids[bounds[a] : bounds[b]].tobytes() for a, b, bad in zip(starts.tolist(), stops.tolist(), unsure)]

    def encode(self, texts: Iterable[str], group: int = 4096) -> list[bytes]:
        """The ids of each text. At most `group` parts of texts, and about BLOCK bytes, are cut at once."""
        out: list[bytes] = []
        held: list[tuple[str, bool, bool]] = []
        size = 0
        joined: list[bytes] = []

        def flush() -> None:
            if self.table.n + len(self.table.long) > self.table.most:
                self.table.clear()
            got = self._cut([p.encode("utf-8", "surrogatepass") for p, _, _ in held], [inner for _, inner, _ in held])
            for (part, inner, done), ids in zip(held, got):
                if ids is None or "<|" in part or (not self.words and _OTHER_SPACE.search(part)):
                    ids = self._whole(" " + part if inner and not self.words else part)
                joined.append(ids)
                if done:
                    out.append(b"".join(joined))
                    joined.clear()
            held.clear()

        for text in texts:
            parts = list(_parts(text))
            for k, part in enumerate(parts):
                held.append((part, k > 0, k == len(parts) - 1))
                size += len(part)
                if size >= BLOCK or len(held) >= group:
                    flush()
                    size = 0
        if held:
            flush()
        return out


def _parts(text: str) -> Iterator[str]:
    """A long text in parts without the single blanks between them."""
    at = 0
    while len(text) - at > PART:
        m = _SAFE.search(text, at + PART)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.end()
    yield text[at:] if at else text


_encoders: dict[str, Encoder] = {}


def release() -> None:
    """Gives back the tables of this worker process; later stages, which reuse it, don't need them."""
    _encoders.clear()


def encoder(path: str, most: int) -> Encoder:
    """One encoder a worker process and path, until release()."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, most)
    return _encoders[path]
