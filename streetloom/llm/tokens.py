"""Token ids of whole texts, by the tokenizers library, with a bounded cache of pieces."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import begin_task, kept

#: Pieces that one worker learns before the oldest go: those not used since the last time this many were new.
CACHE_PIECES = 350_000
#: Texts are encoded in groups of about so many characters.
GROUP_CHARS = 4_000_000
#: So many new pieces are encoded as one text, so many texts at a time.
TOGETHER, TEXTS = 50, 200
#: How a byte-level vocabulary writes the space at the start of a token (fixed value).
_SPACE = "\u0120"
#: Letters in every version of Unicode that a library may have. The pre-tokenizer cuts only after a run of them, after a mark that ends it and after a line break between two.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
_WORDS = re.compile(f"({_LETTERS})([.,;:!?]?)(?:\n({_LETTERS})([.,;:!?]?))?").fullmatch
#: The line break between two words as a piece; texts' own pieces never begin so.
_BREAK = "  \n"
#: Id that ends a document.
END = (2).to_bytes(4, "little")


class _Known:
    """Pieces with their ids: the number of a piece, and by number where its ids are. Number 0: white space touches the piece."""

    def __init__(self):
        self.number: dict[str, int] = {"": 0}
        self.n, self.used = 1, 0
        self.start, self.size, self.ids = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32), np.zeros(1 << 16, np.uint32)

    def add(self, pieces: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        n, used = self.n + len(pieces), self.used + len(ids)
        while len(self.start) < n:
            self.start, self.size = np.append(self.start, np.zeros_like(self.start)), np.append(self.size, np.zeros_like(self.size))
        if len(self.ids) < used:
            self.ids = np.append(self.ids, np.zeros(max(used, len(self.ids)), np.uint32))
        ends = self.used + np.cumsum(sizes)
        self.start[self.n:n], self.size[self.n:n] = ends - sizes, sizes
        self.ids[self.used:used] = ids
        self.number.update(zip(pieces, range(self.n, n)))
        self.n, self.used = n, used

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of the numbers has, and the ids of all in a row."""
        size = self.size[numbers]
        ends = np.cumsum(size, dtype=np.int64)
        at = np.repeat(self.start[numbers] - (ends - size), size)
        at += np.arange(len(at))
        return size, self.ids[at]


class Encoder:
    """ids of a text as little-endian unsigned 32-bit integers, as the library gives them with add_special_tokens=False.

    So an added token's string in a text (like <|endoftext|>) gets that token's id; such a text is encoded as a whole.

    A byte-level BPE with the usual pre-tokenizer never joins what stands before a space with what follows it, if
    the space stands between two characters that aren't white space. So a text is cut before such spaces, and each
    distinct piece is encoded once. A text with other runs of white space beside a space is encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.model = Tokenizer.from_file(path)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        vocab = self.model.get_vocab()
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)  # ids whose token starts with a space
        self.spaced[[i for t, i in vocab.items() if t.startswith(_SPACE)]] = True
        self.words = Tokenizer(self.model.model)  # takes words of ASCII letters as the byte-level pre-tokenizer writes them
        self.words.pre_tokenizer = CharDelimiterSplit(" ")
        self.limit = CACHE_PIECES
        #: a piece without a space before it is held with a space in front, one with a space without it
        self.known, self.older = _Known(), _Known()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str], words: bool) -> None:
        """ids of the pieces, each with the space before it: many are encoded as one text and cut where a token starts with a space."""
        model = self.words if words else self.model
        for lo in range(0, len(new), TOGETHER * TEXTS):
            some = new[lo: lo + TOGETHER * TEXTS]
            joined = [" ".join(some[a: a + TOGETHER]) for a in range(0, len(some), TOGETHER)]
            joined = [_SPACE + t.replace(" ", f" {_SPACE}") if words else f" {t}" for t in joined]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in model.encode_batch_fast(joined, add_special_tokens=False)])
            at = np.append(np.flatnonzero(self.spaced[ids]), len(ids))
            if len(at) != len(some) + 1 or at[0]:
                raise ValueError("the vocabulary doesn't start pieces with their space")
            self.known.add(some, np.diff(at), ids)

    def _learn_heads(self, new: list[str]) -> None:
        """ids of pieces without a space before them."""
        ids = [e.ids for e in self.model.encode_batch_fast([h.lstrip(" ") for h in new], add_special_tokens=False)]
        self.known.add(new, np.array([len(x) for x in ids], np.int64), np.array([i for x in ids for i in x], np.uint32))

    def _learn_made(self, made: dict[str, list[str]]) -> None:
        """ids of pieces made of others, which are known."""
        counts = np.array([len(x) for x in made.values()])
        size, ids = self.known.of(np.array([self.known.number[x] for parts in made.values() for x in parts]))
        self.known.add(list(made), np.add.reduceat(size, np.cumsum(counts) - counts), ids)

    def _unknown(self, pieces) -> list[str]:
        """Which of the pieces have to be learned; those known before come over."""
        known, older = self.known, self.older
        if older.n == 1:
            return list(pieces)
        found = list(map(older.number.get, pieces))
        again = [(p, n) for p, n in zip(pieces, found) if n]
        if again:
            held, numbers = zip(*again)
            known.add(list(held), *older.of(np.array(numbers)))
        return [p for p, n in zip(pieces, found) if not n]

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """The numbers of distinct pieces; those not yet known are learned."""
        known = self.known.number
        out = list(map(known.get, pieces))
        at = [i for i, n in enumerate(out) if n is None]
        words, heads, rest, made = [], [], [], {}
        for p in self._unknown([pieces[i] for i in at]):
            if p.isalpha() and p.isascii():
                words.append(p)
            elif not p.isalpha() and (m := _WORDS(p)):
                word, mark, then, last = m.groups()
                made[p] = [word, *([f" {mark}"] if mark else ()), *([_BREAK, f" {then}"] if then else ()), *([f" {last}"] if last else ())]
            elif p == p.strip():
                rest.append(p)
            elif p[0] == " " and p[1:] == p.strip():
                heads.append(p)
            else:
                known[p] = 0
        if made:
            more = {x for parts in made.values() for x in parts}.difference(known, words, heads, rest)
            for p in self._unknown(more):
                (heads if p[0] == " " else words if p.isascii() else rest).append(p)
        self._learn(words, True)
        self._learn(rest, False)
        if heads:
            self._learn_heads(heads)
        if made:
            self._learn_made(made)
        for i in at:
            out[i] = known[pieces[i]]
        return np.array(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.known.n > self.limit or len(self.known.number) > 2 * self.limit:
            self.older, self.known = self.known, _Known()
        out = [b""] * len(texts)
        rest = [i for i, t in enumerate(texts) if t and any(a in t for a in self.added)]
        cut = sorted({i for i, t in enumerate(texts) if t}.difference(rest))
        if cut:
            parts = pc.split_pattern(pa.array([texts[i] for i in cut], pa.large_string()), " ")
            first = parts.offsets.to_numpy()
            found = parts.flatten().dictionary_encode()
            place, pieces = found.indices.to_numpy(), found.dictionary.to_numpy(zero_copy_only=False).tolist()
            del parts, found
            begin, which = np.unique(place[first[:-1]], return_inverse=True)  # the pieces that texts begin with
            numbers = self._numbers(pieces + [" " + pieces[k] for k in begin.tolist()])
            number = numbers[place]
            number[first[:-1]] = numbers[len(pieces):][which]
            whole = np.minimum.reduceat(number, first[:-1]) == 0
            size, ids = self.known.of(number)
            ends = np.append(0, 4 * np.cumsum(size, dtype=np.int64))[first].tolist()
            raw = memoryview(ids).cast("B")
            for i, a, z, bad in zip(cut, ends, ends[1:], whole.tolist()):
                if bad:
                    rest.append(i)
                else:
                    out[i] = bytes(raw[a:z])
        for i in rest:
            out[i] = self._whole([texts[i]])[0]
        return out


def encoder(path: str, limit: int = CACHE_PIECES) -> Encoder:
    """This worker's encoder of the vocabulary at path, its cache bounded by limit from now on; goes when another operator's task begins."""
    begin_task("tokens")
    held = kept("tokens")
    if path not in held:
        held[path] = Encoder(path)
    held[path].limit = limit
    return held[path]
