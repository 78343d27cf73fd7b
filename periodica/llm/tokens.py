"""Whole texts to token ids with the tokenizers library, at the speed of a table lookup for text seen before.

Text is cut at places where both the pre-tokenizer and the merges always stop, each distinct piece is encoded
by the library once for each worker, and ids of a text are gathered from the pieces' ids. Texts for which such
cuts aren't safe (special tokens, runs of white space) are encoded whole. The result equals
Tokenizer.encode(text, add_special_tokens=False).ids.
"""

from __future__ import annotations

import os
import re
import unicodedata
from itertools import chain, compress, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex


def ragged_gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[starts[0] : starts[0] + sizes[0]], flat[starts[1] : ...], ... one after another."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    out = np.arange(total, dtype=np.int64)
    out += np.repeat(starts - (ends - sizes), sizes)
    return flat[out]


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if it is visible Latin-1, else the next from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        if b in visible:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


#: The public patterns of the two kinds of vocabulary, as their files give them.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
#: Below this character, lower-casing and character classes are the same in all libraries.
COMMON = "\u0250"


class Grown:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.data, self.n = np.empty(1 << 16, dtype), 0

    def extend(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.data):
            more = np.empty(max(2 * len(self.data), self.n + len(x)), self.data.dtype)
            more[: self.n] = self.data[: self.n]
            self.data = more
        self.data[self.n : self.n + len(x)] = x
        self.n += len(x)

    def cut(self, n: int) -> None:
        self.n = n


class Numbered(dict):
    """Numbers keys in the order in which they first come up, and lists those that are new."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n

    def numbers(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))

    def numbers_of_distinct(self, keys: list[str]) -> np.ndarray:
        """As numbers, for keys of which none repeats."""
        new = [k for k in keys if k not in self]
        self.update(zip(new, range(len(self), len(self) + len(new)), strict=True))
        self.new += new
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))

    def keep_first(self, n: int) -> None:
        """Forgets all but the first n keys, which are the more frequent ones since they came up early."""
        first = list(islice(self, n))
        self.clear()
        self.update(zip(first, range(n), strict=False))

    def take_new(self) -> list[str]:
        new, self.new = self.new, []
        return new


#: A comma or full stop that doesn't stand after a letter or number.
AFTER_OTHER = re.compile(r"[,.](?:(?<=[\W_].)|(?<=^.))").search


#: Stands where a text is cut, and in no text that is cut.
MARK = "\x00"


def byte_level_marks(text: str) -> str | None:
    """The text with a mark between pieces for the byte-level pre-tokenizer, each independent of its neighbours; None if white space stands in runs.

    The pre-tokenizer takes one space along with what follows it and cuts around line feeds, so a text without
    double spaces and empty lines can be cut before each space and before each line feed.
    """
    if "  " in text or "\n\n" in text or MARK in text:
        return None
    marked = text.replace(" ", MARK + " ").replace("\n", MARK + "\n")
    if not AFTER_OTHER(text):  # a comma or stop after a letter or number begins a token of its own
        marked = marked.replace(",", MARK + ",").replace(".", MARK + ".")
    return marked


def byte_level_pieces(text: str) -> list[str] | None:
    """The pieces that byte_level_marks parts."""
    return None if (marked := byte_level_marks(text)) is None else marked.split(MARK)


#: Characters on whose being white space libraries differ.
ODD_SPACE = tuple("\x1c\x1d\x1e\x1f\x85\u180e\u200b\ufeff")


def word_pieces(text: str) -> list[str] | None:
    """Pieces for a pre-tokenizer that never crosses white space and drops it: the words; None where libraries differ on white space."""
    return None if any(c in text for c in ODD_SPACE) else text.split()


def keep_first(known: Numbered, flat: Grown, starts: Grown, sizes: Grown, n: int) -> None:
    """Shortens the memory of pieces to the first n."""
    known.keep_first(n)
    flat.cut(int(starts.data[n]))
    starts.cut(n)
    sizes.cut(n)


def most_used(uses: np.ndarray, n: int) -> np.ndarray:
    """At most n places, ascending, of pieces that came up more than once; among equals the earlier ones stay."""
    order = np.argsort(-uses.astype(np.int64), kind="stable")[:n]
    return np.sort(order[uses[order] > 1])


class Encoder:
    """encode(texts) -> (flat ids, number of ids of each text).

    A new piece of common letters is normalised and pre-tokenized here, as the tokenizer's file says, and its
    pre-tokens go to the library's model; every other new piece goes through the whole library. `most` bounds
    the number of remembered pieces. Byte-level pieces are split and told apart by Arrow, so that Python sees
    each distinct one once for a list of texts; those of several lists stay longest, as most words occur once.
    """

    def __init__(self, path: str, pieces, most: int = 350_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.pieces, self.most = pieces, most
        self.lower, self.model = pieces is word_pieces, self.tok.model
        if pieces is byte_level_pieces:
            self.pieces = byte_level_marks
        self.cut = regex.compile(WORD_PATTERN if self.lower else BYTE_PATTERN).findall
        self.alphabet = {i: c for i, c in enumerate(byte_alphabet())}
        self.tokens: dict[str, list[int]] = {}
        self.known = Numbered()
        self.flat, self.starts, self.sizes, self.uses = Grown(np.uint32), Grown(np.int64), Grown(np.int64), Grown(np.uint32)

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _signs(self, token: str) -> str:
        plain = token.isascii() and token.isprintable()  # then only the space has another sign
        return token.replace(" ", self.alphabet[32]) if plain else token.encode().decode("latin-1").translate(self.alphabet)

    def _by_model(self, token: str) -> list[int]:
        if (ids := self.tokens.get(token)) is None:
            if len(self.tokens) > self.most // (2 if self.lower else 4):
                self.tokens.clear()
            ids = self.tokens[token] = [x.id for x in self.model.tokenize(self._signs(token))]
        return ids

    def _learn(self, new: list[str]) -> None:
        for a in range(0, len(new), 8192):  # lists of ids are large beside the arrays that keep them
            self._learn_some(new[a : a + 8192])

    def _learn_some(self, new: list[str]) -> None:
        got: list[list[int]] = [[]] * len(new)
        rest, tokenize = [], self.model.tokenize
        for i, x in enumerate(new):
            if x.isascii() or max(x) < COMMON:
                if self.lower:
                    x = x.lower() if x.isascii() else unicodedata.normalize("NFC", x).lower()
                if not self.lower and (x.isalpha() or x[:1] == " " and x[1:].isalpha()):
                    got[i] = [t.id for t in tokenize(self._signs(x))]  # the piece itself is remembered
                    continue
                if self.lower and x.isalpha():
                    got[i] = self._by_model(x)
                    continue
                if self.lower and x[:-1].isalpha() and x[-1] in ",.!?;:":
                    got[i] = self._by_model(x[:-1]) + self._by_model(x[-1])
                    continue
                c = self.cut(x)
                got[i] = self._by_model(c[0]) if len(c) == 1 else [k for token in c for k in self._by_model(token)]
            else:
                rest.append(i)
        for a in range(0, len(rest), 4096):
            for i, ids in zip(rest[a : a + 4096], self.library([new[i] for i in rest[a : a + 4096]]), strict=True):
                got[i] = ids
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        self.starts.extend(self.flat.n + np.cumsum(sizes) - sizes)
        self.sizes.extend(sizes)
        self.flat.extend(np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())))

    def _number(self, marked: list[str]) -> np.ndarray:
        """The numbers of all pieces of marked texts."""
        pieces = pc.split_pattern(pa.array([MARK.join(marked)], pa.large_string()), MARK).flatten().dictionary_encode()
        numbers = self.known.numbers_of_distinct(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        self.uses.extend(np.zeros(len(self.known) - self.uses.n, np.uint32))
        self.uses.data[numbers] += 1
        return numbers[pieces.indices.to_numpy()]

    def _forget(self) -> None:
        """Makes room for new pieces."""
        if self.lower:
            keep_first(self.known, self.flat, self.starts, self.sizes, self.most // 2)
            return
        at = most_used(self.uses.data[: self.uses.n], self.most // 2)
        kept = np.zeros(len(self.known), bool)
        kept[at] = True
        keys = list(compress(self.known, kept))
        self.known.clear()
        self.known.update(zip(keys, range(len(keys)), strict=True))
        sizes = self.sizes.data[at]
        flat, uses = ragged_gather(self.flat.data, self.starts.data[at], sizes), self.uses.data[at]
        for grown, x in ((self.flat, flat), (self.starts, np.cumsum(sizes) - sizes), (self.sizes, sizes), (self.uses, uses)):
            grown.cut(0)
            grown.extend(x)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.most:
            self._forget()
        known, idx, counts, whole, marked = self.known, [], [], {}, []
        for i, t in enumerate(texts):
            p = None if any(s in t for s in self.special) else self.pieces(t)
            if p is None:
                whole[i] = np.array(self.library([t])[0], np.uint32)
                counts.append(0)
            elif self.pieces is byte_level_marks:
                counts.append(p.count(MARK) + 1)
                marked.append(p)
            else:
                counts.append(len(p))
                idx.append(known.numbers(p))
        if marked:
            idx.append(self._number(marked))
        self._learn(known.take_new())
        idx = np.concatenate(idx) if idx else np.empty(0, np.int64)
        sizes = self.sizes.data[idx]
        flat = ragged_gather(self.flat.data, self.starts.data[idx], sizes)
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts))).astype(np.int64)]
        n = np.diff(ends)
        if whole:
            parts = [whole.get(i, flat[ends[i] : ends[i + 1]]) for i in range(len(texts))]
            n = np.array([len(p) for p in parts], np.int64)
            flat = np.concatenate(parts) if parts else flat
        return flat, n


_encoders: dict[tuple, Encoder] = {}


def forget_encoders() -> None:
    _encoders.clear()


def encoder_for(path: str, kind: str) -> Encoder:
    """The encoder of this worker process for a tokenizer file; kind: `byte` or `word`. It lives on between tasks."""
    if (path, kind) not in _encoders:
        pieces, most = {"byte": (byte_level_pieces, 150_000), "word": (word_pieces, 350_000)}[kind]
        _encoders[path, kind] = Encoder(path, pieces, most)
    return _encoders[path, kind]
