"""Token ids by the tokenizers library, each distinct chunk of a text encoded once.

A chunk is a piece of text at whose ends every tokenizer of its kind cuts
anyway, so a text's ids are its chunks' ids in a row.
"""

from __future__ import annotations

import os
import re
import string
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import gather, runs, utf8

#: Letters that no normaliser but lower-casing changes, and one stop: such a chunk is a word, or a word and a stop.
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
PLAIN = re.compile(f"( ?{LETTERS})([.,]?)").fullmatch

#: By byte: the ASCII ones of LETTERS, the second bytes of its others (the first is 0xC3), and ASCII that shows.
LETTER = np.isin(np.arange(256), np.frombuffer(string.ascii_letters.encode(), np.uint8))
SECOND = (np.arange(256) >> 6 == 2) & ~np.isin(np.arange(256), [0x97, 0xB7])
SHOWN = (np.arange(256) > 0x20) & (np.arange(256) < 0x7F)
#: UTF-8 of white space beyond ASCII.
WIDE_SPACES = [c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write each character up to U+00FF: its bytes' printable stand-ins."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


class ChunkEncoder:
    """Encode string arrays; keeps the ids of chunks seen, up to a bound.

    spaced: True where text is lower-cased and white space never enters a token (chunks are
    runs of other characters), False where a token may begin with one space, and letters and
    other characters share none (a chunk is a word with the space before it, or what lies between).
    """

    def __init__(self, path: str, spaced: bool, max_chunks: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced, self.max_chunks = spaced, max_chunks
        self.model, self.letters, self.stops = self.tokenizer.model, byte_letters(), {}
        for stop in (".", ","):
            self.stops[stop] = self.tokenizer.encode(stop, add_special_tokens=False).ids
        self.cuts = ~LETTER & (np.arange(256) < 128)  # what may begin a chunk after a letter: no character of an added token
        self.cuts[list("".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values()).encode())] = False
        self.known: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.at, self.met = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)  # met: in how many runs

    def forget(self) -> None:
        """Forget all chunks but those that runs met again, and of these but the most met: half the bound at most."""
        known = list(self.known)
        met = self.met[: len(known)]
        kept = np.flatnonzero(met > 1)
        if len(kept) > self.max_chunks // 2:
            kept = np.sort(kept[np.argsort(-met[kept], kind="stable")[: self.max_chunks // 2]])
        lengths = self.at[kept + 1] - self.at[kept]
        ids = self.ids[gather(self.at[kept], lengths)]
        self.known = {known[k]: i for i, k in enumerate(kept.tolist())}
        self.ids[: len(ids)] = ids
        self.at[1 : len(kept) + 1] = np.cumsum(lengths)
        self.met[: len(kept)] = met[kept] // 2  # what is not met again goes some day
        self.met[len(kept) :] = 0

    def _encode(self, chunks: list[str]) -> tuple[list[int], list[int]]:
        """All ids in a row, and the number of each chunk's. Plain words go to the vocabulary's model, anything else through the whole tokenizer."""
        tokenize, letters, stops, known, lower = self.model.tokenize, self.letters, self.stops, self.known, self.spaced
        space = letters[32]
        plain = list(map(PLAIN, chunks))
        rest = iter(self.tokenizer.encode_batch_fast([c for c, m in zip(chunks, plain, strict=True) if m is None], add_special_tokens=False))
        flat, counts = [], []
        for m in plain:
            if m is None:
                got = next(rest).ids
            else:
                word, stop = m.groups()
                if stop and (k := known.get(word)) is not None:
                    got = self.ids[self.at[k] : self.at[k + 1]].tolist()
                else:
                    name = word.lower() if lower else word
                    name = name.translate(letters) if not name.isascii() else name if name[0] != " " else space + name[1:]
                    got = [t.id for t in tokenize(name)]
                if stop:
                    got += stops[stop]
            flat += got
            counts.append(len(got))
        return flat, counts

    def _learn(self, chunks: list[str]) -> None:
        flat, counts = self._encode(chunks)
        n, lengths = len(self.known), np.array(counts, np.int64)
        ends = self.at[n] + np.cumsum(lengths)
        while len(self.at) < n + len(chunks) + 1:
            self.at, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.met))
        while len(self.ids) < ends[-1]:
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.at[n] : ends[-1]] = flat
        self.at[n + 1 : n + len(chunks) + 1] = ends
        self.known.update(zip(chunks, range(n, n + len(chunks)), strict=True))

    def _firm(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether what lies before each place is a character other than white space."""
        last = data[at - 1]
        firm = SHOWN[last]
        wide = np.flatnonzero(last >= 128)
        spaces = np.zeros(len(wide), bool)
        for space in WIDE_SPACES:
            spaces |= np.logical_and.reduce([data[at[wide] - k] == b for k, b in enumerate(reversed(space), 1)])
        firm[wide] = ~spaces
        return firm

    def _chunks(self, texts: pa.Array) -> pa.ListArray | pa.LargeListArray:
        """Cut before white space, between a letter and other ASCII, and between a line end and a letter.

        Tokenizers of the kind look ahead only from white space, and only to
        where it ends, so a cut before all of it changes nothing; one behind a
        line end does not if the line end is all of it.
        """
        if self.spaced:
            return pc.ascii_split_whitespace(texts)
        data, ends = utf8(texts)
        first = np.zeros(len(data) + 1, bool)
        first[ends] = True  # what is asked about places before a text's first byte has no effect
        at = np.flatnonzero(self.cuts[data])
        last = data[at - 1]
        after = LETTER[last] | SECOND[last] & (data.take(at - 2, mode="wrap") == 0xC3)
        rest = at[~after]
        space, line = rest[data[rest] == 0x20], at[data[at] == 0x0A]
        line = line[line + 1 < len(data)]
        first[at[after]] = True
        first[space[self._firm(data, space)]] = True
        letter = LETTER[data[line + 1]] | (data[line + 1] == 0xC3) & SECOND[data.take(line + 2, mode="clip")]
        line = line[letter]
        first[line[self._firm(data, line)] + 1] = True
        starts = np.flatnonzero(first[:-1])
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)])
        return pa.LargeListArray.from_arrays(pa.array(np.searchsorted(starts, ends)), words)

    def encode(self, texts: pa.Array, most_bytes: int = 6 << 20) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) in a row, and n + 1 offsets of each text's ids."""
        ids, counts = [], []
        for a, b in runs(texts, most_bytes):
            lists = self._chunks(texts[a:b])
            coded = lists.flatten().dictionary_encode()
            codes, chunks = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            if len(self.known) + len(chunks) > self.max_chunks:
                self.forget()
            which = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
            if len(new := np.flatnonzero(which < 0)):
                which[new] = len(self.known) + np.arange(len(new))
                self._learn([chunks[k] for k in new.tolist()])
            self.met[which] += 1
            start, lengths = self.at[which], self.at[which + 1] - self.at[which]
            lengths = lengths[codes]
            ids.append(self.ids[gather(start[codes], lengths)])
            ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])]
            counts.append(np.diff(ends))
        flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
        return flat, np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)


_encoders: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, spaced: bool) -> ChunkEncoder:
    """This worker's encoder of a vocabulary file."""
    key = (path, spaced)
    if key not in _encoders:
        _encoders[key] = ChunkEncoder(path, spaced)
    return _encoders[key]


def with_end(flat: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append one id to each text's ids."""
    return np.insert(flat, ends[1:], np.uint32(end_id)), ends + np.arange(len(ends))
