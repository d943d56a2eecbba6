"""Token ids of whole texts, by the tokenizers library, with a memory of chunks.

Texts are cut where the tokenizer's own first step always cuts them, so that
encoding chunk by chunk gives the ids of the whole text: before a run of ASCII
white space, and between a Latin letter and ASCII punctuation. All chunks of
many texts are found, hashed (64 bits) and looked up as arrays; only chunks that
a worker doesn't remember are encoded, once each. New chunks of plain letters go
to the library's BPE model at once; any other goes through its whole encoding.
A text with special tokens, or white space for which cuts are not certain, is
encoded in one piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from millrace.llm._worker import held
from millrace.llm.words import SPACE, span_hashes

_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+\Z")
_LETTERS = re.compile(rb"[A-Za-z]+\Z")

#: Chunks that a worker remembers (some 40 bytes each), and bytes of text that are encoded at once.
MEMORY, TOGETHER = 600_000, 4 << 20


def _table(*groups) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for g in groups:
        out[list(g)] = True
    return out


_LETTER = _table(range(0x41, 0x5B), range(0x61, 0x7B))
_PUNCTUATION = _table(range(0x21, 0x30), range(0x3A, 0x41), range(0x5B, 0x61), range(0x7B, 0x7F))
#: The second byte of a Latin-1 letter whose first is 0xC3.
_LATIN = _table(range(0x80, 0x97), range(0x98, 0xB7), range(0xB8, 0xC0))
#: First bytes of white space that isn't ASCII's, and ASCII's separators, which libraries don't agree on.
_ODD = _table(range(0x1C, 0x20), (0xC2, 0xE1, 0xE2, 0xE3))
_WIDE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def _byte_letters() -> list[str]:
    """Byte -> the printable character that stands for it in byte-level BPE."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = [""] * 256
    for b in shown:
        out[b] = chr(b)
    for n, b in enumerate(b for b in range(256) if b not in shown):
        out[b] = chr(256 + n)
    return out


class Encoder:
    """Ids of texts, with a table from chunk hashes to ids.

    ``drops_space``: white space separates words and is dropped, and letters are
    lower-cased first; else white space belongs to the word after it.
    """

    def __init__(self, path: str, drops_space: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.drops_space = drops_space
        self.letters = _byte_letters()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line_end = self._whole("\n")
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _chunk(self, raw: bytes) -> list[int]:
        """The ids of one chunk."""
        before, lead = [], ""
        if not self.drops_space and raw[:1] in (b" ", b"\n"):
            before, lead = (self.line_end, "") if raw[0] == 0x0A else ([], self.letters[0x20])
            body = raw[1:]
        else:
            body = raw
        if _LETTERS.match(body):
            word = body.decode("ascii")
        else:
            word = body.decode("utf-8", "replace")
            if not _PLAIN.match(word):
                return self._whole(raw.decode("utf-8", "replace"))
            if not self.drops_space:
                word = "".join([self.letters[b] for b in body])
        if self.drops_space:
            word = word.lower()
            if not word.isascii():
                word = "".join([self.letters[b] for b in word.encode("utf-8")])
        return before + [t.id for t in self.model.tokenize(lead + word)]

    def encode_batch(self, texts: pa.Array, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first, last, ids, bounds) of runs of texts: ids (unsigned 32 bits) of all of them, and where each begins.

        ``end_id`` follows each text; a null text is empty.
        """
        texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
        if texts.null_count:
            texts = texts.fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + TOGETHER, side="right")) - 1)
            last = min(last, len(texts))
            yield first, last, *self._run(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], end_id)
            first = last

    def encode(self, text: str | None) -> list[int]:
        """The ids of one text; null is empty."""
        return next(self.encode_batch(pa.array([text], pa.large_string()), 0))[2][:-1].tolist()

    def _apart(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which texts must be encoded in one piece."""
        raw, found = data.tobytes(), []
        for mark in self.special:
            at = raw.find(mark)
            while at >= 0:
                found.append(at)
                at = raw.find(mark, at + 1)
        if not self.drops_space:
            odd = np.flatnonzero(_ODD[data])
            found += [p for p in odd.tolist() if _WIDE.match(raw, p)]
        return np.unique(np.searchsorted(bounds, found, side="right") - 1) if found else np.zeros(0, np.int64)

    def _cuts(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of chunks."""
        n = len(data)
        space = SPACE[data]
        letter = _LETTER[data]
        letter[1:] |= _LATIN[data[1:]] & (data[:-1] == 0xC3)
        begins = np.zeros(n + 1, dtype=bool)
        begins[bounds] = True
        cut = np.zeros(n + 1, dtype=bool)
        cut[1:n] = letter[:-1] & _PUNCTUATION[data[1:]]
        if self.drops_space:
            starts = ~space
            starts[1:] &= space[:-1] | begins[1:n] | cut[1:n]
            ends = ~space
            ends[:-1] &= space[1:] | begins[1:n] | cut[1:n]
            return np.flatnonzero(starts), np.flatnonzero(ends) + 1
        cut[1:n] |= ~space[:-1] & space[1:]
        cut |= begins
        cut[0] = False
        ends = np.flatnonzero(cut)
        return np.concatenate((np.zeros(min(1, len(ends)), np.int64), ends[:-1])), ends

    def _run(self, data: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        texts = len(bounds) - 1
        apart = self._apart(data, bounds)
        starts, ends = self._cuts(data, bounds) if len(data) else (np.zeros(0, np.int64),) * 2
        if len(apart):
            which = np.searchsorted(bounds, starts, side="right") - 1
            stay = ~np.isin(which, apart)
            starts, ends = starts[stay], ends[stay]
        at, n = self._known(data, starts, ends)
        # Chunks before each text, then ids before each text.
        before = np.concatenate(([0], np.cumsum(n)))
        first = before[np.searchsorted(starts, bounds)]
        sizes = np.diff(first)
        whole = {int(k): self._whole(data[bounds[k] : bounds[k + 1]].tobytes().decode("utf-8", "replace")) for k in apart}
        sizes[list(whole)] = [len(x) for x in whole.values()]
        out_bounds = np.concatenate(([0], np.cumsum(sizes + 1)))
        out = np.full(int(out_bounds[-1]), end_id, dtype=np.uint32)
        total = int(before[-1])
        if total:
            text = np.repeat(np.arange(texts), np.diff(first))
            place = np.arange(total) + (out_bounds[:-1] - first[:-1])[text]
            out[place] = self.ids[np.repeat(at - before[:-1], n) + np.arange(total)]
        for k, ids in whole.items():
            out[out_bounds[k] : out_bounds[k] + len(ids)] = ids
        return out, out_bounds

    def _known(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of every chunk are in ``ids``, and how many; new chunks are encoded."""
        hashes = span_hashes(data, starts, ends)
        order = np.argsort(hashes)
        sorted_ = hashes[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = sorted_[1:] != sorted_[:-1]
        unique, some = sorted_[new], order[new]
        inverse = np.empty(len(order), dtype=np.int64)
        inverse[order] = np.cumsum(new) - 1
        place = np.searchsorted(self.hashes, unique)
        known = np.zeros(len(unique), dtype=bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == unique[inside]
        at, n = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
        at[known], n[known] = self.at[place[known]], self.n[place[known]]
        missing = np.flatnonzero(~known)
        if len(missing):
            raw, chunk = data.tobytes(), self._chunk
            made = [chunk(raw[a:b]) for a, b in zip(starts[some[missing]].tolist(), ends[some[missing]].tolist(), strict=True)]
            n[missing] = [len(x) for x in made]
            at[missing] = len(self.ids) + np.cumsum(n[missing]) - n[missing]
            self.ids = np.concatenate((self.ids, np.array([i for x in made for i in x], dtype=np.uint32)))
            if len(self.hashes) + len(missing) > MEMORY:
                # Only what these texts hold is kept.
                keep = np.repeat(at - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                self.ids = self.ids[keep]
                at = np.cumsum(n) - n
                self.hashes, self.at, self.n = unique, at, n
            else:
                self.hashes = np.insert(self.hashes, place[missing], unique[missing])
                self.at = np.insert(self.at, place[missing], at[missing])
                self.n = np.insert(self.n, place[missing], n[missing])
        return at[inverse], n[inverse]


def encoder(path: str, drops_space: bool) -> Encoder:
    """One encoder in each worker process, kept from task to task."""
    return held(("encoder", path, drops_space), lambda: Encoder(path, drops_space))
