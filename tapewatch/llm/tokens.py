"""Byte-level BPE ids of whole texts, a batch of texts at a time.

A byte-level pre-tokenizer never joins what stands before a space with what follows it, unless the space has white
space on both sides; nor across a single line break between words, nor a word and one mark that ends it. So texts are
cut there, all words of a batch are hashed in numpy, and each distinct word is looked up in a bounded table. The
words that are new are encoded by the tokenizers library, as lines of one text, and enter the table. Segments in which
a space stands between other white space are encoded whole.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterable, Iterator

import numpy as np

MARKS = b".,;:!?"
#: Words that a worker keeps, about 60 bytes each; fewer make it encode words again.
ENTRIES = 500_000
#: Bytes of texts that are looked at together; longer texts are cut at a space between words.
BATCH = 1 << 20
SPACE, BREAK = 32, 10
#: How a word begins: at the start of a text, after a space, after a line break.
START, SPACED, BARE = 0, 1, 2
_OPEN: dict[tuple, PieceEncoder] = {}
# The white space of more than one byte, first byte: the bytes after it.
_WIDE = {
    0xC2: (b"\x85", b"\xa0"),
    0xE1: (b"\x9a\x80", b"\xa0\x8e"),
    0xE2: (*(bytes((0x80, k)) for k in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\x81\x9f"),
    0xE3: (b"\x80\x80",),
}
_MARK = np.zeros(256, bool)
_MARK[list(MARKS)] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_ODD = np.zeros(256, bool)
_ODD[[9, 10, 11, 12, 13, 28, 29, 30, 31, ord("<")]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def _powers(multiplier: int, batch: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    out = []
    for m in (multiplier, pow(multiplier, -1, 1 << 64)):
        p = np.full(2 * batch + 1, m, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class PieceEncoder:
    """Encodes texts to arrays of ids of two bytes where the vocabulary allows it, else of four."""

    def __init__(self, path: str, specials_as_text: bool = False, entries: int = ENTRIES, batch: int = BATCH):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_as_text
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.entries, self.batch = entries, batch
        self.marks = np.zeros(256, self.dtype)
        for m in MARKS + b"\n":
            (self.marks[m],) = self._whole([chr(m)])[0]  # one id each
        self.line = self.marks[BREAK]
        # the table, sorted by hash: a second hash, where a word's ids are, how many, and when it was last seen
        self.hash, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.off, self.size, self.seen = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used, self.clock = np.zeros(1 << 16, self.dtype), 0, 0
        self.powers = [_powers(m, batch) for m in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order; null counts as empty."""
        waiting: list[tuple[int, bytes]] = []  # (text's number, segment)
        first = last = size = 0
        parts: list[np.ndarray] = []

        def done(upto: int) -> Iterator[np.ndarray]:
            nonlocal parts, first
            for k, ids in zip((k for k, _ in waiting), self._some([s for _, s in waiting]), strict=True):
                while first < k:
                    yield np.concatenate(parts) if parts else np.zeros(0, self.dtype)
                    parts, first = [], first + 1
                parts.append(ids)
            while first < upto:
                yield np.concatenate(parts) if parts else np.zeros(0, self.dtype)
                parts, first = [], first + 1

        for text in texts:
            for s in self._segments((text or "").encode()):
                waiting.append((last, s))
                size += len(s)
                if size >= self.batch:
                    yield from done(last)  # the last text may go on
                    waiting, size = [], 0
            last += 1
        yield from done(last)

    def _segments(self, data: bytes) -> Iterator[bytes]:
        """Cuts before a space between letters or digits."""
        at = 0
        while len(data) - at > self.batch:
            end = data.rfind(b" ", at + 1, at + self.batch)
            while end > at and not (data[end - 1 : end].isalnum() and data[end + 1 : end + 2].isalnum()):
                end = data.rfind(b" ", at + 1, end)
            if end <= at:
                break  # no such space: the rest is one segment
            yield data[at:end]
            at = end
        if at < len(data):
            yield data[at:]

    def _some(self, segments: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, self.dtype)] * len(segments)
        usual = [k for k, s in enumerate(segments) if len(s) <= self.batch]
        buf = np.frombuffer(b"".join(segments[k] for k in usual), np.uint8)
        blank, bad = self._blanks(buf, np.cumsum([0, *(len(segments[k]) for k in usual)]))
        if bad.any():
            usual = [k for k, b in zip(usual, bad.tolist(), strict=True) if not b]
            buf = np.frombuffer(b"".join(segments[k] for k in usual), np.uint8)
            blank, _ = self._blanks(buf, np.cumsum([0, *(len(segments[k]) for k in usual)]))
        ends = np.cumsum([0, *(len(segments[k]) for k in usual)])
        left = set(range(len(segments)))
        if len(buf) and (found := self._words(buf, blank, ends)) is not None:
            ids, cuts = found
            for k, lo, hi in zip(usual, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                out[k] = ids[lo:hi]
            left -= set(usual)
        for k in sorted(left):
            out[k] = self._whole([segments[k].decode()])[0]
        return out

    @staticmethod
    def _blanks(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which bytes are white space, and which segments hold a space between other white space."""
        blank = _BLANK[buf]
        lead = np.flatnonzero((buf == 0xC2) | ((buf >= 0xE1) & (buf <= 0xE3)))
        if len(lead):
            after = np.zeros((2, len(lead)), np.uint8)
            for k in (1, 2):
                inside = lead + k < len(buf)
                after[k - 1, inside] = buf[lead[inside] + k]
            for first, rest in _WIDE.items():
                of = buf[lead] == first
                for r in rest:
                    hit = of & (after[0] == r[0]) & (after[1] == r[1] if len(r) == 2 else True)
                    for k in range(len(r) + 1):
                        blank[lead[hit] + k] = True
        amid = np.flatnonzero((buf[1:-1] == SPACE) & blank[:-2] & blank[2:]) + 1
        bad = np.zeros(len(ends) - 1, bool)
        if len(amid):
            of = np.searchsorted(ends, amid, "right") - 1
            bad[of[(amid > ends[of]) & (amid + 1 < ends[of + 1])]] = True
        return blank, bad

    def _words(self, buf: np.ndarray, blank: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of the joined segments and where each segment's ids end; None if two words share a hash."""
        lo, hi = ends[:-1], ends[1:]
        line = np.flatnonzero(buf == BREAK)
        if len(line):
            edge = np.zeros(len(buf) + 1, bool)
            edge[ends] = True
            line = line[~edge[line] & ~edge[line + 1]]
            line = line[~blank[line - 1] & ~blank[line + 1]]
        space = np.flatnonzero(buf == SPACE)
        # words by start; the empty one after a last space comes before the next segment
        start = np.concatenate((lo * 2 + 1, space * 2 + 2, line * 2 + 2))
        how = np.concatenate((np.full(len(lo), START), np.full(len(space), SPACED), np.full(len(line), BARE))).astype(np.int8)
        order = np.argsort(start, kind="stable")
        rank, how = start[order], how[order]
        start = rank >> 1
        stop = np.sort(np.concatenate((hi, space, line)))
        real = (how != START) | (stop > start)
        rank, start, stop, how = rank[real], start[real], stop[real], how[real]
        # one mark after a letter
        long = stop - start > 1
        tail = np.where(long, stop - 1, 0)
        mark = np.where(long & _MARK[buf[tail]], buf[tail], 0)
        at = np.flatnonzero(mark)
        before = buf[stop[at] - 2]
        wide = (stop[at] - start[at] > 2) & (buf[np.maximum(stop[at] - 3, 0)] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
        mark[at[~(_LETTER[before] | wide)]] = 0
        stop = stop - (mark > 0)
        keys = []
        for power, inverse in self.powers:
            sums = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=sums[1:])
            h = (sums[stop] - sums[start]) * inverse[start]
            keys.append((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (how == SPACED).astype(np.uint64))
        uniq, first, number = np.unique(keys[0], return_index=True, return_inverse=True)
        check = keys[1][first]
        if (check[number] != keys[1]).any():
            return None
        slot = np.searchsorted(self.hash, uniq)
        slot_in = np.minimum(slot, max(0, len(self.hash) - 1))
        have = self.hash[slot_in] == uniq if len(self.hash) else np.zeros(len(uniq), bool)
        if (self.check[slot_in[have]] != check[have]).any():
            return None
        self.clock += 1
        self.seen[slot_in[have]] = self.clock
        new = np.flatnonzero(~have)
        if len(new):
            k = first[new]
            self._learn(buf, blank, start[k], stop[k], how[k] == SPACED, uniq[new], check[new], slot[new])
            slot = np.searchsorted(self.hash, uniq)
        size, off = self.size[slot][number], self.off[slot][number]
        broken, marked = how == BARE, mark > 0
        total = size + broken + marked
        pos = np.concatenate(([0], np.cumsum(total)))
        out = np.empty(pos[-1], self.dtype)
        out[pos[:-1][broken]] = self.line
        out[pos[1:][marked] - 1] = self.marks[mark[marked]]
        begin = pos[:-1] + broken
        run = np.concatenate(([0], np.cumsum(size)))
        step = np.arange(run[-1])
        out[np.repeat(begin - run[:-1], size) + step] = self.ids[np.repeat(off - run[:-1], size) + step]
        cuts = np.concatenate((pos[np.searchsorted(rank, lo * 2 + 1)], pos[-1:]))
        if len(self.hash) > self.entries:
            self._forget()
        return out, cuts

    def _learn(self, buf: np.ndarray, blank: np.ndarray, start: np.ndarray, stop: np.ndarray, spaced: np.ndarray, key: np.ndarray, check: np.ndarray, slot: np.ndarray) -> None:
        """Encodes words and puts them into the table. Those with white space or '<' (special tokens) are encoded alone."""
        odd = np.concatenate(([0], np.cumsum(_ODD[buf] | (blank & (buf != SPACE)))))
        alone = (odd[stop] > odd[start]) | (stop == start)
        ids: list[np.ndarray] = []
        number: list[np.ndarray] = []
        for lead in (True, False):
            own = np.flatnonzero(~alone & (spaced == lead))
            if not len(own):
                continue
            n = stop[own] - start[own]
            each = n + 1 + lead
            pos = np.concatenate(([0], np.cumsum(each)))
            text = np.full(pos[-1], BREAK, np.uint8)
            if lead:
                text[pos[:-1]] = SPACE
            run = np.concatenate(([0], np.cumsum(n)))
            step = np.arange(run[-1])
            text[np.repeat(pos[:-1] + lead - run[:-1], n) + step] = buf[np.repeat(start[own] - run[:-1], n) + step]
            got = self._whole([text.tobytes().decode()])[0]
            ends = np.flatnonzero(got == self.line)
            if len(ends) != len(own):
                alone[own] = True
                continue
            ids.append(got[got != self.line])
            number.append(np.stack((own, np.diff(ends, prepend=-1) - 1)))
        own = np.flatnonzero(alone)
        if len(own):
            words = [(" " if spaced[k] else "") + buf[start[k] : stop[k]].tobytes().decode() for k in own.tolist()]
            found = self._whole(words)
            ids += found
            number.append(np.stack((own, np.array([len(x) for x in found]))))
        flat = np.concatenate(ids) if ids else np.zeros(0, self.dtype)
        at = np.concatenate(number, axis=1)
        size, off = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
        size[at[0]] = at[1]
        off[at[0]] = self.used + np.cumsum(at[1]) - at[1]
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], np.empty(self.used + len(flat), self.dtype)))
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.hash, self.check = np.insert(self.hash, slot, key), np.insert(self.check, slot, check)
        self.off, self.size = np.insert(self.off, slot, off), np.insert(self.size, slot, size)
        self.seen = np.insert(self.seen, slot, self.clock)

    def _forget(self) -> None:
        """Keeps the half of the words that was seen last."""
        keep = self.seen > np.partition(self.seen, len(self.seen) // 2)[len(self.seen) // 2]
        self.hash, self.check, self.size, self.seen = self.hash[keep], self.check[keep], self.size[keep], self.seen[keep]
        run = np.concatenate(([0], np.cumsum(self.size)))
        flat = self.ids[np.repeat(self.off[keep] - run[:-1], self.size) + np.arange(run[-1])]
        self.off, self.used = run[:-1].copy(), len(flat)
        self.ids = np.concatenate((flat, np.empty(1 << 16, self.dtype)))


def encoder(path: str, specials_as_text: bool = False, entries: int = ENTRIES, batch: int = BATCH) -> PieceEncoder:
    """The worker's own encoder for a file, opened once."""
    key = (path, specials_as_text, entries, batch)
    if key not in _OPEN:
        _OPEN[key] = PieceEncoder(path, specials_as_text, entries, batch)
    return _OPEN[key]


def release() -> None:
    """Closes the worker's encoders and gives their memory back to the system; the next task that encodes opens them anew."""
    if _OPEN:
        _OPEN.clear()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps what is freed
            trim(0)
