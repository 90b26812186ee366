"""Token ids of whole texts by the tokenizers library, each distinct pre-token encoded once.

Byte-level BPE never merges across the pre-tokens that its pattern cuts.  The cuts are found with
numpy over code points, whose classes are asked of the library's own pre-tokenizer; a table keeps the
ids of pre-tokens that were seen.  Texts with code points beyond the table of classes, and texts that hold a
token which the vocabulary adds (as ``<|endoftext|>``), go through the library whole.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

LETTER, NUMBER, OTHER, SPACE = range(4)
#: Code points from here on are left to the library.
LIMIT = 0x3000
WIDE = 24
SLOT_BITS = 20
#: The table of seen pre-tokens is emptied at this many.
MOST = 500_000
CHUNK_CHARS = 1_000_000
_ONE, _TWO = "stmd", ("re", "ve", "ll")


class Encoder:
    """``encode(texts)``: ids of all texts in a row, and how many each text has."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values() if x.content]
        self.plain = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel"
        if self.plain:
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.classes = np.array([next((k for k, x in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(cut(x + c)) == 1), SPACE) for c in map(chr, range(LIMIT))], np.uint8)
        self._empty()

    def _empty(self) -> None:
        size = 1 << SLOT_BITS
        self.slots = np.full(size, -1, np.int32)
        self.keys = np.zeros((1 << 16, 3), np.uint64)
        self.lens = np.zeros(1 << 16, np.int64)
        self.starts = np.zeros(1 << 16, np.int64)
        self.counts = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.known = self.used = 0
        self.long: dict[bytes, int] = {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts, at = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to]) <= CHUNK_CHARS):
                chars += len(texts[to])
                to += 1
            some = texts[at:to]
            if self.plain and all((x.isascii() or max(x) < chr(LIMIT)) and not any(t in x for t in self.added) for x in some):
                i, c = self._chunk(some)
            elif len(some) > 1:
                parts = [self.encode([x]) for x in some]
                i, c = (np.concatenate(x) for x in zip(*parts, strict=True))
            else:
                i = np.array(self.tokenizer.encode(some[0], add_special_tokens=False).ids, np.uint32)
                c = np.array([len(i)])
            ids.append(i)
            counts.append(c)
            at = to
        return np.concatenate(ids), np.concatenate(counts)

    def _cuts(self, cp: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Flags of the code points at which a pre-token starts; ``first`` flags the first of each text."""
        kind = self.classes[cp]
        run = first.copy()
        run[1:] |= kind[1:] != kind[:-1]
        start = run.copy()
        after = np.flatnonzero(run[1:] & ~first[1:] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
        start[after - 1] = True  # the last space of a run goes with what follows, if it is a blank
        start[after] = cp[after - 1] != 0x20
        mark = np.flatnonzero(start[:-1] & (cp[:-1] == 0x27) & run[1:] & ~first[1:] & (kind[1:] == LETTER)) + 1
        for i in mark.tolist():  # contractions
            text = "".join(map(chr, cp[i : i + 2].tolist()))
            n = 1 if text[0] in _ONE else 2 if text in _TWO and not first[i + 1] else 0
            if n:
                start[i] = False
                if i + n < len(start):
                    start[i + n] = True
        return start

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = "".join(texts)
        chars = np.fromiter(map(len, texts), np.int64, len(texts))
        if not whole:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        text_start = np.cumsum(chars) - chars
        first = np.zeros(len(cp), bool)
        first[text_start[chars > 0]] = True
        at = np.flatnonzero(self._cuts(cp, first))
        raw = whole.encode()
        if len(raw) == len(cp):
            begin = at
        else:
            width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800)
            begin = (np.cumsum(width) - width)[at]
        token = self._look(raw, begin, np.diff(begin, append=len(raw)))
        n = self.counts[token]
        ids = self.ids[np.repeat(self.starts[token] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        before = np.concatenate([[0], np.cumsum(n)])
        return ids, np.diff(before[np.searchsorted(at, np.append(text_start, len(cp)))])

    def _look(self, raw: bytes, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Entry numbers of the pre-tokens at ``begin``; unknown ones are encoded and kept."""
        if self.known > MOST:
            self._empty()
        padded = np.frombuffer(raw + bytes(WIDE), np.uint8)
        words = np.ndarray((len(raw) + WIDE - 7,), "<u8", padded, strides=(1,))
        masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        key = np.stack([words[begin + 8 * k if k == 0 else np.minimum(begin + 8 * k, len(words) - 1)] & masks[np.clip(size - 8 * k, 0, 8)] for k in range(3)], axis=1)
        mixed = (key[:, 0] * np.uint64(0x9E3779B97F4A7C15)) ^ (key[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (key[:, 2] * np.uint64(0x165667B19E3779F9))
        mixed ^= mixed >> np.uint64(29)
        slot = ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out = np.full(len(begin), -1, np.int64)
        short = size <= WIDE
        self._probe(key, size, slot, out, np.flatnonzero(short))
        if (miss := np.flatnonzero((out < 0) & short)).size:
            order = miss[np.lexsort((size[miss], *key[miss].T))]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (key[order[1:]] != key[order[:-1]]).any(axis=1) | (size[order[1:]] != size[order[:-1]])
            new = order[fresh]
            entry = self._add([raw[b : b + s] for b, s in zip(begin[new].tolist(), size[new].tolist(), strict=True)])
            self.keys[entry], self.lens[entry] = key[new], size[new]
            self._insert(slot[new], entry)
            out[order] = entry[np.cumsum(fresh) - 1]
        far = np.flatnonzero(~short)
        if far.size:
            pieces = [raw[b : b + s] for b, s in zip(begin[far].tolist(), size[far].tolist(), strict=True)]
            new = [x for x in dict.fromkeys(pieces) if x not in self.long]
            self.long.update(zip(new, self._add(new).tolist(), strict=True))
            out[far] = [self.long[x] for x in pieces]
            if len(self.long) > 50_000:
                self.long = {}
        return out

    def _probe(self, key: np.ndarray, size: np.ndarray, slot: np.ndarray, out: np.ndarray, todo: np.ndarray) -> None:
        step = 0
        while todo.size:
            entry = self.slots[slot[todo] + step & (1 << SLOT_BITS) - 1]
            same = (entry >= 0) & (self.lens[entry] == size[todo])
            for k in range(3):
                same &= self.keys[entry, k] == key[todo, k]
            out[todo[same]] = entry[same]
            todo = todo[~same & (entry >= 0)]
            step += 1

    def _insert(self, slot: np.ndarray, entry: np.ndarray) -> None:
        while len(slot):
            free = self.slots[slot] < 0
            won = np.zeros(len(slot), bool)
            won[np.unique(np.where(free, slot, -1), return_index=True)[1]] = True
            won &= free
            self.slots[slot[won]] = entry[won]
            slot, entry = (slot[~won] + 1) & (1 << SLOT_BITS) - 1, entry[~won]
            # a loser tries the slot again only if it was taken just now, which the next round sees as not free

    def _add(self, pieces: list[bytes]) -> np.ndarray:
        """Encode distinct pre-tokens; their entry numbers."""
        texts = [x.decode() for x in pieces]
        flat, counts = [], np.zeros(len(texts), np.int64)
        blank = np.array([x.isspace() or "\n" in x or len(x) > 200 for x in texts], bool)
        encode = self.tokenizer.encode
        where = np.flatnonzero(~blank)
        for at in range(0, len(where), 4000):
            some = where[at : at + 4000]
            e = encode("\n".join([texts[k] for k in some]), add_special_tokens=False)
            word = np.array(e.word_ids, np.int64)
            own = word % 2 == 0  # those between are the line breaks
            flat.append(np.array(e.ids, np.uint32)[own])
            counts[some] = np.bincount(word[own] // 2, minlength=len(some))
        for k in np.flatnonzero(blank):
            flat.append(np.array(encode(texts[k], add_special_tokens=False).ids, np.uint32))
            counts[k] = len(flat[-1])
        order = np.concatenate([where, np.flatnonzero(blank)])
        ids = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        n = self.known + len(texts)
        while n > len(self.counts):
            self.keys, self.lens, self.starts, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.keys, self.lens, self.starts, self.counts))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        entry = np.arange(self.known, n)
        self.ids[self.used : self.used + len(ids)] = ids
        self.counts[entry] = counts
        self.starts[entry[order]] = self.used + np.cumsum(counts[order]) - counts[order]
        self.known, self.used = n, self.used + len(ids)
        return entry


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)
