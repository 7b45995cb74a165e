"""Whole-text token ids from the tokenizers library, with a table of pieces that were encoded before.

The tokenizer splits a text at white space, which it drops, and between runs of letters, single digits and runs of other
signs; it encodes each piece for itself. So texts are cut into such pieces with numpy, and only pieces that are new to the
worker go to the library. Cuts are made where they are plainly those of the tokenizer (ASCII and the Latin-1 letters); a
white-space separated chunk with anything else in it is one piece, which the library cuts itself. `check` refuses a
tokenizer for which this does not hold. Pieces are known by 64-bit hashes.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pandas as pd

#: Pieces that a worker keeps (about 30 bytes each); beyond it, new pieces are encoded again in each block.
TABLE_PIECES = 2_000_000
#: Bytes of text that are cut at a time.
BLOCK_BYTES = 1 << 20

SPACE, LETTER, DIGIT, SIGN, TRAIL, ODD = range(6)
MULTIPLIER = 0xD6E8FEB86659FD93
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


def _classes() -> np.ndarray:
    kind = np.full(256, ODD, np.uint8)
    kind[0x21:0x7F] = SIGN
    kind[list(b"\t\n\x0b\x0c\r ")] = SPACE
    kind[0x30:0x3A] = DIGIT
    kind[0x41:0x5B] = kind[0x61:0x7B] = LETTER
    kind[0xC3] = LETTER  # with the byte after it: Latin-1 letters, but for the two signs in `_cuts`
    kind[0x80:0xC0] = TRAIL
    kind[list(b"'<")] = ODD  # contractions and special tokens are the library's business
    return kind


KIND = _classes()


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class WordTokens:
    def __init__(self, path: str, table_pieces: int = TABLE_PIECES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path) as f:
            stated = json.load(f)
        self.check(stated)
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        top = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2" if top <= 1 << 16 else "<u4")
        suffix = stated["model"]["end_of_word_suffix"]
        self.ends = np.zeros(top, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self.table_pieces = table_pieces
        self.keys = np.empty(0, np.uint64)  # ascending
        self.where = np.empty(0, np.int64)  # of the key's ids in the pool
        self.length = np.empty(0, np.int32)
        self.pool = np.empty(1 << 16, self.dtype)
        self.used = 0
        self._grow_powers(BLOCK_BYTES)

    @staticmethod
    def check(stated: dict) -> None:
        """Raises unless the tokenizer cuts texts as this module does."""
        steps = (stated["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        split = steps[0]
        cuts = split.get("pattern", {}).get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in stated["added_tokens"])
        dropped = split.get("behavior") == "Removed" and split.get("invert") and [x["type"] for x in steps] == ["Split", "ByteLevel"]
        lower = [x["type"] for x in (stated["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        if not (cuts and plain and dropped and lower and stated["model"].get("end_of_word_suffix")):
            raise ValueError("this tokenizer may cut texts in other places than this module does")

    def _grow_powers(self, n: int) -> None:
        self.up, self.down = powers(MULTIPLIER, n), powers(INVERSE, n)

    def _each(self, pieces: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(x.ids, self.dtype) for x in found]

    def _learn(self, keys: np.ndarray, pieces: list[bytes], letters: np.ndarray) -> None:
        """Encodes new pieces and puts them into the table. Words of letters go in one call: each ends with an end-of-word id."""
        if len(self.keys) + len(keys) > self.table_pieces:
            self.keys, self.where, self.length, self.used = self.keys[:0], self.where[:0], self.length[:0], 0
        order = np.argsort(~letters, kind="stable")
        n = int(letters.sum())
        words = [pieces[i].decode("utf-8", "replace") for i in order[:n]]
        rest = self._each([pieces[i].decode("utf-8", "replace") for i in order[n:]])
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != n or (n and ends[-1] != len(ids)):
            each = self._each(words)
            ids, ends = np.concatenate([*each, ids[:0]]), np.cumsum([len(x) for x in each])
        length = np.concatenate([np.diff(ends, prepend=0), [len(x) for x in rest]]).astype(np.int32)
        ids = np.concatenate([ids, *rest])
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(self.used + 2 * len(ids), self.dtype)])
        self.pool[self.used : self.used + len(ids)] = ids
        where = self.used + np.cumsum(length, dtype=np.int64) - length
        self.used += len(ids)
        keys = keys[order]
        by_key = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[by_key])
        self.keys = np.insert(self.keys, at, keys[by_key])
        self.where = np.insert(self.where, at, where[by_key])
        self.length = np.insert(self.length, at, length[by_key])

    def _cuts(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes with plain letters lowered; starts and ends of pieces; whether a piece is letters only."""
        kind = KIND[raw]
        inside = np.flatnonzero(kind == TRAIL)
        if len(inside):
            if inside[0] == 0:
                inside = inside[1:]
            lead, second = raw[inside - 1], raw[inside]
            latin = (lead == 0xC3) & (second != 0x97) & (second != 0xB7)
            kind[inside] = np.where(latin, LETTER, ODD)
            kind[inside[~latin] - 1] = ODD
        new = np.zeros(len(raw), bool)
        new[starts[starts < len(raw)]] = True
        space = kind == SPACE
        chunk = new | space
        chunk[1:] |= space[:-1]  # a space is a chunk of its own, and drops out below
        at = np.flatnonzero(chunk)
        odd_at = np.flatnonzero(kind == ODD)
        plain = np.ones(len(at), bool)
        plain[np.searchsorted(at, odd_at, "right") - 1] = False
        turn = np.empty(len(raw), bool)
        turn[:1] = True
        turn[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        bytes_ = raw.copy()
        upper = (raw >= 0x41) & (raw <= 0x5A)
        if plain.all():
            cut = turn | chunk
        else:
            spread = np.repeat(plain, np.diff(at, append=len(raw)))
            cut, upper = (turn & spread) | chunk, upper & spread
        bytes_[upper] |= 0x20
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(raw))
        keep = ~space[begin]
        begin, end = begin[keep], end[keep]
        owner = np.searchsorted(at, begin, "right") - 1
        return bytes_, begin, end, (kind[begin] == LETTER) & plain[owner]

    def _block(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a block, and of each piece its start and its number of ids."""
        if len(raw) + 1 > len(self.up):
            self._grow_powers(len(raw) + 1)
        data, begin, end, letters = self._cuts(raw, starts)
        total = np.empty(len(raw) + 1, np.uint64)
        total[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=total[1:])
        keys = (total[end] - total[begin]) * self.down[begin]
        codes, unique = pd.factorize(keys)
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == unique[inside]
        if not known.all():
            first = np.full(len(unique), -1, np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            new, text = first[~known], data.tobytes()
            before = len(self.keys)
            self._learn(unique[~known], [text[a:b] for a, b in zip(begin[new].tolist(), end[new].tolist())], letters[new])
            if len(self.keys) < before + len(new):  # the table began anew
                return self._block(raw, starts)
            at = np.searchsorted(self.keys, unique)
        where, length = self.where[at][codes], self.length[at][codes].astype(np.int64)
        stop = np.cumsum(length)
        n = int(stop[-1]) if len(stop) else 0
        source = np.arange(n, dtype=np.int64) + np.repeat(where - (stop - length), length)
        return self.pool[source], begin, length

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """data: UTF-8 bytes; bounds: where texts start, and the end. Returns all ids and where each text's ids start."""
        ids, text_ids = [np.empty(0, self.dtype)], np.zeros(len(bounds), np.int64)
        at, top = int(bounds[0]), int(bounds[-1])
        while at < top:
            end = self._cut_at(data, bounds, at, top)
            first, last = np.searchsorted(bounds, [at, end])
            found, begin, length = self._block(data[at:end], bounds[first:last] - at)
            ids.append(found)
            owner = np.searchsorted(bounds, begin + at, "right")
            text_ids += np.bincount(owner, length, len(bounds))[: len(bounds)].astype(np.int64)
            at = end
        return np.concatenate(ids), np.cumsum(text_ids)

    def _cut_at(self, data: np.ndarray, bounds: np.ndarray, at: int, top: int) -> int:
        """The end of a block: the start of a text, or white space inside a text that is longer than a block."""
        end = at + BLOCK_BYTES
        if end >= top:
            return top
        start = int(bounds[np.searchsorted(bounds, end, "right") - 1])
        if start > at:
            return start
        after = int(bounds[np.searchsorted(bounds, at, "right")])
        for a in range(end, after, BLOCK_BYTES):
            found = np.flatnonzero(KIND[data[a : min(a + BLOCK_BYTES, after)]] == SPACE)
            if len(found):
                return a + int(found[0])
        return after


_LOADED: dict[str, WordTokens] = {}


def loaded(path: str) -> WordTokens:
    """One per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]
