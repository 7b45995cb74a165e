"""Repeated passages by a depth-limited radix sort of suffixes.

A byte is repeated if a string of `length` bytes that covers it starts anywhere else too, in another text or the same. The
suffixes of all texts are put into groups, most significant digit first, no deeper than `length`: suffixes that are alone
in their group drop out after each digit, and groups that reach the depth are exactly the repeated windows.

The first digit is chosen so that few rows cross the network. Of the 32-byte strings in a window, the one with the
smallest hash is its anchor; equal windows have equal anchors at equal places. Neighbouring windows share their anchor, so
a text is a sequence of runs of windows, one for each anchor, at about every 140th byte. Runs are grouped by anchor:

- An anchor that occurs once ends the matter for all windows of its run.
- If all runs of an anchor have equal bytes, all their windows are repeated.
- Else one run of each kind is enough, since equal runs have equal windows, and runs of a kind that occurs twice are
  repeated as they are. The bytes of these runs are fetched and their suffixes sorted by the digits that follow.
- An anchor with very many kinds of runs is not collected: its windows are counted by a hash of all their bytes instead.

A line that is said over and over makes many equal runs of one text. They are repeated as they are, which needs no other
text, and go through the groupings as one row that counts for all of them.

With `words`, passages of that many words are repeated too, however short the words are. Those that have `length` bytes are
found as above; the few windows of so many words in fewer bytes are counted by the hash of their bytes.

With `passages`, those windows of words in fewer bytes are found by runs as well, which is for a `length` under which most of
them fall: the anchor is then the string of `GRAM` words with the smallest hash. Runs of both sorts go through the same
groupings; stretches found by words are marked `short`, and overlapping occurrences count.

Every grouping that a hot passage can dominate is a count that is combined before it is shuffled, or a join with one row
for each key on the other side, in which the rows of heavy keys stay where they are (`lookup`). Texts cross the network compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenledger.llm.common import packed, strings, table, written
from tokenledger.llm.lookup import lookup

LENGTH = 400
ANCHOR = 32
#: Words of a passage that `op1_suffix_array_dedup` takes out of its text, even in fewer bytes.
PASSAGE = 51
#: Words of an anchor in windows of words, and what tells it from an anchor of bytes.
GRAM = 8
SALT = np.uint64(0xA0761D6478BD642F)
#: Bytes of a digit after the first.
DIGIT = 40
#: Windows of a text that are looked at at a time.
CHUNK = 1 << 17
#: Kinds of runs of one anchor that are sorted in one task, six megabytes of text at most; anchors with more are counted
#: window by window.
KINDS = 8192

MULTIPLIER = 0xD6E8FEB86659FD93
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
KEY = ["__id", "__mark"]


class Hashes:
    """64-bit hashes of any stretch of some bytes, from prefix sums.

    With `place`, the place of each byte in its own text (and one more entry), many texts share small tables of powers.
    """

    _up = _down = np.ones(1, np.uint64)

    def __init__(self, raw: np.ndarray, place: np.ndarray | None = None) -> None:
        top = len(raw) + 1 if place is None else int(place.max()) + 1
        if top > len(Hashes._up):
            Hashes._up, Hashes._down = _powers(MULTIPLIER, 2 * top), _powers(INVERSE, 2 * top)
        self.place = place
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        terms = raw.astype(np.uint64)
        terms += np.uint64(1)
        terms *= Hashes._up[: len(raw)] if place is None else Hashes._up[place[:-1]]
        np.cumsum(terms, out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * Hashes._down[start if self.place is None else self.place[start]])

    def all(self, n: int) -> np.ndarray:
        """Of every stretch of n bytes of one text."""
        return mixed((self.sums[n:] - self.sums[:-n]) * Hashes._down[: len(self.sums) - n])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def window_min(values: np.ndarray, n: int) -> np.ndarray:
    width = 1
    while 2 * width <= n:
        values, width = np.minimum(values[:-width], values[width:]), 2 * width
    rest = n - width
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def runs(raw: np.ndarray, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first window, last window, anchor, hash of the run's bytes) of a text's runs, chunk by chunk."""
    anchor = min(ANCHOR, length)
    for at in range(0, len(raw) - length + 1, CHUNK):
        part = raw[at : at + CHUNK + length - 1]
        hashes = Hashes(part)
        grams = hashes.all(anchor)
        ranked = grams & np.uint64(0xFFFFFFFF00000000) | np.arange(len(grams), dtype=np.uint64)
        least = window_min(ranked, length - anchor + 1)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.append(first[1:], len(least)) - 1
        place = (least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        yield first + at, last + at, grams[place], hashes(first, last + length)


def repeated_windows(kinds: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each run of windows the places of those that occur again, in it or another run; digit by digit."""
    size = np.array([len(k) for k in kinds])
    base = np.cumsum(size) - size
    place = np.arange(size.sum() + 1, dtype=np.int32) - np.append(np.repeat(base, size), size.sum()).astype(np.int32)
    hashes = Hashes(np.frombuffer(b"".join(kinds), np.uint8), place)
    n = size - length + 1
    owner = np.repeat(np.arange(len(kinds), dtype=np.int32), n)
    start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - base, n)).astype(np.int32)
    group = np.zeros(len(start), np.int32)
    for depth in range(0, length, DIGIT):
        digit = hashes(start + np.int32(depth), start + np.int32(min(length, depth + DIGIT)))
        group = pd.factorize(mixed(digit + group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))[0].astype(np.int32)
        keep = np.bincount(group, minlength=1)[group] > 1
        owner, start, group = owner[keep], start[keep], group[keep]
        if not len(start):
            break
    bounds = np.searchsorted(owner, np.arange(len(kinds) + 1))
    return [start[a:b].astype(np.int64) - base[i] for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))]


WORD = np.array([chr(i).isalnum() if i < 0x80 else True for i in range(256)])
SPACE = np.array([i in b" \t\n\v\f\r" for i in range(256)])


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end. They stand between ASCII white space and hold a letter or digit; each begins and ends with one."""
    sign = np.flatnonzero(WORD[raw])
    if not len(sign):
        return sign, sign
    gaps = np.cumsum(SPACE[raw], dtype=np.int32)[sign]  # equal within a word
    new = np.flatnonzero(gaps[1:] != gaps[:-1]) + 1
    return sign[np.append(0, new)], sign[np.append(new - 1, len(sign) - 1)] + 1


def word_windows(raw: np.ndarray, words: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the windows of `words` words that have fewer than `length` bytes. A window begins and ends with a letter
    or digit, so that quotes and full stops around a passage do not hide it."""
    first, last = _words(raw)
    n = max(0, len(first) - words + 1)
    start, end = first[:n], last[words - 1 :]
    short = end - start < length
    return start[short], end[short]


def word_runs(raw: np.ndarray, words: int, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Like `runs`, for the windows of `word_windows`; what is given as the last window is `length` bytes before the run's end."""
    first, last = _words(raw)
    if len(first) < words:
        return
    gram, window = min(GRAM, words), np.flatnonzero(last[words - 1 :] - first[: len(first) - words + 1] < length)
    edges = np.searchsorted(first[window], np.arange(0, len(raw) + CHUNK, CHUNK))
    for at, x, y in zip(range(0, len(raw), CHUNK), edges[:-1], edges[1:]):
        if x == y:
            continue
        own, hashes = window[x:y], Hashes(part := raw[at : at + CHUNK + length])
        begin = np.arange(own[0], own[-1] + words - gram + 1)
        # Only in windows that are not looked at may a string of words pass the end of the part.
        grams = hashes(first[begin] - at, np.minimum(last[begin + gram - 1] - at, len(part)))
        ranked = grams & np.uint64(0xFFFFFFFF00000000) | np.arange(len(grams), dtype=np.uint64)
        least = window_min(ranked, words - gram + 1)[own - own[0]]
        new = np.flatnonzero((least[1:] != least[:-1]) | (own[1:] != own[:-1] + 1)) + 1
        start, end = first[own[np.append(0, new)]], last[own[np.append(new - 1, len(own) - 1)] + words - 1]
        place = (least[np.append(0, new)] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        yield start, end - length, grams[place] ^ SALT, hashes(start - at, end - at)


def repeated_word_windows(
    kinds: list[bytes], anchor: np.ndarray, words: int, length: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each run of windows of words where those begin and end that occur again, in it or another run with that anchor."""
    size = np.array([len(k) + 1 for k in kinds])
    base = np.cumsum(size) - size
    raw = np.frombuffer(b"\n".join(kinds), np.uint8)
    start, end = word_windows(raw, words, length)
    owner = np.searchsorted(base, start, "right") - 1
    inside = end < (base + size)[owner]
    start, end, owner = start[inside], end[inside], owner[inside]
    place = (np.arange(size.sum()) - np.repeat(base, size)).astype(np.int32)
    salt = mixed(anchor.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    group = pd.factorize(mixed(Hashes(raw, place)(start, end) + salt[owner]))[0]
    again = np.bincount(group, minlength=1)[group] > 1
    start, end, owner = start[again], end[again], owner[again]
    bounds = np.searchsorted(owner, np.arange(len(kinds) + 1))
    return [(start[a:b] - base[i], end[a:b] - base[i]) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))]


def stretches(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open stretches as ascending stretches that do not touch."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.concatenate([[True], starts[1:] > ends[:-1]]) if len(starts) else np.zeros(0, bool)
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)] if len(starts) else ends


def _key(docs: DataFrame) -> tuple[list[Column], bool]:
    """Columns by which rows are known, and whether several rows may have one key. Rows that are equal have equal keys and
    fare alike; the mark is only filled where doc_ids do not tell rows apart."""
    kind = docs.schema["doc_id"].dataType
    whole = isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)) if whole else F.xxhash64("doc_id")
    unclear = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    clear = whole and unclear.isEmpty()
    mark = F.lit(0) if clear else F.xxhash64(F.col("doc_id").isNull(), F.col("text").cast("string"))
    return [own.cast("long").alias(KEY[0]), mark.cast("long").alias(KEY[1])], not clear


def one_of_equals(
    owner: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, kind: np.ndarray, length: int
) -> tuple[np.ndarray, ...]:
    """Of runs in the order of their texts: where the first of equal runs of a text stands and how many they are; then, for
    each stretch of those that are several, where a run of it stands, its start and its end."""
    order = np.lexsort((anchor, kind))
    differ = np.zeros(max(0, len(order) - 1), bool)
    for own in (owner[order], anchor[order], kind[order]):
        differ |= own[1:] != own[:-1]
    head = np.flatnonzero(np.append(True, differ)[: len(order)])
    times = np.diff(np.append(head, len(order)))
    several = np.flatnonzero(times > 1)
    at, group = order[np.repeat(times > 1, times)], np.repeat(several, times[several])
    start, end = first[at], last[at] + length
    new = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (start[1:] > end[:-1]))[: len(at)])
    in_order = np.argsort(order[head])
    high = np.maximum.reduceat(end, new) if len(new) else end
    return order[head][in_order], times[in_order], at[new], start[new], high


def _anchors(texts: DataFrame, length: int, passages: int | None) -> DataFrame:
    """The runs of the texts, equal ones of a text as one row with their number, `times`. Rows without an anchor are stretches
    of runs that a text has several times."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = strings(batch.column(2))
            rows, short, columns = [], [], [[], [], [], []]
            for row, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                by_words = word_runs(data[a:b], passages, length) if passages else ()
                for few, every in ((False, runs(data[a:b], length)), (True, by_words)):
                    for found in every:
                        rows.append(np.full(len(found[0]), row))
                        short.append(np.full(len(found[0]), few))
                        for own, more in zip(columns, found):
                            own.append(more)
            if rows:
                owner = np.concatenate(rows)
                first, last, anchor, kind = (np.concatenate(c).astype(np.int64) for c in columns)
                one, times, again, start, end = one_of_equals(owner, first, last, anchor, kind, length)
                rows, known = np.append(one, again), np.arange(len(one) + len(again)) >= len(one)
                keys = [batch.column(i).take(pa.array(owner[rows])) for i in (0, 1)]
                first, last = np.append(first[one], start), np.append(last[one], end - length)
                times = np.append(times, np.zeros_like(again))
                more = [pa.array(first), pa.array(last), pa.array(anchor[rows], mask=known), pa.array(kind[rows]), pa.array(times)]
                yield pa.RecordBatch.from_arrays([*keys, *more, pa.array(np.concatenate(short)[rows])], names=[*names, "short"])

    names = [*KEY, "first", "last", "anchor", "kind", "times"]
    return texts.mapInArrow(find, ", ".join(f"{n} long" for n in names) + ", short boolean")


def _kind_bytes(texts: DataFrame, kinds: DataFrame, length: int, repeated: bool) -> DataFrame:
    """The bytes of one run of each kind: the key, first, anchor, alone, short, bytes; also where `repeated` keys have many rows."""
    wanted = kinds.groupBy(*KEY).agg(F.collect_list(F.struct("first", "last", "anchor", "alone", "short")).alias("runs"))
    names = [*KEY, "first", "anchor", "alone", "short", "bytes"]

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            lists = batch.column("runs")
            owner, inner = pc.list_parent_indices(lists), lists.flatten()
            first, last = inner.field("first").to_numpy(), inner.field("last").to_numpy()
            raw, out, seen = b"", [], -1
            texts_ = batch.column("text")
            for row, a, b in zip(owner.to_pylist(), first.tolist(), last.tolist()):
                if row != seen:
                    raw, seen = press.decompress(texts_[row].as_py()), row
                out.append(raw[a : b + length])
            columns = [batch.column(n).take(owner) for n in KEY] + [inner.field(n) for n in ("first", "anchor", "alone", "short")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary())], names=names)

    joined = packed(texts).join(wanted.hint("merge"), KEY)
    found = joined.mapInArrow(fetch, "__id long, __mark long, first long, anchor long, alone boolean, short boolean, bytes binary")
    return found.dropDuplicates([*KEY, "first", "anchor"]) if repeated else found


SPANS = "__id long, __mark long, start long, end long, short boolean"


def _sorted_groups(groups: DataFrame, length: int, passages: int | None = None) -> DataFrame:
    """Stretches of repeated windows in runs that stand alone; groups: a list of runs for each anchor."""

    def sort(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [r.values for r in batch.column("runs")]
            by_words = [r for r in lists if r.field("short")[0].as_py()]  # an anchor of words has no runs of bytes
            for own in lists:
                if not own.field("short")[0].as_py():
                    yield from spans(own, [(w, w + length) for w in repeated_windows(own.field("bytes").to_pylist(), length)], False)
            if by_words:
                own, anchor = pa.concat_arrays(by_words), np.repeat(np.arange(len(by_words)), [len(r) for r in by_words])
                yield from spans(own, repeated_word_windows(own.field("bytes").to_pylist(), anchor, passages, length), True)

    def spans(own: pa.StructArray, found: list[tuple[np.ndarray, np.ndarray]], short: bool) -> Iterator[pa.RecordBatch]:
        ids, marks, firsts, alone = (own.field(n).to_pylist() for n in (*KEY, "first", "alone"))
        columns = [[], [], [], []]
        for i, m, f, a, (start, end) in zip(ids, marks, firsts, alone, found):
            if a and len(start):
                start, end = stretches(start + f, end + f)
                for column, more in zip(columns, ([i] * len(start), [m] * len(start), start.tolist(), end.tolist())):
                    column += more
        if columns[0]:
            marked = [pa.array(c, pa.int64()) for c in columns] + [pa.array([short] * len(columns[0]))]
            yield pa.RecordBatch.from_arrays(marked, names=[*KEY, "start", "end", "short"])

    return groups.select("runs").mapInArrow(sort, SPANS)


def _counted_windows(contents: DataFrame, length: int, passages: int | None = None) -> DataFrame:
    """The same for anchors with too many kinds of runs: every window is a row, and rows are counted by their bytes' hash."""

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, anchors, alone, short = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("first", "anchor", "alone", "short"))
            for row, raw in enumerate(np.frombuffer(x, np.uint8) for x in batch.column("bytes").to_pylist()):
                if short[row]:
                    start, end = word_windows(raw, passages, length)
                else:
                    start = np.arange(len(raw) - length + 1)
                    end = start + length
                window, n = Hashes(raw)(start, end).astype(np.int64), len(start)
                keys = [pa.array(np.full(n, batch.column(k)[row].as_py(), np.int64)) for k in KEY]
                columns = [*keys, pa.array(np.full(n, anchors[row])), pa.array(window)]
                columns += [pa.array(firsts[row] + start), pa.array(firsts[row] + end)]
                columns += [pa.array(np.full(n, alone[row])), pa.array(np.full(n, short[row]))]
                yield pa.RecordBatch.from_arrays(columns, names=[*KEY, "anchor", "window", "start", "end", "alone", "short"])

    kinds = "__id long, __mark long, anchor long, window long, start long, end long, alone boolean, short boolean"
    rows = written(contents.mapInArrow(spread, kinds), "windows")
    again = rows.groupBy("anchor", "window").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "window")
    found = rows.where("alone").join(again.hint("merge"), ["anchor", "window"], "left_semi")
    return found.select(*KEY, "start", "end", "short")


def _counted_words(texts: DataFrame, long: DataFrame, words: int, length: int) -> DataFrame:
    """The key, start and end of windows of so many words, in fewer than `length` bytes, that occur again.

    Occurrences that overlap in a text, as in a word said over and over, count as one. Windows inside a stretch that `long`
    has already are counted, but not returned.
    """
    kinds = ("window", "start", "end", "counts")

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = strings(batch.column(2))
            rows, lists = [], {k: [] for k in kinds}
            for row, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                raw = data[a:b]
                start, end = word_windows(raw, words, length)
                if not len(start):
                    continue
                hashes, edges = [], np.searchsorted(start, np.arange(0, len(raw) + CHUNK, CHUNK))
                for at, x, y in zip(range(0, len(raw), CHUNK), edges[:-1], edges[1:]):
                    if x < y:
                        hashes.append(Hashes(raw[at : at + CHUNK + length])(start[x:y] - at, end[x:y] - at).astype(np.int64))
                window, counts = np.concatenate(hashes), np.zeros(len(start), np.int64)
                free: dict[int, int] = {}  # by hash, where its last occurrence that counts ends
                for i, (h, s, e) in enumerate(zip(window.tolist(), start.tolist(), end.tolist())):
                    if free.get(h, 0) <= s:
                        free[h], counts[i] = e, 1
                rows.append(row)
                for k, own in zip(kinds, (window, start, end, counts)):
                    lists[k].append(own)
            if rows:
                offsets = pa.array(np.cumsum([0] + [len(x) for x in lists["window"]]), pa.int32())
                columns = [batch.column(k).take(pa.array(rows)) for k in (0, 1)]
                columns += [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in lists.values()]
                yield pa.RecordBatch.from_arrays(columns, names=[*KEY, *kinds])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([c.flatten() for c in batch.columns], names=["window", "counts"])

    def uncovered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                window, start, end = (batch.column(k)[row].values.to_numpy() for k in ("window", "start", "end"))
                spans = batch.column("spans")[row].values
                if spans is not None:
                    low, high = stretches(*(spans.field(k).to_numpy() for k in ("start", "end")))
                    at = np.searchsorted(low, start, "right") - 1
                    open_ = (at < 0) | (high[at] < end)
                    window, start, end = window[open_], start[open_], end[open_]
                keys = [pa.array(np.full(len(start), batch.column(k)[row].as_py(), np.int64)) for k in KEY]
                yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, (window, start, end))], names=[*KEY, "window", "start", "end"])

    lists = ", ".join(f"{k} array<long>" for k in kinds)
    rows = written(texts.mapInArrow(spread, f"__id long, __mark long, {lists}"), "word-windows")
    sums = rows.select("window", "counts").mapInArrow(count, "window long, counts long").groupBy("window").agg(F.sum("counts").alias("n"))
    again = written(sums.where("n > 1").select("window"), "again")
    covered = long.groupBy(*KEY).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    left = rows.drop("counts").join(covered.hint("merge"), KEY, "left")
    left = written(left.mapInArrow(uncovered, "__id long, __mark long, window long, start long, end long"), "uncovered")
    return left.join(again.hint("merge"), "window", "left_semi").select(*KEY, "start", "end")


def _spans(
    texts: DataFrame, length: int, kinds_in_task: int, repeated: bool, words: int | None = None, passages: int | None = None
) -> DataFrame:
    """The key and a list of repeated stretches (they may overlap) of the rows that have any."""
    rows = written(_anchors(texts, length, passages), "anchors")
    anchors, known = rows.where("anchor IS NOT NULL"), rows.where("anchor IS NULL")
    often = anchors.groupBy("anchor").agg(
        F.count("*").alias("n"), F.sum("times").alias("times"), F.min("kind").alias("low"), F.max("kind").alias("high")
    )
    often = written(often.where("times > 1").drop("times"), "often")
    mixture = often.selectExpr("anchor", "low <> high AS mixed")
    met = written(lookup(anchors, mixture, ["anchor"], counts=often).select(*anchors.columns, "mixed"), "met")
    span = [*KEY, F.col("first").alias("start"), (F.col("last") + length).alias("end"), "short"]
    mixed_ = met.where("mixed")
    one = F.min(F.struct(*KEY, "first", "last", "short")).alias("one")
    open_ = F.count(F.when(F.col("times") == 1, 1)).alias("open")  # rows whose text alone does not tell that they are repeated
    kinds = written(mixed_.groupBy("anchor", "kind").agg(F.sum("times").alias("n"), open_, one), "kinds")
    found = known.select(*span).union(met.where("not mixed and times = 1").select(*span))
    twice = kinds.where("n > 1 and open > 0").select("anchor", "kind", F.col("open").alias("n"))
    found = found.union(lookup(mixed_.where("times = 1"), twice.drop("n"), ["anchor", "kind"], counts=twice).select(*span))
    sample = kinds.select("one.*", "anchor", (F.col("n") == 1).alias("alone"))
    contents = written(_kind_bytes(texts, sample, length, repeated), "runs")
    sizes = written(kinds.groupBy("anchor").agg(F.count("*").alias("n")), "sizes")
    few = contents.join(sizes.where(F.col("n") <= kinds_in_task).select("anchor").hint("merge"), "anchor", "left_semi")
    groups = few.groupBy("anchor").agg(F.collect_list(F.struct(*KEY, "first", "alone", "short", "bytes")).alias("runs"))
    found = found.union(_sorted_groups(groups, length, passages) if passages else _sorted_groups(groups, length))
    many = sizes.where(F.col("n") > kinds_in_task).select("anchor")
    if not many.isEmpty():
        found = found.union(_counted_windows(contents.join(many.hint("merge"), "anchor", "left_semi"), length, passages))
    if words:
        found = written(found, "long")
        found = found.union(_counted_words(texts, found, words, length).withColumn("short", F.lit(True)))
    return found.groupBy(*KEY).agg(F.collect_list(F.struct("start", "end", "short")).alias("__spans"))


def with_repeats(
    docs: DataFrame, length: int = LENGTH, kinds_in_task: int = KINDS, words: int | None = None, passages: int | None = None
) -> DataFrame:
    """The columns of docs with its text compressed (zstd), and `__spans`, stretches of repeated bytes or null.

    Read with `cut` or `cuts`. A null text is an empty one. A text that occurs twice is repeated as a whole if it is long enough;
    equal rows are two occurrences. Texts shorter than `length` have nothing repeated, unless they hold `words` or `passages` words, and an
    empty table gives an empty one. Other columns may have any names that do not begin with two underscores.
    """
    key, repeated = _key(docs)
    texts = docs.select(*key, F.col("text").cast("string").alias("text"))
    spans = _spans(texts, length, kinds_in_task, repeated, words, passages)
    rest = [F.col(c) for c in docs.columns if c != "text"]
    small = packed(docs.select(*key, F.col("text").cast("string").alias("text"), *rest))
    return small.join(spans.hint("merge"), KEY, "left").drop(*KEY)


def cuts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]]:
    """For each row its bytes, starts and ends of the stretches found by bytes, and of those found by bytes or words."""
    press = zstandard.ZstdDecompressor()
    lists = batch.column("__spans")
    inner, offsets = lists.flatten(), np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy()))
    start, end, short = (inner.field(n).to_numpy(zero_copy_only=False) for n in ("start", "end", "short"))
    for row, packed in enumerate(batch.column("text").to_pylist()):
        own = slice(offsets[row], offsets[row + 1])
        every, long = stretches(start[own], end[own]), ~short[own].astype(bool)
        by_bytes = every if long.all() else stretches(start[own][long], end[own][long])
        yield np.frombuffer(press.decompress(packed), np.uint8), by_bytes, every


def cut(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each row its bytes, and starts and ends of the stretches to remove."""
    for raw, _, (start, end) in cuts(batch):
        yield raw, start, end


def kept(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    edges = [0, *np.column_stack([start, end]).ravel().tolist(), len(raw)]
    return b"".join(raw[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2]))


def whole_characters(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches without the code points that they cut: a code point stays if a byte of it does."""
    inside = raw & 0xC0 == 0x80
    start, end = start.copy(), end.copy()
    for _ in range(3):
        start += (start < len(raw)) & inside[np.minimum(start, len(raw) - 1)]
    for _ in range(3):
        end -= (end < len(raw)) & inside[np.minimum(end, len(raw) - 1)]
    full = start < end
    return start[full], end[full]


def without_repeats(docs: DataFrame, length: int = LENGTH, words: int | None = None) -> DataFrame:
    """docs with the repeated passages, of `length` bytes or, if given, of `words` words, taken out of text, whole code points only. A null text stays null, and a text that
    is repeated as a whole is left empty. n_chars, if there, is that of the new text."""
    schema = docs.schema

    def take(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, changed = [], []
            for raw, start, end in cut(batch):
                if len(start):
                    start, end = whole_characters(raw, start, end)
                texts.append(kept(raw, start, end).decode("utf-8", "replace"))
                changed.append(len(start) > 0)
            own = {name: batch.column(name) for name in schema.names if name != "text"}
            own["text"] = pc.if_else(batch.column("__null"), pa.nulls(len(texts), pa.string()), pa.array(texts, pa.string()))
            if "n_chars" in own:
                n = pa.array([len(t) for t in texts], pa.int64()).cast(own["n_chars"].type)
                own["n_chars"] = pc.if_else(pa.array(changed), n, own["n_chars"])
            yield pa.RecordBatch.from_arrays([own[n] for n in schema.names], names=schema.names)

    return with_repeats(docs.withColumn("__null", F.col("text").isNull()), length, words=words).mapInArrow(take, schema)


def op1_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """The digests, and `text`, what is left of each document in whole characters without passages of `PASSAGE` words or more that
    stand elsewhere too, also those under 400 bytes, which the digests leave in; n_cut, the bytes these passages have."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fields = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, n_cut long"
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(fields).fields])

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, (start, end), (low, high) in cuts(batch):
                text = kept(raw, *whole_characters(raw, low, high)).decode("utf-8", "replace")
                digest = hashlib.sha256(kept(raw, start, end)).hexdigest()
                rows.append((len(raw), int((end - start).sum()), len(start), digest, text, int((high - low).sum())))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=schema.names)

    return with_repeats(docs, passages=PASSAGE).mapInArrow(digest, schema)
