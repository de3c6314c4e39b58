"""Removal of long repeated passages by a logarithmic family of suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document of a smaller id.  Documents go in batches of ascending ids.  A new batch
gets suffix arrays, its suffixes ordered by their first ``LENGTH`` bytes; these
are merged with the arrays of the existing levels, in which equal neighbours are
matches; then the batch becomes a level itself, and levels of equal size are
merged, so that ``n`` batches leave about log2(n) levels and a suffix is merged
as often.  Levels hold a content once, however many documents show it.

Arrays are cut into shards that tasks can hold.  Every string of ``LENGTH`` bytes
goes to the shard named by its minimizer, the least hash of the runs of ``MER``
bytes in it; equal strings have equal minimizers, and neighbouring strings mostly
share one, so they travel together as one stretch of text.  Texts are read as
pieces of about ``PIECE`` bytes, written once.  Before stretches are shuffled, four
bytes for each minimizer of a piece tell which occur in several documents at all;
the rest of the text can hold no match and stays where it is.  Equal stretches of
a piece travel once, with their places and their smallest and largest id, and the
verdict comes back to the piece by places.  A minimizer of over ``OFTEN`` pieces (a line of a third of all
pages) is split by a second one.  Matches are of bytes, never of hashes.

Defined results: texts are their UTF-8 bytes, so what is kept may start or end
within a character; a null text is empty; documents of a null id lose nothing and
take nothing from others; rows of one id don't match each other; texts under
``LENGTH`` bytes are kept whole; any other column is left out; an empty table
gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import MOST_TASKS, Scratch, give_back, let_go

LENGTH, MER = 50, 20
BATCHES, PIECE, SHARD, OFTEN = 4, 2 << 20, 1 << 20, 64
#: Hashes are worked out over so many bytes at once, to stay in a core's cache.
_CHUNK = 1 << 16
_EVER = -(1 << 63)

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BYTE = [np.array([(i * 2 + 1) * odd % (1 << 64) for i in range(256)], np.uint64) * np.uint64(0xD6E8FEB86659FD93) for odd in _ODD]
_VERDICT = np.dtype([("at", "<u4"), ("n", "u1"), ("over", "<i8")])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _rolling(codes: np.ndarray, n: int, odd: int) -> np.ndarray:
    """A hash of every run of ``n``, by doubling."""
    h, done, out, got, power = codes, 1, None, 0, odd
    while True:
        if n & done:
            if out is None:
                out, got = h, done
            else:
                m = len(h) - got
                out, got = out[:m] * np.uint64(power) + h[got:], got + done
        if 2 * done > n:
            return out
        h = h[:-done] * np.uint64(power) + h[done:]
        power, done = power * power % (1 << 64), done * 2


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every ``n`` neighbours."""
    done = 1
    while 2 * done <= n:
        x, done = np.minimum(x[:-done], x[done:]), done * 2
    return x if done == n else np.minimum(x[: len(x) - (n - done)], x[n - done :])


def minimizers(text: np.ndarray, which: int = 0) -> np.ndarray:
    """The minimizer of the ``LENGTH`` bytes from each place on."""
    out = np.empty(max(0, len(text) - LENGTH + 1), np.uint64)
    for a in range(0, len(out), _CHUNK):
        z = min(len(out), a + _CHUNK)
        out[a:z] = _least(_mixed(_rolling(_BYTE[which][text[a : z + LENGTH - 1]], MER, _ODD[which])), LENGTH - MER + 1)
    return out


def _starts(flags: np.ndarray) -> np.ndarray:
    return np.flatnonzero(flags)


def _words(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers that compare bytewise."""
    return np.ndarray(len(text) - 7, ">u8", text, strides=(1,))[places].astype(np.uint64)


def _sampled(text: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each span of ``LENGTH`` bytes or more: of its first ``LENGTH`` bytes, and of its last 40."""
    h = np.zeros(len(at), np.uint64)
    for places in (*(at + min(i, LENGTH - 8) for i in range(0, LENGTH, 8)), *(at + size - i for i in range(8, 41, 8))):
        h = _mixed(h * np.uint64(3) + _words(text, places))
    return h


class Piece:
    """Documents beside each other: ids ascending, and all their bytes."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, text: np.ndarray):
        self.ids, self.sizes, self.text = ids, sizes, text
        self.ends = np.cumsum(sizes)

    @functools.cached_property
    def keys(self) -> np.ndarray:
        return minimizers(self.text)

    @functools.cached_property
    def whole(self) -> np.ndarray:
        """Places whose string ends within its document."""
        out = np.ones(len(self.keys), bool)
        for e in self.ends[:-1]:
            out[max(0, e - LENGTH + 1) : e] = False
        return out

    def doc(self, at: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.ends, at, "right")] if len(at) else at

    @functools.cached_property
    def _runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, places) of the runs of whole places of one key; places that aren't whole part documents, so runs of LENGTH and more can't cross them."""
        keys, whole = self.keys, self.whole
        if not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        change = np.ones(len(keys), bool)
        change[1:] = (keys[1:] != keys[:-1]) | (whole[1:] != whole[:-1])
        at = _starts(change)
        n = np.diff(at, append=len(keys))
        ok = whole[at]
        return at[ok], n[ok]

    @functools.cached_property
    def _sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, order, first) of the runs, by key: each key once, and where its runs begin in the order."""
        keys = self.keys[self._runs[0]]
        order = np.argsort(keys)
        k = keys[order]
        first = _starts(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
        return k[first], order, first

    def marks(self) -> tuple[np.ndarray, np.ndarray]:
        """(minimizer, in several documents) of the piece, ascending."""
        keys, order, first = self._sorted
        d = self.doc(self._runs[0])[order]
        several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first) if len(d) else np.zeros(0, bool)
        return keys, several

    def stretches(self, marks: np.ndarray, codes: np.ndarray) -> Stretches:
        """Those of minimizers with a code: 1 as they are, 2 split by the second minimizer."""
        mine, order, first = self._sorted
        at, n = self._runs
        code = np.zeros(len(at), np.uint8)
        if len(at) and len(marks):
            code[order] = np.repeat(codes[np.searchsorted(marks, mine).clip(max=len(marks) - 1)], np.diff(first, append=len(at)))
        keys, two = self.keys[at], code == 2
        if two.any():
            a, m, k = at[two], n[two], keys[two]
            size = m + LENGTH - 1
            if size.sum() < len(self.text):  # only what is split
                second = minimizers(self.text[_ragged(a, size)], 1)[_ragged(np.cumsum(size) - size, m)]
            else:
                second = minimizers(self.text, 1)[_ragged(a, m)]
            new = np.ones(len(second), bool)
            new[1:] = second[1:] != second[:-1]
            new[np.cumsum(m) - m] = True
            sub, of = _starts(new), np.repeat(np.arange(len(m)), m)
            at, n, keys = (np.r_[x[code == 1], y] for x, y in ((at, _ragged(a, m)[sub]), (n, np.diff(sub, append=len(second))), (keys, _mixed(k[of[sub]] * np.uint64(3) + second[sub]))))
        else:
            at, n, keys = at[code > 0], n[code > 0], keys[code > 0]
        split = _starts(n > 255)  # a run of one byte repeated has one minimizer throughout
        if len(split):
            count = -(-n[split] // 255)
            x = 255 * _ragged(np.zeros(len(split), np.int64), count)
            at, n, keys = np.r_[np.delete(at, split), np.repeat(at[split], count) + x], np.r_[np.delete(n, split), np.minimum(255, np.repeat(n[split], count) - x)], np.r_[np.delete(keys, split), np.repeat(keys[split], count)]
        return Stretches(self, at, n, keys)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of all spans, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


class Stretches:
    """Stretches of a piece, and which of them are equal."""

    def __init__(self, piece: Piece, at: np.ndarray, n: np.ndarray, keys: np.ndarray):
        h = _sampled(piece.text, at, n + LENGTH - 1) if len(at) else np.zeros(0, np.uint64)
        order = np.argsort(_mixed(keys + h * np.uint64(3)) + n.astype(np.uint64))
        at, n, keys, h = at[order], n[order], keys[order], h[order]
        new = np.r_[True, (keys[1:] != keys[:-1]) | (n[1:] != n[:-1]) | (h[1:] != h[:-1])] if len(at) else np.zeros(0, bool)
        head = at[_starts(new)][np.cumsum(new) - 1] if len(at) else at
        size = n + LENGTH - 1
        other = _starts(~new)
        if len(other):  # hashes alike: compare the bytes with the first of the class
            same = piece.text[_ragged(at[other], size[other])] == piece.text[_ragged(head[other], size[other])]
            unlike = ~np.logical_and.reduceat(same, np.cumsum(size[other]) - size[other])
            if unlike.any():  # rare: each a class of its own, and a new class for what follows
                new[other[unlike]] = True
                new[np.minimum(other[unlike] + 1, len(new) - 1)] = True
        self.at, self.n, self.keys = at, n, keys
        self.first = _starts(new)
        self.count = np.diff(self.first, append=len(at))
        self.doc = piece.doc(at)
        self.piece = piece

    def shards(self, count: int) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, classes) in ascending order."""
        return _by_shard(self.keys[self.first], count)

    def packed(self, classes: np.ndarray, least: np.ndarray, most: np.ndarray) -> bytes:
        f = self.first[classes]
        n = self.n[f]
        text = self.piece.text[_ragged(self.at[f], n + LENGTH - 1)]
        count = self.count[classes]
        places = self.at[_ragged(f, count)].astype(np.uint32)
        return b"".join([np.array([len(f), len(places)], np.uint32).tobytes(), n.astype(np.uint8).tobytes(), least[classes].tobytes(), most[classes].tobytes(), count.astype(np.uint32).tobytes(), places.tobytes(), text.tobytes()])


def _unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    """(places of each stretch, smallest id, largest id, times it stands in the piece, where, bytes)."""
    m, shown = np.frombuffer(blob, np.uint32, 2).tolist()
    n = np.frombuffer(blob, np.uint8, m, 8).astype(np.int64)
    return n, *(np.frombuffer(blob, t, k, 8 + a) for t, k, a in ((np.int64, m, m), (np.int64, m, 9 * m), (np.uint32, m, 17 * m), (np.uint32, shown, 21 * m), (np.uint8, -1, 21 * m + 4 * shown)))


def _suffixes(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The first ``LENGTH`` bytes from each place on, as values that compare bytewise."""
    if not len(places):
        return np.zeros(0, f"V{LENGTH}")
    rows = np.lib.stride_tricks.sliding_window_view(text, LENGTH)[places]
    return np.ascontiguousarray(rows).view(f"V{LENGTH}").ravel()


def _ordered(text: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in the order of their first ``LENGTH`` bytes, and which begin another string: by eight bytes, then what is alike by the next eight."""
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    word = _words(text, places)
    order = np.argsort(word)
    word = word[order]
    tied = np.zeros(len(places), bool)  # with the one before
    tied[1:] = word[1:] == word[:-1]
    for off in (*range(8, LENGTH - 8, 8), LENGTH - 8):
        more = tied.copy()
        more[:-1] |= tied[1:]
        at = _starts(more)
        if not len(at):
            break
        begins = ~tied[at]
        which = order[at]
        word = _words(text, places[which] + off)
        differ = np.zeros(len(at), bool)
        differ[1:] = (word[1:] != word[:-1]) & ~begins[1:]
        first = _starts(begins)
        mixed = np.logical_or.reduceat(differ, first)  # other groups stay as they are
        if not mixed.any():
            continue
        size = np.diff(first, append=len(at))
        use = np.repeat(mixed, size)
        at, which, word = at[use], which[use], word[use]
        group = np.repeat(np.arange(int(mixed.sum())), size[mixed])
        by = np.argsort(word)
        by = by[np.argsort(_narrow(group[by], int(mixed.sum())), kind="stable")]
        word, order[at] = word[by], which[by]
        tied[at[1:]] = (word[1:] == word[:-1]) & (group[1:] == group[:-1])
    return order, ~tied


def _narrow(x: np.ndarray, most: int) -> np.ndarray:
    """Numbers below ``most``, in two bytes if they fit: those are sorted by radix."""
    return x.astype(np.uint16) if most <= 1 << 16 else x


class Level:
    """A shard's suffix array: stretches of text, and their places in the order of their suffixes, equal ones once."""

    def __init__(self, text: np.ndarray, order: np.ndarray):
        self.text, self.order = text, order

    @classmethod
    def read(cls, blob: bytes) -> Level:
        m = int(np.frombuffer(blob, np.uint32, 1)[0])
        return cls(np.frombuffer(blob, np.uint8, m, 4), np.frombuffer(blob, np.uint32, -1, 4 + m).astype(np.int64))

    def packed(self) -> bytes:
        return np.uint32(len(self.text)).tobytes() + self.text.tobytes() + self.order.astype(np.uint32).tobytes()

    def suffixes(self) -> np.ndarray:
        return _suffixes(self.text, self.order)

    def merged(self, other: Level) -> Level:
        text, places = np.concatenate([self.text, other.text]), np.concatenate([self.order, other.order + len(self.text)])
        order, new = _ordered(text, places)
        return Level(text, places[order[new]])


def scanned(blobs: list[bytes], levels: list[Level]) -> tuple[list[bytes], Level]:
    """What each blob's stretches lose against the levels and each other, and the batch's own level."""
    parts = [_unpacked(b) for b in blobs]
    n, least, most, count, shown_at, text = (np.concatenate([p[i] for p in parts]) for i in range(6))
    count = count.astype(np.int64)
    begin = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
    # equal stretches of different pieces are ordered once
    seen: dict[bytes, int] = {}
    whole, raw = np.empty(len(n), np.int64), text.tobytes()
    for i, (a, m) in enumerate(zip(begin.tolist(), n.tolist(), strict=True)):
        whole[i] = seen.setdefault(raw[a : a + m + LENGTH - 1], len(seen))
    _, one = np.unique(whole, return_index=True)
    floor = np.full(len(seen), np.iinfo(np.int64).max)
    np.minimum.at(floor, whole, least)
    m = n[one]
    owner = np.repeat(np.arange(len(one)), m)
    before = np.cumsum([0, *(len(x.text) for x in levels)])
    held = [x.order + b for x, b in zip(levels, before[:-1], strict=True)]
    olds = sum(map(len, held))
    by, new = _ordered(np.concatenate([*(x.text for x in levels), text]), np.concatenate([*held, _ragged(begin[one], m) + before[-1]]))
    group = np.cumsum(new) - 1
    mine = by >= olds
    old = np.zeros(group[-1] + 1 if len(group) else 0, bool)
    old[group[~mine]] = True
    order, group = by[mine] - olds, group[mine]
    known = old[group]
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    over = np.minimum.reduceat(floor[owner[order]], _starts(new)) if len(order) else np.zeros(0, np.int64)
    lost = np.empty(len(order), np.int64)
    lost[order] = np.where(known, _EVER, over[np.cumsum(new) - 1])
    # the batch's level: what no level holds yet
    fresh = order[new & ~known]
    needed = np.zeros(len(one), bool)
    needed[owner[fresh]] = True
    kept = np.cumsum(np.where(needed, m + LENGTH - 1, 0)) - np.where(needed, m + LENGTH - 1, 0)
    within = _ragged(np.zeros(len(one), np.int64), m)
    level = Level(text[_ragged(begin[one][needed], m[needed] + LENGTH - 1)], (kept[owner] + within)[fresh])
    # verdicts: runs of places with one bound, where it is below the largest id
    shown = np.repeat(np.arange(len(n)), n)
    bound = lost[_ragged((np.cumsum(m) - m)[whole], n)]
    at = _ragged(np.zeros(len(n), np.int64), n)
    run = _starts(np.r_[True, (shown[1:] != shown[:-1]) | (bound[1:] != bound[:-1])]) if len(shown) else shown
    size = np.diff(np.r_[run, len(shown)])
    use = bound[run] < most[shown[run]]
    run, size = run[use], size[use]
    times = count[shown[run]]
    v = np.zeros(times.sum(), _VERDICT)  # once for each place where the stretch stands
    stands = _ragged((np.cumsum(count) - count)[shown[run]], times)
    v["at"], v["n"], v["over"] = shown_at[stands] + np.repeat(at[run], times).astype(np.uint32), np.repeat(size, times), np.repeat(bound[run], times)
    cuts = np.searchsorted(np.repeat(shown[run], times), np.cumsum([0, *(len(p[0]) for p in parts)]))
    return [v[a:z].tobytes() for a, z in zip(cuts, cuts[1:], strict=False)], level


def _read(r: dict) -> Piece:
    return Piece(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["sizes"], np.int64), np.frombuffer(r["text"], np.uint8))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]
        give_back()


def _batch(columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) for c, t in kinds.items()], list(kinds))


_PIECE = {"piece": pa.int64(), "batch": pa.int32(), "ids": pa.binary(), "sizes": pa.binary(), "text": pa.binary()}


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (id, text, batch) as pieces of one batch each."""
    held: dict[int, list] = {}
    count = TaskContext.get().partitionId() << 32

    def flushed(k: int) -> pa.RecordBatch:
        nonlocal count
        rows = sorted(held.pop(k), key=lambda r: r[0])
        count += 1
        sizes = np.array([len(t) for _, t in rows], np.int64)
        return _batch({"piece": [count], "batch": [k], "ids": [np.array([i for i, _ in rows], np.int64).tobytes()], "sizes": [sizes.tobytes()], "text": [b"".join(t for _, t in rows)]}, _PIECE)

    weight: dict[int, int] = {}
    for b in batches:
        for a in range(0, b.num_rows, 512):
            part = b.slice(a, 512)
            for i, t, k in zip(*(part.column(c).to_pylist() for c in ("id", "text", "batch")), strict=True):
                held.setdefault(k, []).append((i, t))
                weight[k] = weight.get(k, 0) + len(t) + 16
                if weight[k] >= PIECE:
                    weight[k] = 0
                    yield flushed(k)
    for k in sorted(held):
        yield flushed(k)


def _marked(shards: int):
    """(shard, piece, values, several) of each piece: four bytes for each of its minimizers."""
    kinds = {"shard": pa.int64(), "piece": pa.int64(), "values": pa.binary(), "several": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            marks, several = _read(r).marks()
            out = {c: [] for c in kinds}
            for s, at in _by_shard(marks, shards):
                for c, x in zip(kinds, (s, r["piece"], _short(marks[at]).tobytes(), several[at].tobytes()), strict=True):
                    out[c].append(x)
            yield _batch(out, kinds)

    return run


def _by_shard(marks: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    shard = _narrow(marks % np.uint64(shards), shards)
    order = np.argsort(shard, kind="stable")
    told = shard[order]
    cuts = _starts(np.r_[True, told[1:] != told[:-1]]) if len(order) else order
    for a, z in zip(cuts, np.r_[cuts[1:], len(order)].astype(np.int64), strict=True):
        yield int(told[a]), order[a:z]


def _short(marks: np.ndarray) -> np.ndarray:
    """Four bytes; two minimizers that share them are only kept once too often."""
    return (_mixed(marks) >> np.uint64(32)).astype(np.uint32)


def _judged(t):
    """A code for each mark: 0 in one document alone, 2 in over ``OFTEN`` pieces, else 1."""
    values = [np.frombuffer(x, np.uint32) for x in t.column("values").to_pylist()]
    several = [np.frombuffer(x, bool) for x in t.column("several").to_pylist()]
    _, of, count = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    more = np.zeros(len(count), bool)
    more[of[np.concatenate(several)]] = True
    code = np.where(count > OFTEN, 2, (count > 1) | more).astype(np.uint8)[of]
    cuts = np.cumsum([0, *map(len, values)])
    return pa.table({"piece": t.column("piece"), "shard": t.column("shard"), "codes": pa.array([code[a:z].tobytes() for a, z in zip(cuts, cuts[1:], strict=False)], pa.binary())})


def _coded(r: dict, shards: int) -> Stretches:
    piece = _read(r)
    marks, _ = piece.marks()
    codes, got = np.zeros(len(marks), np.uint8), {c["shard"]: c["codes"] for c in r["codes"]}
    for s, at in _by_shard(marks, shards):
        codes[at] = np.frombuffer(got[s], np.uint8)
    return piece.stretches(marks, codes)


def _sent(marks: int, shards: int):
    """(shard, piece, blob): the stretches of each piece that may occur elsewhere."""
    kinds = {"shard": pa.int64(), "piece": pa.int64(), "blob": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            s = _coded(r, marks)
            out = {c: [] for c in kinds}
            if len(s.first):
                least, most = np.minimum.reduceat(s.doc, s.first), np.maximum.reduceat(s.doc, s.first)
                for shard, classes in s.shards(shards):
                    for c, x in zip(kinds, (shard, r["piece"], s.packed(classes, least, most)), strict=True):
                        out[c].append(x)
            yield _batch(out, kinds)

    return run


_FOUND = "shard long, verdicts array<struct<piece: long, verdict: binary>>, level binary"
_FOUND_KINDS = {"shard": pa.int64(), "verdicts": pa.list_(pa.struct({"piece": pa.int64(), "verdict": pa.binary()})), "level": pa.binary()}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's blobs of a shard, merged with its levels: verdicts, and the batch's own level."""
    for r in _rows(batches):
        blobs = sorted(r["blobs"], key=lambda b: b["piece"])
        found, level = scanned([b["blob"] for b in blobs], [Level.read(x) for c, x in r.items() if c.startswith("level_") and x is not None])
        back = [{"piece": b["piece"], "verdict": v} for b, v in zip(blobs, found, strict=True) if v]
        yield _batch({"shard": [r["shard"]], "verdicts": [back], "level": [level.packed() if len(level.order) else None]}, _FOUND_KINDS)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for r in _rows(batches):
        a, b = (Level.read(r[c]) if r[c] is not None else None for c in ("level_0", "level_1"))
        yield _batch({"shard": [r["shard"]], "level": [(a.merged(b) if a and b else a or b).packed()]}, {"shard": pa.int64(), "level": pa.binary()})


class Family:
    """The levels, (batches held, table of (shard, level)), the largest first.

    Tables are dealt by shard into ``buckets``, as batches are, so levels are read in place and never shuffled.
    """

    def __init__(self, spark: SparkSession, scratch: Scratch, buckets: int):
        self.spark, self.scratch, self.buckets = spark, scratch, buckets
        self.levels: list[tuple[int, str]] = []

    def _level(self, table: str, name: str) -> DataFrame:
        return self.spark.table(table).where("level is not null").select("shard", F.col("level").alias(name))

    def add(self, batch: DataFrame, last: bool = False) -> DataFrame:
        """(piece, verdict) of a batch (shard, piece, blob), which then becomes a level unless it is the last."""
        rows = batch.repartition(self.buckets, "shard").groupBy("shard").agg(F.collect_list(F.struct("piece", "blob")).alias("blobs"))
        for i, (_, table) in enumerate(self.levels):
            rows = rows.join(self._level(table, f"level_{i}").hint("merge"), "shard", "left")
        found = self.scratch.bucketed(rows.mapInArrow(_scan, _FOUND), "scan", "shard", self.buckets)
        verdicts = self.scratch.keep(self.spark.table(found).select(F.explode("verdicts").alias("v")).select("v.piece", "v.verdict"), "verdicts")
        if last:
            self.scratch.release(found)
        else:
            self.levels.append((1, found))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (m, b) = self.levels.pop(), self.levels.pop()
            both = self._level(a, "level_0").hint("merge").join(self._level(b, "level_1"), "shard", "full")
            self.levels.append((n + m, self.scratch.bucketed(both.mapInArrow(_merge, "shard long, level binary"), "level", "shard", self.buckets)))
            self.scratch.release(a)
            self.scratch.release(b)
        let_go(self.spark)
        return verdicts


_OUT = "id long, n_bytes long, starts array<long>, ends array<long>, kept binary"


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document with its spans (start, end) to remove, and the bytes that are kept."""
    for r in _rows(batches):
        piece = _read(r)
        gone = _gone(piece, r["verdicts"] or [])
        some = np.diff(np.r_[0, np.cumsum(gone)][piece.ends], prepend=0) > 0
        out = {"id": [], "n_bytes": [], "starts": [], "ends": [], "kept": []}
        for i, e, n, any_gone in zip(piece.ids.tolist(), piece.ends.tolist(), piece.sizes.tolist(), some.tolist(), strict=True):
            text, edge = piece.text[e - n : e], np.zeros(0, np.int64)
            if any_gone:
                mask = gone[e - n : e]
                edge, text = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8))), text[~mask]
            for c, x in zip(out, (i, n, edge[::2].tolist(), edge[1::2].tolist(), text.tobytes()), strict=True):
                out[c].append(x)
        yield _batch(out, {"id": pa.int64(), "n_bytes": pa.int64(), "starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "kept": pa.binary()})


def _gone(piece: Piece, verdicts: list[bytes]) -> np.ndarray:
    """Which bytes of the piece the verdicts remove."""
    cover = np.zeros(len(piece.text) + 1, np.int32)
    for x in verdicts:
        v = np.frombuffer(x, _VERDICT)
        at = v["at"].astype(np.int64)
        use = piece.doc(at) > v["over"]
        at, n = at[use], v["n"][use]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + n + LENGTH - 1, -1)
    return np.cumsum(cover)[:-1] > 0


def remove_repeats(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """(id, n_bytes, starts, ends, kept): the bytes of each document, the spans removed from them, and what is left.

    Reads tables of ``scratch``: use or write it within its block.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    told = rows.where("id is not null")
    size = told.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.percentile_approx("id", [i / batches for i in range(1, batches)] or [0.5], 1000).alias("cuts")).first()
    marks, shards, dealt = (max(1, -(-size["bytes"] // x)) for x in (4 * SHARD, SHARD, 16 * PIECE))
    batch = F.lit(0)
    for c in sorted(set(size["cuts"] or []))[: batches - 1]:
        batch = batch + (F.col("id") > c).cast("int")
    cut = told.select("id", "text", batch.alias("batch")).mapInArrow(_cut, "piece long, batch int, ids binary, sizes binary, text binary")
    pieces = spark.table(scratch.bucketed(cut, "pieces", "piece", min(dealt, MOST_TASKS), "batch"))  # joins on the piece move what they join, not the texts
    seen = pieces.mapInArrow(_marked(marks), "shard long, piece long, values binary, several binary")
    judged = seen.groupBy("shard").applyInArrow(_judged, "piece long, shard long, codes binary")
    codes = scratch.keep(judged.groupBy("piece").agg(F.collect_list(F.struct("shard", "codes")).alias("codes")), "codes")
    family, found = Family(spark, scratch, min(-(-shards // 8), MOST_TASKS)), []
    for k in range(batches):
        coded = pieces.where(F.col("batch") == k).join(codes.hint("shuffle_hash"), "piece")
        found.append(family.add(coded.mapInArrow(_sent(marks, shards), "shard long, piece long, blob binary"), k == batches - 1))
    for _, table in family.levels:
        scratch.release(table)
    verdicts = functools.reduce(DataFrame.unionByName, found).groupBy("piece").agg(F.collect_list("verdict").alias("verdicts"))
    done = pieces.join(verdicts.hint("shuffle_hash"), "piece", "left").mapInArrow(_cleaned, _OUT)  # a bucket's few pieces aren't sorted
    none = F.expr("cast(array() as array<bigint>)")
    alone = rows.where("id is null").select("id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("starts"), none.alias("ends"), F.col("text").alias("kept"))
    return done.unionByName(alone)
