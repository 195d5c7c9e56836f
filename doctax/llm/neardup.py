"""Near-duplicate texts: an exact set-similarity join on word shingles, size-aware and heavy-light.

Two texts are similar if the Jaccard similarity of their sets of ``k`` successive words reaches a
threshold. The join finds all such pairs:

* Sets fall into tiers by size. In a tier every set is cut into the same number of segments by a hash of its
  shingles. If two sets are similar, they are so in at least one segment: were the shingles that only
  one has too many in every segment, they would be too many in all.
* In a segment shingles have one global order, rarest first, by a frequency sketch over all texts. Any order is right; a
  good one keeps inverted lists short.
* Large sets scan inverted lists: two segments that are similar share one of the first ``s - o + 1``
  shingles of both, where ``o`` is the overlap that the two sizes need. Lists are sorted by size, so
  that only partners of a possible size are met.
* Small sets enumerate fixed-size subsets: two small sets that are similar share two of the first
  ``s - o + 2`` shingles, so each pair of those is one key. Up to which size a set is small is decided by
  cost, from the sizes of all sets and the lengths of the lists.
* With a list's entry come the parities of what stands from its place on in its segment. At the first shingle in
  common all before it are in one set only, and each bit that differs is one more: a pair above what the threshold
  allows is dropped, and no similar pair is. Parities of whole sets are compared after that, and sets exactly at last.

Entries travel without their sets: what one costs is the same for any number of partitions. The list of a
shingle that very many sets have is split by blocks of sets, each pair of blocks a list of its own. Sets that are equal are one class: they
meet others as one entry and are listed through the member with the smallest id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, table
from .splits import connected_groups

#: Bytes of text for each counter of the frequency sketch, and the least and most counters as powers of two.
SKETCH_BYTES, SKETCH_LEAST, SKETCH_MOST = 80, 14, 25
#: The sketch is added in parts of so many counters.
SKETCH_PART = 1 << 14
MAP_WORDS = 8
#: Bits of the parities that come with an entry; shingles of a segment, about.
SIGNATURE, SEGMENT = 48, 16
#: A tier reaches from a size to so many times that size.
TIER = 8
#: Making, shuffling and sorting of one key cost as much as so many hits in inverted lists (2.5 microseconds, estimated from a small run, against 10 nanoseconds).
KEY_COST = 250.0
#: Pairs of hits that are looked at in one go.
BLOCK = 1 << 15
#: A list of more entries than this is split into blocks of about so many.
HOT = 50_000
#: Entries of inverted lists for each task of the joining part, about; pairs that it holds at most.
ENTRIES_A_PART, PAIRS_HELD = 700_000, 1 << 20
#: Classes of equal sets up to this size are listed pair by pair; larger ones as pairs with their representative.
COPY_PAIRS = 64
#: Bytes of text that are shingled in one go, except for a text that is longer.
BATCH_BYTES = 4 << 20
#: Sets, parity maps and pairs that are compared in one task.
SETS_A_BLOCK, MAPS_A_BLOCK, PAIRS_A_BLOCK = 30_000, 100_000, 500_000
#: Ids that may be broadcast when the texts of candidate pairs are fetched; beyond, both sides are shuffled.
BROADCAST_IDS = 100_000

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


#: The base of the words' hashes and its inverse modulo 2^64.
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def _characters() -> np.ndarray:
    """For each code point a number that its lower case (the first character of it) shares; 0 if it is no letter or digit."""
    if "characters" not in _tables:
        points = [chr(i) for i in range(0x110000)]
        lower = np.fromiter((ord(c.lower()[0]) for c in points), np.uint64, len(points))
        known = np.fromiter((c.isalnum() for c in points), bool, len(points))
        _tables["characters"] = np.where(known, mix(lower * _M1 + _M2) | np.uint64(1), np.uint64(0))
    return _tables["characters"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse."""
    if len(_tables.get("powers", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("powers", _BASE), ("inverse", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _tables[name] = np.cumprod(table)
    return _tables["powers"], _tables["inverse"]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts of a batch in order, and each text's number of words.

    Words are runs of letters and digits, lower case character by character. The batch is one run of code
    points; a word's hash is a polynomial in its characters, the difference of two running sums taken back to place 0.
    """
    listed = texts.to_pylist()
    points = np.frombuffer("\n".join(listed).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, listed), np.int64, len(listed))
    ends = np.cumsum(sizes + 1)  # with the line feed between texts, which is in no word
    value = _characters()[points]
    inside = np.zeros(len(points) + 2, np.int8)
    inside[1:-1] = value != 0
    step = np.diff(inside)
    start, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    power, inverse = _powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(value * power[: len(points)], out=sums[1:])
    words = mix((sums[stop] - sums[start]) * inverse[start])
    return words, np.bincount(np.searchsorted(ends, start, "right"), minlength=len(texts))


#: Rows of a batch that are shingled in one go: their number shares 64 bits with the hash while it is sorted.
ROW_BITS = 14


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted values, each once; sorting numbers is faster than hashing them."""
    x = np.sort(x)
    fresh = np.ones(len(x), bool)
    fresh[1:] = x[1:] != x[:-1]
    return x[fresh]


def ordered(group: np.ndarray, rank: np.ndarray, shingle: np.ndarray) -> np.ndarray:
    """The places of shingles by group, rank and hash."""
    bits = int(group.max()).bit_length() if len(group) else 0
    key = group.astype(np.uint64) << np.uint64(64 - bits) if bits else np.zeros(len(group), np.uint64)
    return np.argsort(key | rank.astype(np.uint64) << np.uint64(57 - bits) | shingle >> np.uint64(bits + 7))


class Sets:
    """The distinct shingles of the texts of a batch, sorted by text and hash.

    A shingle is a number of 64 bits of which the lower ``ROW_BITS`` are 0.
    """

    def __init__(self, texts: pa.Array, k: int, min_words: int):
        if len(texts) > 1 << ROW_BITS:
            raise ValueError("the batch is too large")
        values, count = word_hashes(texts)
        doc = np.repeat(np.arange(len(count), dtype=np.uint64), count)
        at = len(values) - k + 1
        if at > 0:
            shingle = np.zeros(at, np.uint64)
            for i in range(k):
                shingle = mix(shingle * _M1 + values[i : i + at] + np.uint64(i + 1))
            inside = (doc[:at] == doc[k - 1 :]) & (count >= max(k, min_words))[doc[:at]]
            shingle, doc = shingle[inside], doc[:at][inside]
        else:
            shingle, doc = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        begin = np.cumsum(count) - count
        for words in range(max(1, min_words), k):  # a text of fewer words is one shingle of all of them
            rows = np.flatnonzero(count == words)
            if len(rows):
                all_ = np.full(len(rows), words, np.uint64) * _M3
                for i in range(words):
                    all_ = mix(all_ * _M1 + values[begin[rows] + i] + np.uint64(i + 1))
                shingle, doc = np.concatenate([shingle, all_]), np.concatenate([doc, rows.astype(np.uint64)])
        both = distinct(doc << np.uint64(64 - ROW_BITS) | shingle >> np.uint64(ROW_BITS))
        doc, self.shingle = (both >> np.uint64(64 - ROW_BITS)).astype(np.int64), both << np.uint64(ROW_BITS)
        self.start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
        self.rows = doc[self.start]  # the batch's rows that have a set
        self.size = np.diff(np.append(self.start, len(doc)))
        self.of = np.repeat(np.arange(len(self.start)), self.size)

    def order(self, rank: np.ndarray) -> np.ndarray:
        """The shingles by text, rank and hash."""
        return ordered(self.of, rank, self.shingle)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit numbers that equal sets share."""
        if not len(self.start):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return (np.add.reduceat(mix(self.shingle ^ _M1), self.start), np.add.reduceat(mix(self.shingle + _M3), self.start))

    def maps(self) -> np.ndarray:
        """The parity maps, a row of 64-bit words for each set."""
        bit = mix(self.shingle ^ _M2) & np.uint64(64 * MAP_WORDS - 1)
        flips = np.bincount(self.of * (64 * MAP_WORDS) + bit.astype(np.int64), minlength=len(self.start) * 64 * MAP_WORDS) & 1
        packed = np.packbits(flips.astype(np.uint8).reshape(len(self.start), 64 * MAP_WORDS), axis=1)
        return np.ascontiguousarray(packed).view(np.uint64)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``1 << ROW_BITS`` rows, and of some million characters, so that memory is bounded."""
    for batch in batches:
        size, at = pa.compute.cumulative_sum(pa.compute.binary_length(batch.column("text"))).to_numpy().astype(np.int64), 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            stop = min(at + (1 << ROW_BITS), max(at + 1, int(np.searchsorted(size, before + BATCH_BYTES, "right"))))
            yield batch.slice(at, stop - at)
            at = stop


def needed(size_a, size_b, threshold: float):
    """The overlap that two sets of these sizes need."""
    return np.ceil(threshold / (1 + threshold) * (size_a + size_b) - 1e-9).astype(np.int64)


def counter_of(shingle: np.ndarray, bits: int) -> np.ndarray:
    """The counter of the sketch that counts a shingle."""
    return (shingle >> np.uint64(64 - bits)).astype(np.int64)


def class_keys(sets: Sets, roles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers that equal sets of one role share."""
    k1, k2 = sets.keys()
    return mix(k1 + roles.astype(np.uint64) * _M1), k2


def _first_pass(k: int, min_words: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        sizes: dict[int, int] = {}
        for batch in _cut(batches):
            sets = Sets(batch.column("text"), k, min_words)
            counts += np.bincount(counter_of(sets.shingle, bits), minlength=len(counts)).astype(np.uint32)
            for size, n in zip(*np.unique(sets.size, return_counts=True), strict=True):
                sizes[int(size)] = sizes.get(int(size), 0) + int(n)
            rows = pa.array(sets.rows)
            role = batch.column("role").take(rows).to_numpy()
            k1, k2 = class_keys(sets, role)
            maps = [x.tobytes() for x in np.concatenate([sets.size[:, None].astype(np.uint64), sets.maps()], axis=1)]
            yield _row(1, batch.column("id").take(rows).to_numpy(), k1.view(np.int64), k2.view(np.int64), role, maps)
        task = TaskContext.get().partitionId()
        for at in range(0, len(counts), SKETCH_PART):
            part = counts[at : at + SKETCH_PART]
            if part.any():
                yield _row(0, np.array([at]), np.array([task]), np.zeros(1), np.zeros(1), [_squeezed(part)])
        yield _row(2, np.array(list(sizes), np.int64), np.array(list(sizes.values()), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64))

    return run


def _squeezed(counts: np.ndarray) -> bytes:
    return pa.compress(counts.astype(np.uint32).tobytes(), codec="zstd", asbytes=True)


def _row(kind: int, a, b, c, d, blobs: list[bytes] | None = None) -> pa.RecordBatch:
    n = len(a)
    columns = [pa.array(np.full(n, kind, np.int32)), *(pa.array(x.astype(np.int64)) for x in (a, b, c)), pa.array(d.astype(np.int32)), pa.array(blobs or [None] * n, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["kind", "a", "b", "c", "role", "blob"])


def _added(last: bool):
    """Adds parts of the sketch, one at a time in memory for each place; at last as levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, blob in zip(batch.column("a").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                own = np.frombuffer(pa.decompress(blob, SKETCH_PART * 4, codec="zstd", asbytes=True), np.uint32)
                sums[at] = sums[at] + own if at in sums else own.astype(np.uint64)
        out = [(levels(x).tobytes() if last else _squeezed(np.minimum(x, 0xFFFFFFFF))) for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(out, pa.binary())], ["a", "blob"])

    return run


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts as levels: 0 unseen, 1 once, else by thirds of a power of two."""
    return np.where(counts > 1, np.minimum(127, np.ceil(np.log2(np.maximum(counts, 1)) * 3) + 1), counts).astype(np.int8)


def level_count(level: np.ndarray) -> np.ndarray:
    """About the count of a level, not below it."""
    return np.where(level > 0, np.exp2((level.astype(float) - 1) / 3), 0.0)


def small_boundary(sizes: dict[int, int], list_length: float, threshold: float, key_cost: float = KEY_COST) -> int:
    """The size up to which sets enumerate subsets: where that saves most against scanning lists; 0 if nowhere."""
    best, boundary, scanned, keys, below = 0.0, 0, 0.0, 0.0, 0
    total = max(1, sum(sizes.values()))
    for size in sorted(sizes):
        prefix = size - int(needed(size, math.ceil(threshold * size), threshold)) + 1
        below += sizes[size]
        if math.ceil(threshold * size) < 2:
            continue
        scanned += sizes[size] * prefix * list_length
        keys += sizes[size] * prefix * (prefix + 1) / 2 * key_cost
        gain = scanned * (below / total) / 2 - keys
        if gain > best:
            best, boundary = gain, size
    return boundary


def size_tiers(sizes: dict[int, int], threshold: float, boundary: int) -> list[tuple[int, int, int]]:
    """``(low, high, segments)`` of each tier: sizes from ``low`` to below ``high``.

    Small sets are a tier of one segment. Where the others begin is chosen so that few sets are in reach of a tier below
    theirs (they send entries to both).
    """
    large = {s: n for s, n in sizes.items() if s > boundary}
    tiers = [(1, boundary + 1, 1)] if boundary else []
    if not large:
        return tiers
    least, most = min(large), max(large)

    def edges(first: float) -> list[int]:
        out = [boundary + 1]
        while first <= most:
            if (at := math.ceil(first)) > out[-1]:
                out.append(at)
            first *= TIER
        return [*out, most + 1]

    def visits(found: list[int]) -> int:
        return sum(n for s, n in large.items() for e in found[1:-1] if e <= s <= e / threshold)

    cuts = min((edges(least * TIER ** (i / 24)) for i in range(1, 25)), key=lambda x: (visits(x), len(x)))
    for low, high in zip(cuts, cuts[1:], strict=False):
        own = sorted((s, n) for s, n in large.items() if low <= s < high)
        if own:
            half, at = sum(n for _, n in own) / 2, 0
            for size, n in own:
                at += n
                if at >= half:
                    break
            tiers.append((low, high, max(1, round(size / SEGMENT))))
    return tiers


def entries(sets: Sets, chosen: np.ndarray, tier: int, segments: int, level: np.ndarray, threshold: float, pairs: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Entries of the chosen sets in a tier: (set, key, place, size of the segment, parities from the place on, level).

    ``pairs`` marks the sets that enumerate pairs of shingles, which are entries, too; their keys are odd.
    """
    bits = len(level).bit_length() - 1
    inside = chosen[sets.of]
    shingle, of = sets.shingle[inside], sets.of[inside]
    rank = level[counter_of(shingle, bits)]
    group = of * segments
    if segments > 1:
        group = group + ((mix(shingle ^ _M2) >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
    order = ordered(group, rank, shingle)
    shingle, of, group, rank = shingle[order], of[order], group[order], rank[order]
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(group)))
    which = np.repeat(np.arange(len(start)), size)
    place = np.arange(len(group)) - start[which]
    scrambled = mix(shingle ^ _M3 + np.uint64(2 * tier + 2))
    so_far = np.bitwise_xor.accumulate(np.uint64(1) << (scrambled % np.uint64(SIGNATURE))) if len(group) else scrambled
    before = np.concatenate([np.zeros(1, np.uint64), so_far[:-1]]) if len(group) else so_far
    whole = so_far[start + size - 1]
    least = np.ceil(threshold * size - 1e-9).astype(np.int64)
    last = size - least
    if pairs is not None:
        own = pairs[of[start]]
        last = np.where(own, size - needed(size, size, threshold), last)  # small sets are only met, by larger ones
    kept = np.flatnonzero((place <= last[which]) & (rank > 1))  # a shingle that one text has joins nothing
    key = mix(scrambled + _M2) & ~np.uint64(1)
    out = [(of[kept], key[kept], place[kept], size[which[kept]], whole[which[kept]] ^ before[kept], rank[kept])]
    if pairs is not None and own.any():
        wide = np.where(own, size - least + 1, -1)
        for gap in range(1, int(wide.max()) + 1):
            if len(of) <= gap:
                break
            at = np.flatnonzero((which[:-gap] == which[gap:]) & (place[gap:] <= wide[which[gap:]]) & (rank[:-gap] > 1) & (rank[gap:] > 1))
            both = mix(scrambled[at] * _M1 ^ mix(scrambled[at + gap])) | np.uint64(1)
            # of the two shingles in common that come first: one place fewer stands before the second
            out.append((of[at], both, place[at + gap] - 1, size[which[at]], whole[which[at]] ^ before[at + gap], np.minimum(rank[at], rank[at + gap])))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def split_hot(key: np.ndarray, own: np.ndarray, rank: np.ndarray, hot: int = HOT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, key, side): entries of lists that are too long go to a list for each pair of blocks of sets.

    In the list of two different blocks the sides are 1 and 2 and only different sides need to meet; else the side is 0.
    """
    blocks = np.ceil(level_count(rank) / hot).astype(np.int64)
    out = [(np.flatnonzero(blocks <= 1), key[blocks <= 1], np.zeros(int((blocks <= 1).sum()), np.int64))]
    many = np.flatnonzero(blocks > 1)
    if len(many):
        mine = (mix(own[many] ^ _M3) % blocks[many].astype(np.uint64)).astype(np.int64)
        for other in range(int(blocks[many].max())):
            at = np.flatnonzero(blocks[many] > other)
            low, high = np.minimum(mine[at], other), np.maximum(mine[at], other)
            fresh = mix(key[many[at]] ^ mix((low << 32 | high).astype(np.uint64) + _M1)) & ~np.uint64(1) | key[many[at]] & np.uint64(1)
            out.append((many[at], fresh, np.where(low == high, 0, np.where(mine[at] == low, 1, 2))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def packed(columns: list[np.ndarray]) -> tuple[bytes, np.ndarray]:
    """Numbers of a few columns byte by byte, without the bytes that are 0 in all: the bytes of each column, and a row for each of them."""
    rows, widths = [], []
    for column in columns:
        width = max(1, (int(column.max()).bit_length() + 7) // 8) if len(column) else 1
        rows.append(np.ascontiguousarray(column.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T)
        widths.append(width)
    return bytes(widths), np.ascontiguousarray(np.concatenate(rows))


def unpacked(blobs: list[bytes], columns: int) -> list[np.ndarray]:
    """The numbers of blobs of ``packed``, one after the other."""
    parts: dict[bytes, list[np.ndarray]] = {}
    for blob in blobs:
        widths = blob[:columns]
        parts.setdefault(widths, []).append(np.frombuffer(blob, np.uint8, offset=columns).reshape(sum(widths), -1))
    out: list[list[np.ndarray]] = [[] for _ in range(columns)]
    for widths, found in parts.items():
        rows, at = np.concatenate(found, axis=1), 0
        for column, width in zip(out, widths, strict=True):
            wide = np.zeros((rows.shape[1], 8), np.uint8)
            wide[:, :width] = rows[at : at + width].T
            column.append(wide.view("<u8").ravel())
            at += width
    return [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out]


#: What an entry has: the lower half of its key, class, segment size, place, parities, and as bits role (2), visit to a lower tier (1), side (2) and small set (1).
_COLUMNS = ("key", "own", "size", "place", "parity", "flags")


def _second_pass(k: int, min_words: int, threshold: float, tiers: list[tuple[int, int, int]], boundary: int, mask: int, level, parts: list[int], hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            sets = Sets(batch.column("text"), k, min_words)
            if not len(sets.start):
                continue
            role = batch.column("role").take(pa.array(sets.rows)).to_numpy()
            own = class_keys(sets, role)[0]
            sends = np.zeros(len(own), bool)
            sends[np.unique(own, return_index=True)[1]] = True  # equal sets are one
            own = own & np.uint64(mask)
            found = []
            for number, (low, high, segments) in enumerate(tiers):
                native = sends & (sets.size >= low) & (sets.size < high)
                visitor = sends & (sets.size >= high) & (threshold * sets.size <= high - 1 + 1e-9)
                if not (native | visitor).any():
                    continue
                small = native & (np.ceil(threshold * sets.size - 1e-9) >= 2) if high == boundary + 1 else None
                of, key, place, size, parity, rank = entries(sets, native | visitor, number, segments, level.value, threshold, small)
                at, key, side = split_hot(key, own[of], rank, hot)
                of = of[at]
                bits = (role & 3) | visitor.astype(np.int64) << 2 | (small.astype(np.int64) << 5 if small is not None else 0)
                found.append((key, own[of], size[at], place[at], parity[at], bits[of] | side << 3))
            if not found:
                continue
            columns = [np.concatenate(x) for x in zip(*found, strict=True)]
            if not len(columns[0]):
                continue
            order = np.argsort(columns[0])
            columns = [c[order] for c in columns]
            part = ((columns[0] >> np.uint64(32)) * np.uint64(len(parts)) >> np.uint64(32)).astype(np.int64)
            columns[0] = columns[0] & np.uint64(0xFFFFFFFF)
            widths, rows = packed(columns)
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])).tolist()
            numbers = [parts[part[a]] for a in edges[:-1]]
            blobs = [widths + rows[:, a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    return run


def similar_candidates(data: list[np.ndarray], threshold: float, boundary: int, across: bool, block: int = BLOCK, held: int = PAIRS_HELD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of classes that share a key at allowed places, have segments of allowed sizes and pass the parities; some more than once."""
    key, own, size, place, parity, flags = data
    size, place, flags = size.astype(np.int64), place.astype(np.int64), flags.astype(np.int64)
    # a list is what one key, and with roles one role, has; by size in it
    role = flags & 1 if across else np.zeros(len(key), np.int64)
    if len(key) and int(size.max()) < 1 << 15 and int(key.max()) < 1 << 32:  # as one number; of the class what has room
        order = np.argsort(key << np.uint64(32) | role.astype(np.uint64) << np.uint64(31) | size.astype(np.uint64) << np.uint64(16) | own & np.uint64(0xFFFF))
    else:
        order = np.lexsort((own, size, role, key))
    key, own, size, place, parity, flags, role = (x[order] for x in (key, own, size, place, parity, flags, role))
    if len(key):  # an entry of a class once
        fresh = np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in (key, own, flags, size, place, parity)])])
        key, own, size, place, parity, flags, role = (x[fresh] for x in (key, own, size, place, parity, flags, role))
    number = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)])) if len(key) else np.zeros(0, np.int64)
    single = (key & np.uint64(1)) == 0
    index = np.flatnonzero(place <= size - needed(size, size, threshold))
    where = (2 * number[index] + role[index]) << 32 | size[index]
    share = threshold / (1 + threshold)
    mine = (2 * number + (1 - role if across else 0)) << 32
    low = np.ceil(threshold * size - 1e-9).astype(np.int64)
    high = np.minimum(size, np.floor((size - place) / share + 1e-9).astype(np.int64) - size)
    begin = np.searchsorted(where, mine | low, "left")
    hits = np.where(high >= low, np.searchsorted(where, mine | np.maximum(high, 0), "right") - begin, 0)
    some = np.flatnonzero(hits > 0)
    if boundary:  # small sets meet each other by pairs of shingles only
        some = some[~single[some] | (flags[some] & 32 == 0)]
    begin, hits = begin[some], hits[some]
    upto = np.cumsum(hits)
    # edits allowed less those before the place, in sixteenths, rounded up: the sum of two is what may still differ
    room = np.ceil(16 * ((1 - 2 * share) * size - place) + 1e-6).astype(np.int16 if not len(size) or int(size.max()) < 1000 else np.int32)
    i_room, i_parity, p_room, p_parity = room[index], parity[index], room[some], parity[some]
    at, found, count = 0, [], 0
    while at < len(some):
        done = upto[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, done + block, "right")))
        for here, runs in _steps(begin[at:stop], hits[at:stop], block):
            differ = np.bitwise_count(i_parity[here] ^ np.repeat(p_parity[at:stop], runs)).astype(room.dtype)
            keep = np.flatnonzero(differ << 4 <= i_room[here] + np.repeat(p_room[at:stop], runs))
            if not len(keep):
                continue
            x, y = index[here[keep]], np.repeat(some[at:stop], runs)[keep]
            both = size[x] + size[y]
            a, b, f, g = own[x], own[y], flags[x], flags[y]
            ok = (a != b) & (needed(size[x], size[y], threshold) <= size[x] - place[x]) & ((size[x] < size[y]) | (a < b) | across)
            ok &= (place[x] + place[y] <= both - 2 * needed(size[x], size[y], threshold)) & (f & g & 4 == 0)
            ok &= (f & 24 != g & 24) | (f & 24 == 0)
            found.append(np.stack([np.minimum(a[ok], b[ok]), np.maximum(a[ok], b[ok])]))
            count += found[-1].shape[1]
        at = stop
        if count > held:
            found = [_distinct_pairs(found)]
            count = found[0].shape[1]
            if count > held // 2:
                yield found[0][0], found[0][1]
                found, count = [], 0
    if count:
        a, b = _distinct_pairs(found)
        yield a, b


def _distinct_pairs(found: list[np.ndarray]) -> np.ndarray:
    pairs = np.concatenate(found, axis=1)
    pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
    fresh = np.ones(pairs.shape[1], bool)
    fresh[1:] = (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)
    return pairs[:, fresh]


def _steps(begin: np.ndarray, hits: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The entries of all hits in order, and how many belong to each probe; at most ``block`` even for one long list."""
    if len(hits) == 1 and hits[0] > block:
        for at in range(0, int(hits[0]), block):
            n = min(block, int(hits[0]) - at)
            yield begin[0] + at + np.arange(n), np.array([n])
        return
    shift = (begin - (np.cumsum(hits) - hits)).astype(np.int32)
    here = np.repeat(shift, hits)
    here += np.arange(len(here), dtype=np.int32)
    yield here, hits


def _third_pass(threshold: float, boundary: int, across: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [x for batch in batches for x in batch.column("blob").to_pylist()]
        if blobs:
            data = unpacked(blobs, len(_COLUMNS))
            blobs.clear()
            for a, b in similar_candidates(data, threshold, boundary, across):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return run


def _map_filter(threshold: float):
    """Pairs of classes whose parity maps allow the similarity; of a class that two sets share the number, any may."""
    share = threshold / (1 + threshold)

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = (left.column(c).to_numpy() for c in "ab")
        names = right.column("own").to_numpy()
        rows = np.frombuffer(b"".join(right.column("map").to_pylist()), np.uint64).reshape(-1, 1 + MAP_WORDS)
        order = np.argsort(names, kind="stable")
        names, size, maps = names[order], rows[order, 0].astype(np.int64), rows[order, 1:]
        doubled = np.concatenate([names[1:] == names[:-1], [False]]) | np.concatenate([[False], names[1:] == names[:-1]])
        keep = np.zeros(len(a), bool)
        for at in range(0, len(a), 1 << 16):
            x, y = (np.searchsorted(names, v[at : at + (1 << 16)]) for v in (a, b))
            both = size[x] + size[y]
            differ = np.bitwise_count(maps[x] ^ maps[y]).sum(axis=1, dtype=np.int64)
            keep[at : at + (1 << 16)] = (differ <= both - 2 * np.ceil(share * both - 1e-9)) | doubled[x] | doubled[y]
        return left.select(["a", "b"]).filter(pa.array(keep))

    return run


def _labels_of_partitions(spark, parts: int) -> list[int]:
    """For each of ``parts`` shuffle partitions a number that Spark's hash sends there."""
    found: dict[int, int] = {}
    width = 64 * parts
    while len(found) < parts:
        rows = spark.range(width).select(F.col("id").cast("int").alias("i"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("p")).groupBy("p").agg(F.min("i").alias("i")).collect()
        found = {r.p: r.i for r in rows}
        width *= 4
    return [found[p] for p in range(parts)]


def pack(shingle: np.ndarray) -> bytes:
    """The upper 40 bits of each shingle's hash, five bytes each."""
    top = shingle >> np.uint64(24)
    return (top & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (top >> np.uint64(32)).astype(np.uint8).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    n = len(blob) // 5
    return np.frombuffer(blob, np.uint32, n).astype(np.int64) | (np.frombuffer(blob, np.uint8, n, 4 * n).astype(np.int64) << 32)


def _packed_sets(k: int, min_words: int, level):
    """The shingles of each text, packed in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = len(level.value).bit_length() - 1
        for batch in _cut(batches):
            sets = Sets(batch.column("text"), k, min_words)
            rank = level.value[counter_of(sets.shingle, bits)]
            shingle = sets.shingle[sets.order(rank)]
            ends = np.append(sets.start, len(shingle))
            blobs = [pack(shingle[ends[i] : ends[i + 1]]) for i in range(len(sets.start))]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(sets.rows)), pa.array(blobs, pa.binary())], ["id", "set"])

    return run


def common_shingles(one: list[np.ndarray], two: list[np.ndarray], block: int = 256) -> np.ndarray:
    """How many shingles each pair of sets has in common: sorted together, they stand twice."""
    out = np.zeros(len(one), np.int64)
    for at in range(0, len(one), block):
        parts = [x for pair in zip(one[at : at + block], two[at : at + block], strict=True) for x in pair]
        pair = np.repeat(np.arange(len(parts)) // 2, [len(x) for x in parts])
        both = np.sort(pair << 40 | np.concatenate(parts))
        twice = both[1:][both[1:] == both[:-1]] >> 40
        out[at : at + block] = np.bincount(twice, minlength=len(parts) // 2)
    return out


def _compare(one: list[np.ndarray], two: list[np.ndarray], how, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common shingles, sum of sizes, and whether that is enough."""
    both = np.array([len(x) + len(y) for x, y in zip(one, two, strict=True)], np.int64)
    common = how(one, two) if len(one) else np.zeros(0, np.int64)
    return common, both, common >= threshold * (both - common) - 1e-9


def _by_blocks(items: DataFrame, name: str, pairs: DataFrame, blocks: int):
    """Items, and pairs ``(a, b)`` of their names, grouped by pairs of blocks of names: an item goes once to each pair of blocks."""
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    key = lambda x, y: F.least(x, y) * blocks + F.greatest(x, y)
    every = items.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("key", key(block(name), F.col("other"))).drop("other")
    return every.groupBy("key"), pairs.select(key(block("a"), block("b")).alias("key"), "a", "b").groupBy("key")


class SimilarSets:
    """The parts of a similarity join over ``(id, text[, role])``.

    ``links``: similar pairs of representatives ``(a, b, common, both)``, a below b: shingles in common and sum of the sizes.
    ``members``: ``(id, role, rep, n)`` of the classes of equal sets with more than one id; ``rep`` is the smallest id.
    With roles (any two numbers), only pairs of different roles are linked and classes are of one role.
    ``candidates`` keeps what came before the exact comparison.
    """

    def __init__(
        self, df: DataFrame, id_col: str, text_col: str, k: int = 5, threshold: float = 0.8, min_words: int = 1, role_col: str | None = None, boundary: int | None = None, parts: int | None = None, hot: int = HOT
    ):
        if not 0 < threshold <= 1:
            raise ValueError("the threshold must be above 0 and at most 1")
        spark = df.sparkSession
        role = F.col(role_col).cast("int") if role_col else F.lit(0)
        rows = df.select(F.col(id_col).cast("bigint").alias("id"), role.alias("role"), F.col(text_col).alias("text")).where("id is not null and text is not null and role is not null")
        self.rows, self.k, self.min_words, self.threshold = rows, k, min_words, threshold
        words = rows.select("id", "role", "text")
        length = words.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
        bits = min(SKETCH_MOST, max(SKETCH_LEAST, math.ceil(math.log2(length / SKETCH_BYTES + 1))))
        first = staged(words.mapInArrow(_first_pass(k, min_words, bits), "kind int, a bigint, b bigint, c bigint, role int, blob binary"), "first")
        counted = first.where("kind <> 1").groupBy("kind", F.when(F.col("kind") == 2, F.col("a")).alias("a")).agg(F.sum("b").alias("n"), F.max("b").alias("task")).collect()
        sizes = {r.a: r.n for r in counted if r.kind == 2}
        # the counters of all tasks, added in a tree; at most 2^25 levels of a byte
        width = math.isqrt(max([0, *(r.task for r in counted if r.kind == 0)])) + 1
        added = first.where("kind = 0").select("a", "b", "blob").repartition("a", F.pmod("b", F.lit(width))).select("a", "blob").mapInArrow(_added(False), "a bigint, blob binary")
        added = added.repartition("a").mapInArrow(_added(True), "a bigint, blob binary")
        level = np.zeros(1 << bits, np.int8)
        for row in added.collect():
            level[row.a : row.a + SKETCH_PART] = np.frombuffer(row.blob, np.int8)
        if boundary is None:
            counts = np.sort(level_count(level[level > 0]))
            mass = np.cumsum(counts)
            rare = counts[np.searchsorted(mass, mass[-1] / 6)] if len(counts) else 0.0
            boundary = small_boundary(sizes, float(rare), threshold)
        self.boundary, self.sets = boundary, sum(sizes.values())
        tiers = size_tiers(sizes, threshold, boundary)
        expected = sum(n * (s * (1 - threshold) + next((m for low, high, m in tiers if low <= s < high), 1)) for s, n in sizes.items())
        labels = _labels_of_partitions(spark, parts or max(4, math.ceil(expected / ENTRIES_A_PART)))
        shared = self.level = spark.sparkContext.broadcast(level)
        across = role_col is not None
        # classes by as many bits as tell nearly all apart; where two share a number, both are looked at
        mask = (1 << min(64, 8 * math.ceil((math.log2(self.sets + 1) + 10) / 8))) - 1
        sent = words.mapInArrow(_second_pass(k, min_words, threshold, tiers, boundary, mask, shared, labels, hot), "part int, blob binary")
        found = sent.repartition(len(labels), "part").mapInArrow(_third_pass(threshold, boundary, across), "a bigint, b bigint")
        pairs = staged(found.distinct(), "pairs")
        # a pair of class numbers is kept if the parity maps allow it, and stands for the classes that have these numbers
        signed = mask - (1 << 64) if mask >> 63 else mask
        rows = first.where("kind = 1").select(F.col("a").alias("id"), F.col("b").alias("k1"), F.col("c").alias("k2"), "role", F.col("b").bitwiseAND(F.lit(signed).cast("bigint")).alias("own"), F.col("blob").alias("map"))
        keyed = rows.select("id", "k1", "k2", "role", "own").distinct()
        classes = staged(keyed.groupBy("k1", "k2", "role", "own").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")
        blocks = max(2, math.ceil(self.sets / MAPS_A_BLOCK))
        maps, near = _by_blocks(rows.select("own", "map").distinct(), "own", pairs, blocks)
        near = near.cogroup(maps).applyInArrow(_map_filter(threshold), "a bigint, b bigint")
        rep = classes.select("own", "rep")
        near = near.join(rep.select(F.col("own").alias("a"), F.col("rep").alias("x")), "a").join(rep.select(F.col("own").alias("b"), F.col("rep").alias("y")), "b")
        self.candidates = staged(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "candidates")
        self.members = keyed.join(classes.where("n > 1").select("k1", "k2", "role", "rep", "n"), ["k1", "k2", "role"]).select("id", "role", "rep", "n")

    def links(self, how=common_shingles) -> DataFrame:
        """The candidates that are similar, their sets made once more from the texts of the ids in them only.

        The ids fall into blocks; a set goes once to each pair of blocks and is compared there with all it
        has to be. Where that would ship more than the pairs with their sets, pairs and sets are joined.
        """
        pairs, threshold = self.candidates, self.threshold
        ids = staged(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
        n_ids, n_pairs = ids.count(), pairs.count()
        wanted = F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids
        words = self.rows.join(wanted, "id", "left_semi").select("id", "text")
        sets = words.mapInArrow(_packed_sets(self.k, self.min_words, self.level), "id bigint, set binary")
        schema = "a bigint, b bigint, common int, both int"

        def result(a, b, one, two) -> pa.RecordBatch:
            common, both, enough = _compare(one, two, how, threshold)
            at = np.flatnonzero(enough)
            columns = [pa.array(np.asarray(x)[at].astype(t)) for x, t in ((a, np.int64), (b, np.int64), (common, np.int32), (both, np.int32))]
            return pa.RecordBatch.from_arrays(columns, ["a", "b", "common", "both"])

        blocks = max(2, -(-n_ids // SETS_A_BLOCK), math.isqrt(n_pairs // PAIRS_A_BLOCK))
        if blocks * n_ids > 2 * n_pairs:
            sets = sets.groupBy("id").agg(F.min("set").alias("set"))
            one, two = (sets.select(F.col("id").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")

            def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    a, b, one, two = (batch.column(c).to_pylist() for c in ("a", "b", "set_a", "set_b"))
                    yield result(a, b, [unpack(x) for x in one], [unpack(x) for x in two])

            return pairs.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b").mapInArrow(joined, schema)

        sets, keyed = _by_blocks(sets, "id", pairs, blocks)

        def compared(_, left: pa.Table, right: pa.Table) -> pa.Table:
            order = {i: unpack(x) for i, x in zip(right.column("id").to_pylist(), right.column("set").to_pylist(), strict=True)}
            a, b = left.column("a").to_pylist(), left.column("b").to_pylist()
            return pa.Table.from_batches([result(a, b, [order[x] for x in a], [order[y] for y in b])])

        return keyed.cogroup(sets).applyInArrow(compared, schema)


def expanded(links: DataFrame, members: DataFrame, most: int | None = COPY_PAIRS) -> DataFrame:
    """Pairs ``(a, b)`` of ids from pairs of representatives: every member of a class for its representative.

    Classes of more than ``most`` equal texts are kept as their representative; their members
    are linked to it, not to all that it is linked to. Without ``most`` all members of all classes come.
    """
    few = members if most is None else members.where(F.col("n") <= most)
    one = few.select(F.col("rep").alias("a"), F.col("id").alias("member_a"))
    two = few.select(F.col("rep").alias("b"), F.col("id").alias("member_b"))
    all_ = links.select("a", "b").join(one, "a", "left").join(two, "b", "left")
    x, y = F.coalesce("member_a", "a"), F.coalesce("member_b", "b")
    return all_.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def copy_pairs(members: DataFrame) -> DataFrame:
    """The pairs within classes of equal texts: all of small classes, those with the representative of large ones."""
    few = members.where(F.col("n") <= COPY_PAIRS)
    inner = few.alias("x").join(few.alias("y"), (F.col("x.rep") == F.col("y.rep")) & (F.col("x.id") < F.col("y.id")))
    stars = members.where((F.col("n") > COPY_PAIRS) & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("a"), F.col("id").alias("b"))
    return inner.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).unionByName(stars)


def near_duplicates(df: DataFrame, id_col: str, text_col: str, k: int = 5, threshold: float = 0.8, min_words: int = 1, boundary: int | None = None, parts: int | None = None, hot: int = HOT) -> DataFrame:
    """All similar pairs ``(a, b)``, a below b, each once.

    Null ids and texts take no part, nor do texts of fewer than ``min_words`` words or none; one of fewer than ``k`` words
    is a single shingle of all of them. Rows that repeat an id are one text (they should be equal). More than
    ``COPY_PAIRS`` equal texts are listed as pairs with their smallest id, which stands for them in the pairs with others.
    ``boundary``, ``parts`` and ``hot`` set what is chosen by cost or size otherwise; they change the work, not the pairs.
    """
    join = SimilarSets(df, id_col, text_col, k, threshold, min_words, boundary=boundary, parts=parts, hot=hot)
    return expanded(join.links(), join.members).unionByName(copy_pairs(join.members))


def duplicate_groups(df: DataFrame, id_col: str, text_col: str, k: int = 5, threshold: float = 0.8, min_words: int = 1, boundary: int | None = None) -> DataFrame:
    """A row for each id: ``(id, group_id, rep, links)``.

    ``rep`` is the smallest id of the texts with an equal set, ``group_id`` the smallest id connected by similar pairs,
    and ``links`` the number of other classes that its class is similar to plus the other members of its class. An id
    without a near-duplicate, without text or with fewer than ``min_words`` words is a group of its own with 0 links. Null ids give no row.
    """
    join = SimilarSets(df, id_col, text_col, k, threshold, min_words, boundary=boundary)
    links, members = staged(join.links().select("a", "b"), "links"), staged(join.members, "members")
    text = links.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))
    comps = connected_groups(text, ["a", "b"], kinds=["d", "d"])
    nodes = comps.select(F.explode(F.array("a", "b")).alias("rep"), "component").select(F.col("rep").cast("bigint").alias("rep"), "component").distinct()
    groups = nodes.groupBy("component").agg(F.min("rep").alias("group_id"))
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("d"))
    of = nodes.join(groups, "component").join(degree, "rep").select("rep", "group_id", "d")
    ids = df.select(F.col(id_col).cast("bigint").alias("id")).where("id is not null").distinct()
    own = ids.join(members.select("id", "rep", "n"), "id", "left").withColumn("rep", F.coalesce("rep", "id")).join(of, "rep", "left")
    return own.select("id", F.coalesce("group_id", "rep").alias("group_id"), "rep", (F.coalesce("d", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).alias("links"))


def p3_found(spark, sf_dir: str) -> DataFrame:
    """Pairs of chunks of at least 12 words with half of their three-word sequences in common."""
    pairs = near_duplicates(table(spark, sf_dir, "chunks"), "chunk_id", "text", k=3, threshold=0.5, min_words=12)
    return pairs.select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p3_groups(spark, sf_dir: str) -> DataFrame:
    """The group, class and number of links of every chunk, by five-word sequences and similarity 0.8."""
    return duplicate_groups(table(spark, sf_dir, "chunks"), "chunk_id", "text")


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}

PAIRS_SQL = r"""
word AS (
  SELECT chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM (SELECT chunk_id, max(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY chunk_id)),
shingle AS (
  SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM word WHERE len(w) >= 12),
size AS (SELECT chunk_id, count(*) AS n FROM shingle GROUP BY chunk_id),
common AS (
  SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b, count(*) AS o FROM shingle a JOIN shingle b ON a.s = b.s AND a.chunk_id < b.chunk_id GROUP BY ALL),
pair AS (
  SELECT chunk_id_a, chunk_id_b FROM common JOIN size x ON x.chunk_id = chunk_id_a JOIN size y ON y.chunk_id = chunk_id_b WHERE 2 * o >= x.n + y.n - o)"""
#: Texts of the same shingles are one class; components by the smallest id that spreads along the pairs.
GROUPS_SQL = r"""
WITH RECURSIVE word AS (
  SELECT chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM (SELECT chunk_id, max(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY chunk_id)),
shingle AS (
  SELECT DISTINCT chunk_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM word WHERE len(w) >= 1),
class AS (SELECT chunk_id, min(chunk_id) OVER (PARTITION BY s) AS rep, count(*) OVER (PARTITION BY s) AS n, len(s) AS size FROM (SELECT chunk_id, list_sort(list(s)) AS s FROM shingle GROUP BY chunk_id)),
own AS (SELECT shingle.* FROM shingle JOIN class USING (chunk_id) WHERE chunk_id = rep),
common AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS o FROM own a JOIN own b ON a.s = b.s AND a.chunk_id < b.chunk_id GROUP BY ALL),
pair AS (SELECT a, b FROM common JOIN class x ON x.chunk_id = a JOIN class y ON y.chunk_id = b WHERE 5 * o >= 4 * (x.size + y.size - o)),
edge AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach AS (SELECT DISTINCT a, a AS low FROM edge UNION SELECT edge.b, reach.low FROM reach JOIN edge ON edge.a = reach.a WHERE reach.low < edge.b),
part AS (SELECT a AS rep, min(low) AS group_id FROM reach GROUP BY a),
degree AS (SELECT a AS rep, count(*) AS d FROM edge GROUP BY a)
SELECT id, coalesce(part.group_id, class.rep, id) AS group_id, coalesce(class.rep, id) AS rep, coalesce(d, 0) + coalesce(n, 1) - 1 AS links
FROM (SELECT DISTINCT chunk_id AS id FROM chunks) LEFT JOIN class ON class.chunk_id = id LEFT JOIN part USING (rep) LEFT JOIN degree USING (rep)"""
SQL = {"p3_found": f"WITH {PAIRS_SQL} SELECT chunk_id_a, chunk_id_b FROM pair", "p3_groups": GROUPS_SQL}
