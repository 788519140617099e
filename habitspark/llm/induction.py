"""Induced sorting of all suffixes of a shard, with common-prefix lengths, over queues that spill to disk.

A suffix is of type S if it is smaller than the one that begins a byte later, else of type L; an S suffix after an L suffix
is a star. Stars are sorted first: the strings from star to star are named by rank, and if names repeat, the string
of names is sorted by the same procedure, until it is short enough to be sorted in memory by doubling. Sorted stars then induce the L suffixes, and these the S suffixes: whatever leaves the
queue puts the suffix that begins one place earlier into it, keyed by its first symbol. The queue keeps entries
of equal key in the order of arrival, which is their order as suffixes.

Work goes in batches: entries up to the smallest key that the batch itself pushes are safe to take together. Where
common prefixes are wanted, each entry carries the length shared with the entry before it of the same key: one more than
the least such length between the two entries that pushed them, so it needs no look at the text. Lengths are capped.
"""

from __future__ import annotations

import tempfile

import numpy as np

QUEUE_BYTES = 8 << 20  # entries beyond that many bytes wait on disk
MEMORY_NAMES = 1 << 21  # strings of at most so many names are sorted in memory
RANGES = 256  # key ranges of a queue
BATCH = 1 << 17
NEVER = np.iinfo(np.int32).max

FIELDS = (np.int32, np.int32, np.int16)  # key, position, common prefix with the entry before of equal key


class Queue:
    """Entries by key, first in first out within a key; key ranges beyond the memory limit lie in one temporary file."""

    def __init__(self, keys: int, limit: int):
        self.width = -(-keys // RANGES)
        self.rows: list[list] = [[] for _ in range(-(-keys // self.width))]
        self.limit, self.held, self.file = limit, 0, None

    def push(self, key: np.ndarray, *rest: np.ndarray) -> None:
        if not len(key):
            return
        part = key // self.width
        order = np.argsort(part, kind="stable")
        part = part[order]
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        columns = [c[order].astype(t, copy=False) for c, t in zip((key, *rest), FIELDS)]
        for a, b in zip(cuts, np.r_[cuts[1:], len(key)]):
            self.rows[part[a]].append(tuple(c[a:b] for c in columns))
        self.held += 10 * len(key)
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for entries in self.rows:
            fresh = [e for e in entries if len(e) > 1]
            if fresh:
                at, n = self.file.tell(), sum(len(e[0]) for e in fresh)
                for column in zip(*fresh):
                    self.file.write(np.concatenate(column).tobytes())
                entries[:] = [e for e in entries if len(e) == 1] + [((at, n),)]
        self.held = 0

    def take(self, part: int) -> list[np.ndarray]:
        """All entries of a key range, by key and arrival."""
        blocks = [[] for _ in FIELDS]
        for entry in self.rows[part]:
            if len(entry) == 1:
                at, n = entry[0]
                self.file.seek(at)
                entry = tuple(np.frombuffer(self.file.read(n * np.dtype(t).itemsize), t) for t in FIELDS)
            else:
                self.held -= 10 * len(entry[0])
            for block, column in zip(blocks, entry):
                block.append(column)
        self.rows[part] = []
        columns = [np.concatenate(b) if b else np.zeros(0, t) for b, t in zip(blocks, FIELDS)]
        order = np.argsort(columns[0], kind="stable")
        return [c[order] for c in columns]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _Lowest:
    """Least common prefix between the pushes of equal symbol, from batch to batch."""

    def __init__(self, symbols: int, cap: int):
        self.carry = np.full(symbols, -1, np.int16)
        self.cap = cap

    def between(self, low: np.ndarray, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Common prefixes of the suffixes pushed at positions ``at`` of the batch, whose lengths are ``low``."""
        order = np.argsort(symbol, kind="stable")
        at, symbol = at[order], symbol[order]
        table = [low]
        while 2 << (len(table) - 1) <= len(low):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        fresh = np.r_[True, symbol[1:] != symbol[:-1]]
        start = np.where(fresh, 0, np.r_[0, at[:-1]] + 1)
        level = np.frexp((at - start + 1).astype(np.float64))[1] - 1
        least = np.empty(len(at), np.int16)
        for k in np.unique(level).tolist():
            s = level == k
            least[s] = np.minimum(table[k][start[s]], table[k][at[s] - (1 << k) + 1])
        least[fresh] = np.minimum(least[fresh], self.carry[symbol[fresh]])
        last = np.r_[fresh[1:], True]
        after = np.r_[np.minimum.accumulate(low[::-1])[::-1], np.int16(self.cap)]
        self.carry = np.minimum(self.carry, after[0])
        self.carry[symbol[last]] = after[at[last] + 1]
        out = np.empty(len(at), np.int16)
        out[order] = np.minimum(least + 1, self.cap)
        return out

    def skip(self, low: np.ndarray) -> None:
        if len(low):
            self.carry = np.minimum(self.carry, low.min())


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is of type S; the last symbol is the only smallest one."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int64)))
    decides = np.where(step != 0, np.arange(n - 1), n)
    decides = np.minimum.accumulate(decides[::-1])[::-1]
    return np.r_[step[decides] > 0, True] if n > 1 else np.ones(1, bool)


def _names(text: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """Dense rank of the string from each star to the next, both included; the longer of two is smaller if it goes on."""
    bits = 8 if text.dtype == np.uint8 else 32
    per = 64 // bits
    ends = np.r_[stars[1:] + 1, len(text)]
    padded = np.r_[text, np.zeros(per, text.dtype)]
    most = np.uint64((1 << bits) - 1)

    def chunk(which: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(which), np.uint64)
        for j in range(per):
            at = stars[which] + k * per + j
            inside = at < ends[which]
            out = (out << np.uint64(bits)) | np.where(inside, padded[np.where(inside, at, 0)].astype(np.uint64), most)
        return out

    live = np.arange(len(stars))
    rank = np.zeros(len(stars), np.int64)
    k = 0
    while len(live):
        piece = chunk(live, k)
        order = np.lexsort((piece, rank[live]))
        live, piece = live[order], piece[order]
        group = rank[live]
        head = np.r_[True, group[1:] != group[:-1]]
        fresh = head | np.r_[True, piece[1:] != piece[:-1]]
        place = np.arange(len(live))
        starts = np.maximum.accumulate(np.where(fresh, place, 0))
        rank[live] = group + starts - np.maximum.accumulate(np.where(head, place, 0))
        k += 1
        # strings that are equal so far and go on
        size = np.diff(np.r_[np.flatnonzero(fresh), len(live)])
        block = np.cumsum(fresh) - 1
        more = np.bincount(block, weights=(ends[live] - stars[live] > k * per).astype(np.float64)) > 0
        live = live[((size > 1) & more)[block]]
    return np.unique(rank, return_inverse=True)[1].astype(np.int32)


def _induce(text: np.ndarray, wanted: np.ndarray, seeds: np.ndarray, limit: int, low: np.ndarray | None, cap: int, seam) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes ``wanted`` from the ordered ``seeds``; with ``low``, also their common prefixes."""
    symbols = int(text.max()) + 1
    queue = Queue(2 * symbols, limit)
    shared = None if low is None else _Lowest(symbols, cap)
    queue.push(2 * text[seeds].astype(np.int32) + 1, seeds, np.zeros(len(seeds), np.int16) if low is None else low)
    found, lengths = [], []
    last_key, last_pos = -1, -1
    ahead = BATCH
    for part in range(len(queue.rows)):
        edge = (part + 1) * queue.width
        key, pos, common = queue.take(part)
        later: list[tuple] = []
        while len(key):
            before = pos[:ahead] - 1  # an entry at 0 looks at the last symbol, which nothing pushes
            target = np.where(wanted[before], 2 * text[before].astype(np.int32), NEVER)
            # an entry may go if none before it pushes a smaller key
            least = np.minimum.accumulate(target)
            stop = key[1 : len(target)] > least[:-1]
            safe = int(stop.argmax()) + 1 if stop.any() else len(target)
            ahead = min(BATCH, max(256, 2 * safe))
            k, p, c = key[:safe], pos[:safe], common[:safe]
            at = np.flatnonzero(target[:safe] != NEVER)
            new = (target[at], before[at])
            if shared is not None:
                c = c.copy()
                changed = np.flatnonzero(np.r_[k[0] != last_key, k[1:] != k[:-1]])
                for i in changed.tolist():
                    was, prior = (last_key, last_pos) if i == 0 else (k[i - 1], p[i - 1])
                    c[i] = seam(prior, p[i]) if was >= 0 and was // 2 == k[i] // 2 else 0
            if shared is not None and len(at):
                new = (*new, shared.between(c, at, new[0] // 2))
            else:
                new = (*new, np.zeros(len(at), np.int16))
                if shared is not None:
                    shared.skip(c)
            out = k % 2 == 0
            found.append(p[out])
            lengths.append(c[out])
            last_key, last_pos = int(k[-1]), int(p[-1])
            key, pos, common = key[safe:], pos[safe:], common[safe:]
            here = new[0] < edge
            if here.any():
                later.append(tuple(x[~here] for x in new))
                order = np.argsort(new[0][here], kind="stable")
                new = tuple(x[here][order] for x in new)
                place = np.searchsorted(key, new[0], "right")
                key, pos, common = (np.insert(x, place, y) for x, y in zip((key, pos, common), new))
            else:
                later.append(new)
        if later:
            queue.push(*[np.concatenate(c) for c in zip(*later)])
    queue.close()
    return np.concatenate(found), np.concatenate(lengths)


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffixes in order, by ranks of strings of doubling length; only groups of equal rank are sorted again."""
    n = len(names)
    live = np.argsort(names, kind="stable")
    rank = np.zeros(n, np.int64)
    head = np.r_[True, np.diff(names[live]) != 0]
    rank[live] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    length = 1
    while len(live):
        size = np.diff(np.r_[np.flatnonzero(head), len(live)])
        live = live[np.repeat(size > 1, size)]
        if not len(live):
            break
        group = rank[live]
        pair = group * n + rank[live + length]  # equal so far, so neither has reached the last symbol
        order = np.argsort(pair, kind="stable")
        live, group, pair = live[order], group[order], pair[order]
        head = np.r_[True, pair[1:] != pair[:-1]]
        first = np.r_[True, group[1:] != group[:-1]]
        place = np.arange(len(live))
        rank[live] = group + np.maximum.accumulate(np.where(head, place, 0)) - np.maximum.accumulate(np.where(first, place, 0))
        length *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def _stars_in_order(text: np.ndarray, types: np.ndarray, limit: int, memory: int) -> np.ndarray:
    stars = np.flatnonzero(types & np.r_[False, ~types[:-1]])
    names = _names(text, stars)
    if names.max() + 1 == len(stars):
        return stars[np.argsort(names)]
    return stars[_doubled(names) if len(names) <= memory else suffix_array(names, limit, memory)]


def _sorted(text: np.ndarray, limit: int, memory: int, cap: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """L suffixes ascending and S suffixes descending, with the common prefixes of neighbours."""
    types = _types(text)
    stars = _stars_in_order(text, types, limit, memory)
    seam, low = None, None
    if cap:
        words = _words(text, cap)
        seam = lambda a, b: common_prefixes(words, np.array([a]), np.array([b]), cap)[0]
        low = np.r_[np.int16(0), common_prefixes(words, stars[:-1], stars[1:], cap)]
    larger, shared = _induce(text, ~types, stars, limit, low, cap, seam)
    turned = (text.max() - text).astype(text.dtype)
    types[-1] = False
    back = np.r_[np.zeros(1, np.int16), shared[:0:-1]] if len(shared) else shared
    smaller, shared_s = _induce(turned, types, larger[::-1], limit, back if cap else None, cap, seam)
    return larger, shared, smaller, shared_s


def suffix_array(text: np.ndarray, limit: int = QUEUE_BYTES, memory: int = MEMORY_NAMES) -> np.ndarray:
    """Start positions of all suffixes in ascending order; the last symbol must be 0 and the only 0."""
    if len(text) == 1:
        return np.zeros(1, np.int64)
    larger, _, smaller, _ = _sorted(text, limit, memory)
    # the last symbol is a star that no other suffix induces
    both = np.concatenate([larger, smaller[::-1]]).astype(np.int64)
    kind = np.r_[np.zeros(len(larger), np.int64), np.ones(len(smaller), np.int64)]
    order = np.argsort(2 * text[both].astype(np.int64) + kind, kind="stable")
    return np.r_[len(text) - 1, both[order]]


def _words(text: np.ndarray, cap: int) -> np.ndarray:
    """The eight bytes from each position on, as one number."""
    padded = np.r_[text, np.zeros(cap + 16, np.uint8)]
    return np.ndarray((len(padded) - 8,), "<u8", padded, strides=(1,))


def common_prefixes(words: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Length, at most ``cap``, that the suffixes at ``a`` and ``b`` share."""
    out = np.zeros(len(a), np.int16)
    live = np.arange(len(a))
    for k in range(0, cap, 8):
        differ = words[a[live] + k] ^ words[b[live] + k]
        out[live] = np.minimum(k + np.where(differ == 0, 8, np.bitwise_count((differ & -differ) - np.uint64(1)) // 8), cap)
        live = live[differ == 0]
    return out


def repeated_starts(text: np.ndarray, size: int, limit: int = QUEUE_BYTES, memory: int = MEMORY_NAMES) -> np.ndarray:
    """Positions whose first ``size`` bytes also begin at another position; ``text`` ends with its only 0."""
    again = np.zeros(len(text), bool)
    if len(text) <= size:
        return again
    larger, shared, smaller, shared_s = _sorted(text, limit, memory, size)
    for order, low in ((larger, shared), (smaller, shared_s)):
        hit = np.flatnonzero(low >= size)
        again[order[hit]] = True
        again[order[hit - 1]] = True
    # the largest L and the smallest S suffix of a symbol are neighbours as well
    words = _words(text, size)
    top, bottom = _last_of_symbol(text, larger), _last_of_symbol(text, smaller)
    both = np.flatnonzero((top >= 0) & (bottom >= 0))
    hit = both[common_prefixes(words, top[both], bottom[both], size) >= size]
    again[top[hit]] = True
    again[bottom[hit]] = True
    return again


def _last_of_symbol(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Last position in ``order`` for each first symbol, or -1."""
    out = np.full(256, -1, np.int64)
    symbol = text[order]
    ends = np.flatnonzero(np.r_[symbol[1:] != symbol[:-1], True]) if len(order) else order
    out[symbol[ends]] = order[ends]
    return out
