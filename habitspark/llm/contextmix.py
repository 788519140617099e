"""Language-model scores by online logistic context mixing.

A text is its words (bytes 0x20 and 0x09-0x0D separate, A-Z in lower case) and an end token. Exact counts of
all training tokens are gathered from the corpus. Frequent tokens are symbols of their own, the
others share symbols by magnitude of count and ending, and within a symbol a token
has its share of the counts. Unseen tokens are spelled out in bytes. A symbol is a
path of bits in a binary tree.

Every bit is predicted in five contexts: the node alone, and hashed with the previous symbol, with the two previous
ones, with the domain of the text so far (which of a few word distributions fits it best), and with domain and
previous symbol; in spelled words, with the last byte and the domain, and with the last two, three and five bytes. The hashed tables have a fixed
size and hold counts of the whole training corpus. Predictions are mixed in the logistic domain with weights chosen by a gate (depth, kind of symbol, confidence of the
longest context), and an adaptive map refines the result. All training rows set the domains (rounds of expectation and
maximisation as sums over all tasks, begun from a few hundred rows) and the weights and map that every text starts from: shards of
some megabytes are gone through one after another in themselves, with tables counted on the other half of the
rows, and averaged by use. Within each text they learn on, a few hundred symbols at a time. Texts are dealt to halves and shards by a
hash of their id and sums are of whole numbers, so results do not depend on how rows are dealt out.
"""

from __future__ import annotations

import copy
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitspark.llm import words
from habitspark.plans.scale import stored

BLOCK_BYTES = 8 << 20
OWN_SYMBOLS = 4_096
ENDINGS = 16
MAGNITUDES = 40
TABLE_BITS = 19
PAGE_BITS = 12
CALIBRATION_ROWS = 300  # the domains of at most so many training rows, and one in twenty, are where the rounds over all rows begin
DOMAIN_ROUNDS = 3
SHARD_BYTES = 8 << 20
UNIT = 1 << 20  # weights are summed up as whole multiples of its inverse
DOMAINS = 8
ROUND = 256
RATE = 0.2
DEPTHS, LEVELS, BUCKETS, INPUTS = 8, 4, 33, 6
BYTES = 60_000  # symbols of spelled bytes begin here; the byte 0x20 closes a word

END = np.uint64(0xA5A5_5A5A_C3C3_3C3C) & ~np.uint64(ENDINGS - 1)


# --- blocks of texts and exact counts -------------------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows packed into blocks of some megabytes of text, compressed."""
    part, made = TaskContext.get().partitionId(), 0
    for batch in batches:
        _, offsets = words.text_bytes(batch.column(2))
        at, n = 0, batch.num_rows
        while at < n:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch.slice(at, end - at))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | made], pa.int64()), pa.array([int(offsets[end] - offsets[at])], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                ["block", "size", "payload"],
            )
            made += 1
            at = end


def _opened(payload: pa.Buffer) -> pa.RecordBatch:
    return pa.ipc.open_stream(payload).read_next_batch()


def _keys(w: words.Words) -> np.ndarray:
    """Token keys: a word hash whose lowest bits tell the ending (last two bytes)."""
    h = w.hashes()
    last = w.data[w.ends - 1].astype(np.uint64) if len(h) else h
    before = np.where(w.ends - w.starts > 1, w.data[w.ends - 2], 0).astype(np.uint64) if len(h) else h
    ending = words.mix(last << np.uint64(8) | before) % np.uint64(ENDINGS)
    return (h & ~np.uint64(ENDINGS - 1)) | ending


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list]:
    """All tokens of a block: keys, index of the first token of each text, and where they are spelled."""
    keys, first, spans = [], [0], []
    for _, w in words.slices(batch.column(2)):
        k = _keys(w)
        n = len(w.first) - 1
        place = np.arange(len(k)) + np.searchsorted(w.first[1:], np.arange(len(k)), "right")
        row = np.full(len(k) + n, END)
        row[place] = k
        keys.append(row)
        span = np.zeros((len(row), 2), np.int64)
        span[place, 0], span[place, 1] = w.starts, w.ends
        spans.append((w.data, span))
        first.extend((first[-1] + w.first[1:] + np.arange(1, n + 1)).tolist())
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64), np.array(first), spans


def _requests(buckets: int):
    """Distinct tokens of a block with their training counts, dealt out by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for block, payload in zip(part.column(0).to_pylist(), part.column(1)):
                batch = _opened(payload.as_buffer())
                keys, first, _ = _tokens(batch)
                train = np.repeat(np.array(batch.column(1).to_pylist(), bool), np.diff(first))
                uniq, back = np.unique(keys, return_inverse=True)
                count = np.bincount(back, weights=train, minlength=len(uniq)).astype(np.uint32)
                bucket = (uniq >> np.uint64(32)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                used = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used.astype(np.int64)), pa.array(np.full(len(used), block), pa.int64()),
                        pa.array([uniq[order[cuts[b] : cuts[b + 1]]].tobytes() for b in used], pa.binary()),
                        pa.array([count[order[cuts[b] : cuts[b + 1]]].tobytes() for b in used], pa.binary()),
                    ],
                    ["bucket", "block", "keys", "counts"],
                )

    return run


def _group_of(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Magnitude of the count and ending of rarer tokens, as one number."""
    level = np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64)
    return np.minimum(level, MAGNITUDES - 1) * ENDINGS + (keys % np.uint64(ENDINGS)).astype(np.int64)


def _totals(table: pa.Table) -> pa.Table:
    """Corpus counts of every token of a bucket, sent back block by block; and a summary (block null)."""
    keys = [np.frombuffer(k, np.uint64) for k in table["keys"].to_pylist()]
    counts = [np.frombuffer(c, np.uint32) for c in table["counts"].to_pylist()]
    uniq, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)
    replies, at = [], 0
    for k in keys:
        replies.append(total[back[at : at + len(k)]].tobytes())
        at += len(k)
    seen = total > 0
    uniq, total = uniq[seen], total[seen]
    top = np.lexsort((uniq, -total))[:OWN_SYMBOLS]
    group = _group_of(uniq, total)
    size = MAGNITUDES * ENDINGS
    summary = np.concatenate([np.bincount(group, minlength=size), np.bincount(group, weights=total, minlength=size)]).astype(np.int64)
    n = len(keys)
    bucket = table["bucket"][0].as_py()
    return pa.table(
        {
            "block": pa.concat_arrays([table["block"].combine_chunks(), pa.nulls(1, pa.int64())]),
            "bucket": pa.array([bucket] * (n + 1), pa.int64()),
            "counts": pa.array([*replies, summary.tobytes()], pa.binary()),
            "top_keys": pa.array([None] * n + [uniq[top].tobytes()], pa.binary()),
            "top_counts": pa.array([None] * n + [total[top].tobytes()], pa.binary()),
        }
    )


# --- symbols --------------------------------------------------------------------------------


class Alphabet:
    """Symbols: own ones of frequent tokens, groups of rarer ones, and one for all unseen."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, groups: np.ndarray, masses: np.ndarray, tokens: int, types: int):
        order = np.argsort(keys)
        self.keys, self.own_counts = keys[order], counts[order]
        self.masses = masses.astype(float)  # training tokens by group, own symbols left out
        self.tokens, self.types = tokens, types
        self.group_base = len(keys)
        self.unseen_base = self.group_base + MAGNITUDES * ENDINGS
        self.size = self.unseen_base + 1
        # as many tokens are new as were seen once
        weight = np.r_[self.own_counts, masses, groups[:ENDINGS].sum()] + 0.5
        self.code(weight)

    def code(self, weight: np.ndarray) -> None:
        """Huffman tree; then eight bits for each spelled byte. Nodes count on."""
        heap = [(float(w), i, None) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        serial = len(weight)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], serial, (a, b)))
            serial += 1
        paths: dict[int, list[tuple[int, int]]] = {}
        stack = [(heap[0], [])]
        inner = 0
        while stack:
            (_, number, pair), path = stack.pop()
            if pair is None:
                paths[number] = path
                continue
            node, inner = inner, inner + 1
            stack += [(pair[0], [*path, (node, 0)]), (pair[1], [*path, (node, 1)])]
        rows = [paths[i] for i in range(len(weight))]
        for byte in range(256):
            at = [(inner + (1 << d) - 1 + (byte >> (8 - d)), byte >> (7 - d) & 1) for d in range(8)]
            rows.append(at)
        self.nodes = inner + 255
        self.length = np.array([len(r) for r in rows])
        self.start = np.cumsum(self.length) - self.length
        self.node = np.array([n for r in rows for n, _ in r], np.int64)
        self.bit = np.array([b for r in rows for _, b in r], np.int8)

    def symbols(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        own = (self.keys[place] == keys) if len(self.keys) else np.zeros(len(keys), bool)
        rare = np.where(counts > 0, self.group_base + _group_of(keys, counts), self.unseen_base)
        return np.where(own, place, rare)


def _encoded(alphabet: Alphabet, buckets: int):
    """Per text: base score, known tokens, share of tokens within their symbols, and the symbols of the text.

    Training rows also get the symbols they would have if each of their tokens had been seen once less.
    """

    def spelled(sym: np.ndarray, spans: list, tokens: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Insert the bytes of unseen words after their symbol; also where each text then begins."""
        unseen = np.flatnonzero((sym >= alphabet.unseen_base) & tokens)
        extra = np.zeros(len(sym), np.int64)
        letters = []
        edges = np.cumsum([0] + [len(s) for _, s in spans])
        for i in unseen.tolist():
            part = int(np.searchsorted(edges, i, "right")) - 1
            data, span = spans[part]
            a, b = span[i - edges[part]]
            letters.append(np.append(data[a:b], 0x20))
            extra[i] = b - a + 1
        out = np.empty(len(sym) + int(extra.sum()), np.uint16)
        place = np.arange(len(sym)) + np.cumsum(extra) - extra
        body = np.ones(len(out), bool)
        body[place] = False
        out[place] = sym
        out[body] = (np.concatenate(letters).astype(np.int64) + BYTES) if letters else []
        return out, np.append(place, len(out))[limits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = np.log10(alphabet.tokens + alphabet.types + 1)
        for part in batches:
            for payload, replies in zip(part.column(0), part.column(1).to_pylist()):
                batch = _opened(payload.as_buffer())
                keys, first, spans = _tokens(batch)
                uniq, back = np.unique(keys, return_inverse=True)
                bucket = (uniq >> np.uint64(32)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                count = np.empty(len(uniq), np.int64)
                count[order] = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(replies, key=lambda r: r["bucket"])])
                sym = alphabet.symbols(uniq, count)
                group = np.clip(sym - alphabet.group_base, 0, MAGNITUDES * ENDINGS - 1)
                rare = (sym >= alphabet.group_base) & (sym < alphabet.unseen_base)
                within = np.where(rare, np.log10(np.maximum(count, 1) / np.maximum(alphabet.masses[group], 1)), 0.0)
                sums = lambda per: np.diff(np.r_[0.0, np.cumsum(per[back])][first])
                is_word = keys != END
                full, at = spelled(sym[back], spans, is_word, first)
                train = np.array(batch.column(1).to_pylist(), bool)
                less, less_at = spelled(alphabet.symbols(uniq, np.maximum(count - 1, 0))[back], spans, is_word, first)
                cut = lambda s, p: [s[a:b].tobytes() for a, b in zip(p[:-1], p[1:])]
                n_bytes = np.diff(words.text_bytes(batch.column(2))[1])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(1), pa.array(np.diff(first)), pa.array(sums((count > 0).astype(float)).astype(np.int64)),
                        pa.array(sums(np.log10(count + 1.0)) - np.diff(first) * scale), pa.array(sums(within)), pa.array(n_bytes),
                        pa.array(cut(full, at), pa.binary()), pa.array([s if t else None for s, t in zip(cut(less, less_at), train)], pa.binary()),
                    ],
                    ["doc_id", "train", "n_tokens", "n_known", "base_score", "within", "n_bytes", "symbols", "seen_less"],
                )

    return run


_ENCODED = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, within double, n_bytes long, symbols binary, seen_less binary"


# --- bits in contexts -----------------------------------------------------------------------


def fit_domains(alphabet: Alphabet, texts: list[np.ndarray], rounds: int = 15, seed: int = 3) -> np.ndarray:
    """Log probabilities [symbol, domain] of a mixture of symbol distributions, one domain per text."""
    counts = np.zeros((len(texts), alphabet.size))
    for row, t in zip(counts, texts):
        t = t[t < BYTES]
        row += np.bincount(t, minlength=alphabet.size)
    whole = counts.sum(axis=0) + 0.1
    whole /= whole.sum()
    rng = np.random.default_rng(seed)
    share = rng.dirichlet(np.full(DOMAINS, 0.1), len(texts))
    for _ in range(rounds):
        body = share.T @ counts + 50 * whole
        log = np.log(body / body.sum(axis=1, keepdims=True)).T
        fit = counts @ log + np.log(share.mean(axis=0) + 1e-3)
        share = np.exp(fit - fit.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
    return log.astype(np.float32)


def _groups(column: Iterator, symbols: int = 100_000) -> Iterator[list[np.ndarray]]:
    """Texts of about so many symbols together."""
    held: list[np.ndarray] = []
    size = 0
    for raw in column:
        held.append(np.frombuffer(raw.as_buffer(), np.uint16))
        size += len(held[-1])
        if size > symbols:
            yield held
            held, size = [], 0
    if held:
        yield held


def _domain_round(domains: np.ndarray):
    """Sums of one round: symbols by domain, each text shared out in 1024 parts among the domains that fit it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(domains), DOMAINS), np.int64)

        def add(texts: list[np.ndarray]) -> None:
            t = np.concatenate(texts)
            text = np.repeat(np.arange(len(texts)), [len(x) for x in texts])[t < BYTES]
            t = t[t < BYTES].astype(np.int64)
            fit = np.stack([np.bincount(text, weights=d.take(t, mode="clip"), minlength=len(texts)) for d in by_domain], axis=1)
            share = np.exp(fit - fit.max(axis=1, keepdims=True))
            parts = np.rint(share / share.sum(axis=1, keepdims=True) * 1024)
            for k in range(DOMAINS):
                # sums of whole numbers, exact in double precision
                total[:, k] += np.bincount(t, weights=parts[:, k].take(text, mode="clip"), minlength=len(domains)).astype(np.int64)

        by_domain = np.ascontiguousarray(domains.T.astype(np.float64))
        for texts in _groups(raw for batch in batches for raw in batch.column(0)):
            add(texts)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total.ravel()[used])], ["at", "total"])

    return run


def refined_domains(domains: np.ndarray, learned: DataFrame) -> np.ndarray:
    """Domains after rounds over all training rows; the driver holds one number per symbol and domain."""
    for _ in range(DOMAIN_ROUNDS):
        body = np.zeros(domains.shape)
        for at, total in learned.select("seen_less").mapInArrow(_domain_round(domains), "at int, total long").groupBy("at").agg(F.sum("total")).collect():
            body.ravel()[at] = total / 1024
        whole = body.sum(axis=1, keepdims=True) + 0.1
        body += 50 * whole / whole.sum()
        domains = np.log(body / body.sum(axis=0)).astype(np.float32)
    return domains


def contexts(domains: np.ndarray, sym: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Four context hashes for every symbol of texts that begin at ``starts``."""
    n = len(sym)
    at = np.arange(n)
    text = np.searchsorted(starts, at, "right") - 1
    is_byte = sym >= BYTES
    token = np.flatnonzero(~is_byte)
    ts, owner = sym[token], text[token]
    none = 0xFFFF

    def before(k: int) -> np.ndarray:
        out = np.full(len(ts), none, np.int64)
        same = owner[k:] == owner[:-k]
        out[k:][same] = ts[:-k][same]
        return out

    # the domain that fits the tokens before this one best
    seen = np.cumsum(domains[ts], axis=0, dtype=np.float64)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(ts) else np.zeros(0, np.int64)
    begin = np.repeat(first, np.diff(np.r_[first, len(ts)]))
    so_far = np.zeros_like(seen)
    so_far[1:] = seen[:-1]
    offset = np.vstack([np.zeros((1, DOMAINS)), seen])[begin]
    domain = (so_far - offset).argmax(axis=1)
    domain[np.arange(len(ts)) == begin] = DOMAINS
    code = lambda v, salt: words.mix(v.astype(np.uint64) + np.uint64(salt << 20))
    one, two, z = code(before(1), 1), code(before(2), 2), code(domain, 3)
    out = [np.empty(n, np.uint64) for _ in range(4)]
    for o, v in zip(out, (one, z, words.mix(one * np.uint64(3) + two), words.mix(one * np.uint64(5) + z))):
        o[token] = v
    if is_byte.any():
        spot = np.flatnonzero(is_byte)
        last = np.maximum.accumulate(np.where(is_byte, 0, at))
        k = (at - last)[spot]  # 1 for the first byte of a word
        h = np.zeros(len(spot), np.uint64)
        word_domain = out[1][last[spot]]
        for j in range(1, 6):
            h = words.mix(h + np.where(j <= k, sym[np.maximum(spot - j, 0)], none).astype(np.uint64) + np.uint64(j << 24))
            place = {1: 0, 2: 2, 3: 1, 5: 3}.get(j)
            if place is not None:
                out[place][spot] = h if j > 1 else words.mix(h ^ word_domain)
    return out


class Bits:
    """The bits of a run of symbols, with the slot of every context."""

    def __init__(self, alphabet: Alphabet, sym: np.ndarray, ctx: list[np.ndarray]):
        row = np.where(sym >= BYTES, sym - BYTES + alphabet.size, sym)
        length = alphabet.length[row]
        total = int(length.sum())
        self.length = length
        depth = np.arange(total, dtype=np.int32) - np.repeat((np.cumsum(length) - length).astype(np.int32), length)
        at = np.repeat(alphabet.start[row], length) + depth
        self.node = alphabet.node.take(at, mode="clip")
        self.bit = alphabet.bit.take(at, mode="clip")
        self.kind = np.minimum(depth, DEPTHS - 1)
        self.kind[np.repeat(sym >= BYTES, length)] += DEPTHS
        spread = self.node.astype(np.uint32) * np.uint32(0x9E3779B1)
        shift = np.uint32(32 - TABLE_BITS)
        mult = np.uint32(0x85EBCA6B)
        self.slots = [(((np.repeat((c >> np.uint64(32)).astype(np.uint32), length) ^ spread) * mult) >> shift).astype(np.int64) for c in ctx]


def _table_counts(alphabet: Alphabet, domains: np.ndarray):
    size = 1 << TABLE_BITS
    page = 1 << PAGE_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = -(-alphabet.nodes // page) * page
        counts = [[np.zeros((2, size), np.uint32) for _ in range(4)] + [np.zeros((2, nodes), np.uint32)] for _ in range(2)]

        def add(texts: list[np.ndarray], half: int) -> None:
            sym = np.concatenate(texts).astype(np.int64)
            lengths = np.array([len(t) for t in texts])
            ctx = contexts(domains, sym, np.cumsum(lengths) - lengths)
            for a in range(0, len(sym), 100_000):
                bits = Bits(alphabet, sym[a : a + 100_000], [c[a : a + 100_000] for c in ctx])
                for table, slot in zip(counts[half], [*bits.slots, bits.node]):
                    at = slot + bits.bit * np.int64(table.shape[1])
                    table += np.bincount(at, minlength=table.size).reshape(table.shape).astype(np.uint32)

        held: tuple[list, list] = ([], [])
        for batch in batches:
            for half, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                held[half].append(np.frombuffer(raw.as_buffer(), np.uint16))
                if sum(map(len, held[half])) > 200_000:
                    add(held[half], half)
                    held[half].clear()
        for half in range(2):
            if held[half]:
                add(held[half], half)
            for t, table in enumerate(counts[half]):
                pages = table.reshape(2, -1, page)
                used = np.flatnonzero(pages.any(axis=(0, 2)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((used + (t << 20)).astype(np.int32)), pa.array(np.full(len(used), half, np.int32)), pa.array([pages[:, p].tobytes() for p in used], pa.binary())],
                    ["page", "half", "counts"],
                )

    return run


def _table_page(table: pa.Table) -> pa.Table:
    """A page of the tables: of all rows, without those of the first half, and without those of the second."""
    total = np.zeros((2, 2, 1 << PAGE_BITS), np.int64)
    for half, raw in zip(table["half"].to_pylist(), table["counts"].to_pylist()):
        total[half] += np.frombuffer(raw, np.uint32).reshape(2, -1)

    def packed(counts: np.ndarray) -> bytes:
        n = counts.sum(axis=0)
        stretch = np.log((counts[1] + 0.4) / (counts[0] + 0.4))
        level = (n > 0).astype(np.uint8) + (n > 3) + (n > 31)
        return np.stack([np.clip(np.rint(stretch * 12), -127, 127).astype(np.int8).view(np.uint8), level.astype(np.uint8)]).tobytes()

    return pa.table({"page": table["page"][:1], "slots": pa.array([packed(total.sum(axis=0))], pa.binary()), "half_0": pa.array([packed(total[1])], pa.binary()), "half_1": pa.array([packed(total[0])], pa.binary())})


class Mixer:
    """Context tables and the weights that every text starts from."""

    def __init__(self, alphabet: Alphabet, domains: np.ndarray, pages: list):
        self.alphabet, self.domains = alphabet, domains
        sizes = [1 << TABLE_BITS] * 4 + [-(-alphabet.nodes // (1 << PAGE_BITS)) << PAGE_BITS]
        self.stretch = [np.zeros(s, np.int8) for s in sizes]
        self.level = [np.zeros(s, np.uint8) for s in sizes]
        for page, raw in pages:
            t, at = page >> 20, (page & 0xFFFFF) << PAGE_BITS
            packed = np.frombuffer(raw, np.uint8).reshape(2, -1)
            self.stretch[t][at : at + (1 << PAGE_BITS)] = packed[0].view(np.int8)
            self.level[t][at : at + (1 << PAGE_BITS)] = packed[1]
        self.gates = 2 * DEPTHS * LEVELS * LEVELS
        self.weights = np.tile(np.array([0.2, 0.2, 0.2, 0.2, 0.2, 0.0], np.float32), (self.gates, 1))
        self.map = np.linspace(-8, 8, BUCKETS, dtype=np.float32)
        # how often each was learned from
        self.weights_used, self.map_used = np.zeros(self.gates, np.int64), np.zeros(BUCKETS, np.int64)

    def inputs(self, bits: Bits) -> tuple[np.ndarray, np.ndarray]:
        x = np.empty((INPUTS, len(bits.node)), np.float32)
        # slots lie within their tables; without a test of that a lookup costs half as much
        x[0] = self.stretch[4].take(bits.node, mode="clip")
        for i, slot in enumerate(bits.slots):
            x[i + 1] = self.stretch[i].take(slot, mode="clip")
        x[:5] /= 12
        x[5] = 0.3
        levels = [self.level[i].take(bits.slots[i], mode="clip") for i in (2, 3)]
        gate = (bits.kind * LEVELS + levels[0]) * LEVELS + levels[1]
        return x, gate

    def run(self, texts: list[np.ndarray], learn: bool = False) -> np.ndarray:
        """log2 probability of each text's symbols. With ``learn`` the starting weights follow all texts together."""
        n = len(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(lengths) - lengths
        sym = np.concatenate(texts).astype(np.int64) if n else np.zeros(0, np.int64)
        ctx = contexts(self.domains, sym, starts)
        own = 1 if learn else n
        weights = np.repeat(self.weights.T[:, None], own, axis=1)  # input, text, gate
        curves = np.repeat(self.map[None], own, axis=0)
        out = np.zeros(n)
        for r in range(0, int(lengths.max(initial=0)), ROUND):
            alive = np.flatnonzero(lengths > r)
            if not learn:  # texts that go on first, so that their bits are a slice
                alive = alive[np.argsort(lengths[alive] <= r + ROUND, kind="stable")]
            take = np.minimum(lengths[alive] - r, ROUND)
            at = np.repeat(starts[alive] + r - np.cumsum(take) + take, take) + np.arange(take.sum())
            bits = Bits(self.alphabet, sym[at], [c[at] for c in ctx])
            if not len(bits.node):
                continue
            text = np.repeat(np.repeat(np.arange(len(alive)), take), bits.length)
            x, gate = self.inputs(bits)
            mine = slice(None) if learn else alive
            now, curve = weights[:, mine].reshape(INPUTS, -1), curves[mine].ravel()
            cell = gate.astype(np.int64) if learn else text * self.gates + gate
            dot = x[0] * now[0].take(cell, mode="clip")
            for k in range(1, INPUTS):
                dot += x[k] * now[k].take(cell, mode="clip")
            dot = np.clip(dot, np.float32(-7.99), np.float32(7.99))
            # refine: interpolate the map between the two nearest buckets, and average
            place = (dot + 8) * np.float32((BUCKETS - 1) / 16)
            low = place.astype(np.int64)
            share = place - low.astype(np.float32)
            bucket = low if learn else low + text * BUCKETS
            base = curve.take(bucket, mode="clip")
            refined = (dot + base + (curve.take(bucket + 1, mode="clip") - base) * share) / 2
            p = 1 / (1 + np.exp(-refined))
            p = np.clip(p, np.float32(2.0**-16), np.float32(1 - 2.0**-16))
            out[alive] += np.bincount(text, weights=np.log2(np.abs(p - (1 - bits.bit))), minlength=len(alive))
            # learn from the round, for texts that go on: mean gradient per gate, and per bucket of the map
            texts_on = len(alive) if learn else int((lengths[alive] > r + ROUND).sum())
            if not texts_on:
                continue
            on = len(text) if learn else int(np.searchsorted(text, texts_on))
            error = bits.bit[:on] - p[:on]
            cell, near = cell[:on], bucket[:on] + (share[:on] > 0.5)
            count = np.bincount(cell, minlength=now.shape[1])
            used = np.flatnonzero(count)
            rate = RATE / (count[used] + 16.0)
            for k in range(INPUTS):
                now[k, used] += rate * np.bincount(cell, weights=error * x[k, :on], minlength=now.shape[1])[used]
            seen = np.bincount(near, minlength=len(curve))
            curve += (np.bincount(near, weights=error, minlength=len(curve)) / (seen + 64.0)).astype(np.float32)
            weights[:, mine], curves[mine] = now.reshape(INPUTS, -1, self.gates), curve.reshape(-1, BUCKETS)
            if learn:
                self.weights_used += count
                self.map_used += seen
        if learn:
            self.weights = np.ascontiguousarray(weights[:, 0].T)
            self.map = curves[0]
        return out

    def calibrate(self, texts: list[np.ndarray]) -> None:
        """Learn from texts one group after another; few texts are gone through again."""
        for _ in range(max(1, min(3, 1000 // max(len(texts), 1)))):
            for a in range(0, len(texts), 50):
                self.run(texts[a : a + 50], learn=True)


def _learned(mixers: list[Mixer]):
    """Weights and map after the texts of a shard, times their use, and the use; with the tables of the other half."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        mixer = copy.copy(mixers[key[0].as_py()])
        mixer.weights_used, mixer.map_used = np.zeros(mixer.gates, np.int64), np.zeros(BUCKETS, np.int64)
        table = table.sort_by([("draw", "ascending"), ("seen_less", "ascending")])
        mixer.calibrate([np.frombuffer(raw, np.uint16).astype(np.int64) for raw in table["seen_less"].to_pylist()])
        whole = lambda values, used: np.rint(values.astype(np.float64) * UNIT).astype(np.int64) * used
        sums = np.concatenate([whole(mixer.weights, mixer.weights_used[:, None]).ravel(), mixer.weights_used, whole(mixer.map, mixer.map_used), mixer.map_used])
        used = np.flatnonzero(sums)
        return pa.table({"at": pa.array(used.astype(np.int32)), "total": pa.array(sums[used])})

    return run


def learn_start(mixer: Mixer, halves: list[Mixer], learned: DataFrame, shards: int) -> None:
    """Weights and map of ``mixer`` as the mean over all shards of the training rows."""
    dealt = learned.withColumn("shard", F.pmod(F.shiftright("draw", 1), F.lit(shards)))
    sums = dealt.groupBy("half", "shard").applyInArrow(_learned(halves), "at int, total long").groupBy("at").agg(F.sum("total")).collect()
    total = np.zeros(mixer.gates * (INPUTS + 1) + 2 * BUCKETS)
    for at, value in sums:
        total[at] = value
    weights, used, curve, curve_used = np.split(total, np.cumsum([mixer.gates * INPUTS, mixer.gates, BUCKETS]))
    mean = weights.reshape(-1, INPUTS) / np.maximum(used, 1)[:, None] / UNIT
    mixer.weights = np.where(used[:, None] > 0, mean, mixer.weights).astype(np.float32)
    mixer.map = np.where(curve_used > 0, curve / np.maximum(curve_used, 1) / UNIT, mixer.map).astype(np.float32)


def _scored(mixer: Mixer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [mixer.run(texts) for texts in _groups(batch.column(5))]
            total = np.concatenate([np.zeros(0), *bits])
            within = batch.column(6).to_numpy()
            score = total * np.log10(2) + within
            size = np.maximum(batch.column(4).to_numpy(), 1)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(4)], pa.array(score), pa.array(-score / np.log10(2) / size), batch.column(7)],
                ["doc_id", "n_tokens", "n_known", "base_score", "score", "bits_per_byte", "train"],
            )

    return run


def score_texts(docs: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text", calibration_rows: int = CALIBRATION_ROWS) -> DataFrame:
    """One row per input row: ``doc_id``, ``train``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``bits_per_byte``.

    ``training`` says which rows the model learns from; null counts as no. A null text is empty: one
    end token. Scores are log10 probabilities of whole texts; ``base_score`` is that of single tokens with one added to every count.
    Without training rows every word is spelled out with even bits. Tokens are told apart by 60 bits of a hash.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(training, F.lit(False)).alias("train"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    blocks = stored(rows.mapInArrow(_blocks, "block long, size long, payload binary"))
    size = blocks.agg(F.sum("size")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (8 << 20))
    counted = stored(
        blocks.select("block", "payload").mapInArrow(_requests(buckets), "bucket long, block long, keys binary, counts binary")
        .groupBy("bucket")
        .applyInArrow(_totals, "block long, bucket long, counts binary, top_keys binary, top_counts binary")
    )
    alphabet = _alphabet(counted.filter("block is null"))
    replies = counted.filter("block is not null").groupBy("block").agg(F.collect_list(F.struct("bucket", "counts")).alias("replies"))
    encoded = stored(blocks.join(replies, "block").select("payload", "replies").mapInArrow(_encoded(alphabet, buckets), _ENCODED))
    draw = F.xxhash64("doc_id")
    learned = encoded.filter("train").select(draw.alias("draw"), draw.bitwiseAND(F.lit(1)).cast("int").alias("half"), "seen_less")
    held = learned.agg(F.count(F.lit(1)), F.sum(F.length("seen_less"))).first()
    rows_first = min(calibration_rows, -(-held[0] // 20))
    sample = [r for r in learned.orderBy("draw", "seen_less").limit(rows_first).collect()]
    texts = [np.frombuffer(r["seen_less"], np.uint16).astype(np.int64) for r in sample]
    domains = refined_domains(fit_domains(alphabet, texts), learned) if texts else np.zeros((alphabet.size, DOMAINS), np.float32)
    tables = (
        learned.select("half", "seen_less")
        .mapInArrow(_table_counts(alphabet, domains), "page int, half int, counts binary")
        .groupBy("page")
        .applyInArrow(_table_page, "page int, slots binary, half_0 binary, half_1 binary")
    )
    pages = tables.collect()  # a fixed number of slots
    mixer, *halves = [Mixer(alphabet, domains, [(r["page"], bytes(r[name])) for r in pages]) for name in ("slots", "half_0", "half_1")]
    if texts:
        learn_start(mixer, halves, learned, max(1, (held[1] or 0) // (2 * SHARD_BYTES)))
    scored = encoded.select("doc_id", "n_tokens", "n_known", "base_score", "n_bytes", "symbols", "within", "train").mapInArrow(
        _scored(mixer), "doc_id long, n_tokens long, n_known long, base_score double, score double, bits_per_byte double, train boolean"
    )
    return scored.select("doc_id", "train", "n_tokens", "n_known", F.lit(alphabet.tokens).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")


def _alphabet(summaries: DataFrame) -> Alphabet:
    """From the buckets' summaries: the most frequent tokens, and sums per group of the others."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    size = MAGNITUDES * ENDINGS
    # each bucket's sums are added where they are; its candidates are cut down in Spark
    groups = np.zeros((2, size), np.int64)
    sums = summaries.select("counts").mapInArrow(_added, "at int, total long").groupBy("at").agg(F.sum("total")).collect()
    for at, total in sums:
        groups.ravel()[at] = total
    top = summaries.select("top_keys", "top_counts").mapInArrow(_unpacked, "key long, count long").orderBy(F.desc("count"), "key").limit(OWN_SYMBOLS).collect()
    if top:
        keys.append(np.array([r[0] for r in top], np.int64).view(np.uint64))
        counts.append(np.array([r[1] for r in top], np.int64))
    k, c = np.concatenate(keys), np.concatenate(counts)
    tokens, types = int(groups[1].sum()), int(groups[0].sum())
    own = _group_of(k, c) if len(k) else np.zeros(0, np.int64)
    types_left = groups[0] - np.bincount(own, minlength=size)
    mass_left = groups[1] - np.bincount(own, weights=c, minlength=size).astype(np.int64)
    return Alphabet(k, c, types_left, mass_left, tokens, types)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(2 * MAGNITUDES * ENDINGS, np.int64)
    for batch in batches:
        for raw in batch.column(0):
            total += np.frombuffer(raw.as_buffer(), np.int64)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["at", "total"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, c in zip(batch.column(0), batch.column(1)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(k.as_buffer(), np.uint64).view(np.int64)), pa.array(np.frombuffer(c.as_buffer(), np.int64))], ["key", "count"]
            )
