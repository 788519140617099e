"""Plain Python versions of what the operators compute."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(UPPER)) if w]


def shingles(text, size=5):
    w = split(text)
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def similar(sets, percent):
    """Pairs of positions of sets that are similar enough."""
    where = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            where[g].append(k)
    for k, s in enumerate(sets):
        for j, m in collections.Counter(j for g in s for j in where[g] if j > k).items():
            if 100 * m >= percent * (len(s) + len(sets[j]) - m):
                yield k, j


def linked(rows, percent=80):
    """(id, number of shingles, smallest id reachable) per row."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in similar(sets, percent):
        root[find(b)] = find(a)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return [(i, len(s), low.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def without_repeats(rows, percent=80, min_tokens=5):
    """Texts without lines that an earlier line is similar to."""
    lines = []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        for n, line in enumerate(text.split("\n") if text is not None else []):
            lines.append((i, n, frozenset(split(line))))
    big = [k for k, x in enumerate(lines) if len(x[2]) >= min_tokens]
    gone = {lines[big[b]][:2] for _, b in similar([lines[k][2] for k in big], percent)}
    return [(i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)) for i, t in rows]


def unigram(rows, modulus=7, held=2):
    """(id, n_tokens, n_known, train_tokens, base_score) per row."""
    end = object()
    counts = collections.Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % modulus != held:
            counts.update([*split(t), end])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        tokens = [*split(t), end]
        score = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens)
        out.append((i, len(tokens), sum(counts[x] > 0 for x in tokens), n, score))
    return out


LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def worn_words(rows, min_length=7, min_count=2):
    """Word counts after one letter of some runs is dropped."""
    counts = collections.Counter()
    for i, text in rows:
        for run in LETTERS.findall(text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= min_count and len(w) >= min_length}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(counts, ratio=10):
    """(word, form, root, n, n_near, form_n) of every word, by comparing all pairs."""
    near = {w: [o for o in counts if one_apart(w, o)] for w in counts}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda o: (-counts[o], o))
            if counts[best] >= ratio * counts[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items())


def rebuilt(rows):
    """Conversation id to its rebuilt turns, from rows (conv_id, turn, role, text)."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - math.fmod(c, 5), [])[: heads[c]] + own[c][heads[c] :] for c in own}


def trie(conversations):
    """Nodes of the prefix trie, with -1 for the parent of the root."""
    nodes = {}
    for c, turns in sorted(conversations.items()):
        for d in range(len(turns) + 1):
            node = nodes.setdefault(tuple(turns[:d]), {"members": [], "ends": [], "below": set()})
            node["members"].append(c)
            if d == len(turns):
                node["ends"].append(c)
            if d:
                nodes[tuple(turns[: d - 1])]["below"].add(tuple(turns[:d]))
    out = []
    for p in sorted(nodes, key=len, reverse=True):
        x = nodes[p]
        x["leaves"] = sum(nodes[q]["leaves"] for q in x["below"]) or 1
        x["saved"] = sum(nodes[q]["saved"] for q in x["below"]) + ((len(x["members"]) - 1) * len(p[-1][1].encode()) if p else 0)
        up = min(nodes[p[:-1]]["members"]) if p else -1
        sha = hashlib.sha256(",".join(map(str, x["ends"])).encode()).hexdigest()
        out.append((min(x["members"]), len(p), up, len(x["members"]), len(x["below"]), x["leaves"], x["saved"], sha))
    return sorted(out)


def uncovered(rows, size=200):
    """(id, bytes, removed bytes, removed runs, digest of the rest) per row, by a table of all strings of that size."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[k : k + size] for _, b in texts for k in range(len(b) - size + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = b"\x01" * size
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        rest = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out
