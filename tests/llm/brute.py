"""Plain versions of the operators, over lists of rows that fit in memory."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

LOWER = {c: c + 32 for c in range(65, 91)}
MASK = (1 << 64) - 1


# --- op1 ---------------------------------------------------------------------


def ngrams(text, buckets):
    words = re.findall(rb"[0-9a-z_\x80-\xff]+|[^0-9a-z_\x80-\xff\s]+", (text or "").encode().lower())
    hashes = [xxhash.xxh64_intdigest(w) for w in words]
    pairs = [((a * 0x9E3779B97F4A7C15) & MASK) ^ b for a, b in zip(hashes, hashes[1:])]
    return Counter(h % buckets for h in hashes + [p ^ (p >> 32) for p in pairs])


def gumbel(doc, seed=7):
    x = ((-1 if doc is None else doc) + seed * 0x9E3779B97F4A7C15) & MASK
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * by) & MASK
    x ^= x >> 31
    return -math.log(-math.log(((x >> 12) + 0.5) / 2**52))


def resampled(docs, labels, buckets=10_000, smoothing=0.01):
    """Rows (doc_id, text) that stay; labels (doc_id, quality)."""
    quality = {}
    for doc, value in labels:
        quality[doc] = min(value, quality.get(doc, value))
    good = {doc for doc, value in quality.items() if value == 1}
    logs = []
    for rows in ([d for d in docs if d[0] in good], docs):
        counts = sum((ngrams(text, buckets) for _, text in rows), Counter())
        add = smoothing * sum(counts.values()) / buckets
        total = sum(counts.values()) + add * buckets
        logs.append([math.log((counts[b] + add) / total) for b in range(buckets)])
    ratio = [round((t - r) * 2**20) for t, r in zip(*logs)]
    scores = [
        sum(n * ratio[b] for b, n in ngrams(text, buckets).items()) / 2**20 + gumbel(doc)
        for doc, text in docs
    ]
    k = max(1, math.ceil(len(docs) * (len(good) / len(quality))))
    least = sorted(scores, reverse=True)[k - 1]
    return [row for row, score in zip(docs, scores) if score >= least]


# --- op2 ---------------------------------------------------------------------


def normal(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contaminated(text, items, window=10):
    """Hit word places and items with a window in the text."""
    words, hit, found = normal(text), set(), set()
    for item, body in items:
        w = normal(body)
        size = min(window, len(w))
        windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(words) - size + 1 if w else 0):
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(item)
    return hit, found


# --- op4 ---------------------------------------------------------------------


def simhash(text, size=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, distance=4):
    """For each fingerprint the place of the first of its component."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


# --- op5 ---------------------------------------------------------------------


def mixed(rows, weights, block_rows, other=1):
    """Positions of rows (doc_id, source): a scheduler that goes slot by slot."""
    names = [*weights, "(other)"]
    shares = [*weights.values(), other]
    queues = defaultdict(list)
    for row in rows:
        source = row[1] if row[1] in weights else "(other)"
        key = hashlib.md5(("" if row[0] is None else str(row[0])).encode()).hexdigest()
        queues[source].append((key, row))
    blocks = []
    for name in names:
        ordered = [row for _, row in sorted(queues[name], key=lambda x: x[0])]
        blocks.append([ordered[i : i + block_rows] for i in range(0, len(ordered), block_rows)])
    out, block = [], 0
    while any(blocks):
        now = [b[:s] for b, s in zip(blocks, shares)]
        blocks = [b[s:] for b, s in zip(blocks, shares)]
        slots, done = sum(map(len, now)), [0] * len(now)
        for t in range(slots):
            ready = [
                (-(-(done[i] + 1) * slots // len(now[i])), i)
                for i in range(len(now))
                if done[i] < len(now[i]) and done[i] * slots // len(now[i]) <= t
            ]
            due, i = min(ready)
            assert due > t
            for place, row in enumerate(now[i][done[i]]):
                out.append((row, names[i], block, place, block * block_rows + place))
            done[i] += 1
            block += 1
    return out


# --- op9 ---------------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def without_repeats(docs, size):
    """Words left of rows (doc_id, text), rows of different ids."""
    seen, left = set(), {}
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        words = words_of(text)
        gone = set()
        for i in range(len(words) - size + 1):
            window = tuple(words[i : i + size])
            if window in seen:
                gone.update(range(i, i + size))
            seen.add(window)
        left[doc] = [w for i, w in enumerate(words) if i not in gone]
    return left


# --- op10 --------------------------------------------------------------------


def line_groups(text):
    out, hashes = [[]], [0]
    for line in text.split("\n"):
        out[-1].append(line)
        hashes.append(int(hashlib.md5(line.encode()).hexdigest()[:8], 16))
        if (31 * hashes[-2] + hashes[-1]) % 3 == 0:
            out.append([])
    return [g for g in out if g]


def without_lines(docs):
    """Text left of rows (doc_id, text), in the order of the rows."""
    seen, left = set(), {}
    for place in sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0)):
        text = docs[place][1]
        if text is None:
            left[place] = None
            continue
        kept = []
        for group in line_groups(text):
            body = "\n".join(group)
            long_ = sum(1 for line in group if line.strip(" \t\n\v\f\r")) >= 2
            if not (long_ and body in seen):
                kept += group
            if long_:
                seen.add(body)
        left[place] = "\n".join(kept)
    return [left[i] for i in range(len(docs))]


# --- op11 --------------------------------------------------------------------


def repaired(rows):
    """Counts, cost, audit and text of one conversation's rows (turn, role, text), in order."""
    white, seen, faults = " \t\n\v\f\r", set(), []
    for _, role, text in rows:
        last = text.rstrip(white)[-1:]
        known = (role, text) in seen
        seen.add((role, text))
        faults.append("blank" if not last else "duplicate" if known else "" if last in ".!?" else "truncated")
    # every state (the roles' initials so far, shortened to the last) with its best end
    ends = {"": (0, "", ())}

    def better(into, state, cost, audit, kept):
        into[state] = min(into.get(state, (cost, audit, kept)), (cost, audit, kept))

    def follows(state, initial):
        return state + initial in ("s", "u", "su", "ua", "au")

    def grown(ends):
        while True:
            more = dict(ends)
            for state, (cost, audit, kept) in ends.items():
                for role in ("user", "assistant"):
                    if follows(state, role[0]):
                        better(more, role[0], cost + 2, audit + "I", (*kept, (role, "")))
            if more == ends:
                return ends
            ends = more

    ends = grown(ends)
    for (_, role, text), fault in zip(rows, faults):
        after, late = {}, int(fault == "truncated")
        for state, (cost, audit, kept) in ends.items():
            better(after, state, cost + 3, audit + "D", kept)
            if fault in ("blank", "duplicate"):
                continue
            if follows(state, role[:1]) and role:
                better(after, role[:1], cost + late, audit + "K", (*kept, (role, text)))
            for other in ("user", "assistant"):
                if follows(state, other[0]):
                    better(after, other[0], cost + 2 + late, audit + "R", (*kept, (other, text)))
        ends = grown(after)
    cost, audit, kept = min(ends[s] for s in ("", "a") if s in ends)
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{name: faults.count(name) for name in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
    }, list(kept)
