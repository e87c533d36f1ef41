"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import xxhash

BLANK_WORDS = r"[^\x20\x09-\x0D]+"
ALNUM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text, pattern=BLANK_WORDS):
    return re.findall(pattern, lower(text))


def fold(doc_id, folds):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def fingerprint(text, shingle=4):
    found = words(text)
    if not found:
        return 0
    shingles = [" ".join(found[i:i + shingle]) for i in range(max(1, len(found) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(count, linked):
    root = list(range(count))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(count)]


def near_duplicates(docs, radius=4):
    """(id, fingerprint, component id) for (id, text) rows."""
    prints = [fingerprint(text) for _, text in docs]
    pairs = [(i, j) for i in range(len(docs)) for j in range(i)
             if (prints[i] ^ prints[j]).bit_count() <= radius]
    roots, least = components(len(docs), pairs), {}
    for (id, _), root in zip(docs, roots):
        if id is not None:
            least[root] = min(least.get(root, id), id)
    return [(id, f"{p:016x}", least.get(root)) for (id, _), p, root in zip(docs, prints, roots)]


def contamination(docs, items, window=13):
    """(id, words, hit, items, contaminated) for (id, text) rows."""
    wanted = defaultdict(set)
    for item, text in items:
        found = words(text, ALNUM_WORDS)
        for i in range(max(1, len(found) - window + 1) if found else 0):
            wanted[tuple(found[i:i + window])].add(item)
    out = []
    for id, text in docs:
        found, hit, named = words(text, ALNUM_WORDS), set(), set()
        for size in {len(w) for w in wanted}:
            for i in range(len(found) - size + 1):
                if of := wanted.get(tuple(found[i:i + size])):
                    hit |= set(range(i, i + size))
                    named |= of
        share = bool(hit) and 20 * len(hit) >= len(found)
        out.append((id, len(found), len(hit), sorted(str(i) for i in named if i is not None), share))
    return out


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _hash_long(value, seed):
    return _signed(xxhash.xxh64_intdigest(struct.pack("<q", value), seed % (1 << 64)))


def line_pairs(docs):
    """How often two lines follow each other, over all (id, text) rows."""
    return Counter(pair for _, text in docs if text is not None
                   for lines in [text.split("\n")] for pair in zip(lines, lines[1:]))


def line_chunks(text, pairs, passage=50):
    lines = text.split("\n")
    hashes = [_signed(xxhash.xxh64_intdigest(line.encode(), 42)) for line in lines]
    counts = [line.strip(" ").count(" ") + 1 for line in lines]
    rolled = [0] + [_hash_long(b, _hash_long(a, 42)) for a, b in zip(hashes, hashes[1:])]
    places = [0] + [pairs[pair] for pair in zip(lines, lines[1:])] + [0]
    cuts = [0]
    for i in range(1, len(lines)):
        here, before, after = places[i], places[i - 1], places[i + 1]
        lowest = before > 1 and after > 1 and rolled[i - 1] > rolled[i] <= rolled[i + 1]
        if (max(counts[i], counts[i - 1]) >= passage or here <= 1 or here < before
                or here < after or lowest):
            cuts.append(i)
    cuts.append(len(lines))
    return lines, [(a, b) for a, b in zip(cuts, cuts[1:]) if b - a > 1 or counts[a] >= passage]


def remove_repeated(docs, passage=50):
    """(id, text, lines, removed lines) for (id, text) rows with distinct ids."""
    places, pairs = defaultdict(list), line_pairs(docs)
    for id, text in docs:
        if text is not None:
            lines, chunks = line_chunks(text, pairs, passage)
            for a, b in chunks:
                places["\n".join(lines[a:b])].append((id is None, id, a))
    out = []
    for id, text in docs:
        if text is None:
            out.append((id, None, 0, 0))
            continue
        lines, chunks = line_chunks(text, pairs, passage)
        gone = {i for a, b in chunks for i in range(a, b)
                if min(places["\n".join(lines[a:b])]) != (id is None, id, a)}
        left = "\n".join(line for i, line in enumerate(lines) if i not in gone)
        out.append((id, left if gone else text, len(lines), len(gone)))
    return out


def repeated_lines(docs):
    """{id: lines that stand in a run of two lines or more which an earlier place has}.

    Knows no cuts: a line counts if it and a neighbour follow each other in an earlier text.
    """
    seen, out = set(), {}
    for id, text in docs:
        lines = (text or "").split("\n")
        own = list(zip(lines, lines[1:]))
        out[id] = {i for n, pair in enumerate(own) if pair in seen for i in (n, n + 1)}
        seen.update(own)
    return out


def unigram(docs, train):
    """{id: (tokens, known, training tokens, base score)} for (id, text) rows."""
    tokens = {id: [*words(text), None] for id, text in docs}
    counts = Counter(t for id, own in tokens.items() if train(id) for t in own)
    total, distinct = sum(counts.values()), len(counts)
    return {id: (len(own), sum(counts[t] > 0 for t in own), total,
                 sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in own))
            for id, own in tokens.items()}


def budgets(tree, budget):
    """Leaf budgets of a tree of (weight, children or capacity), as whole numbers."""
    def capacity(node):
        return node[1] if isinstance(node[1], int) else sum(map(capacity, node[1].values()))

    def share(node, tokens):
        if isinstance(node[1], int):
            return tokens
        open_nodes, given = {k: n for k, n in node[1].items() if n[0] > 0}, {}
        while True:
            by = sum(n[0] for n in open_nodes.values())
            full = [k for k, n in open_nodes.items() if tokens * n[0] >= capacity(n) * by]
            if not full:
                break
            for k in full:
                given[k] = capacity(open_nodes.pop(k))
                tokens -= given[k]
            if not open_nodes:
                break
        for k, n in open_nodes.items():
            given[k] = tokens * n[0] // by
        return {k: share(n, given.get(k, 0)) for k, n in node[1].items()}

    return share(tree, budget)


def verdict(host, path, rules, default="allow"):
    """(rule, verdict) of the longest of the (host, path, verdict) rules that fit."""
    fit = [(r_host.count("."), len(r_host), len(r_path), v == "block", r_host + r_path, v)
           for r_host, r_path, v in rules
           if (not r_host or host == r_host or host.endswith("." + r_host))
           and path.startswith(r_path)]
    return max(fit)[-2:] if fit else (None, default)
