"""Plain versions of the operators over lists of (doc_id, text), for small inputs."""

import collections
import hashlib
import math
import re
import zlib

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def fold(doc_id, parts):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts


def shingles(text):
    w = words((text or "").translate(LOWER))
    k = min(5, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def near(rows):
    """class, number of links and group of each text."""
    classes = {}
    for i, t in sorted(rows):
        classes.setdefault(t or "", i)
    sets = {i: shingles(t) for t, i in classes.items()}
    parent, links = {i: i for i in sets}, collections.Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (classes[t or ""], links[classes[t or ""]], root(classes[t or ""])) for i, t in rows}


def repeats(rows, length=50):
    """n_bytes, n_removed, n_spans and hash of the rest per id."""
    seen, out = set(), {}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    at = 0
    while at < len(order):
        same = [r for r in order[at:] if r[0] == order[at][0]]
        at += len(same)
        own = []
        for i, t in same:
            raw = (t or "").encode()
            gone = bytearray(len(raw))
            for k in range(len(raw) - length + 1):
                piece = raw[k:k + length]
                own.append(piece)
                if piece in seen:
                    gone[k:k + length] = b"\1" * length
            kept = bytes(x for x, g in zip(raw, gone) if not g)
            spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
            out.setdefault(i, []).append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
        seen.update(own)
    return {i: sorted(v) for i, v in out.items()}


def base_scores(rows):
    tokens = [(i, words((t or "").translate(LOWER)) + ["\0"]) for i, t in rows]
    counts = collections.Counter(w for i, ws in tokens if fold(i, 7) != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(i, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens]
