"""Definitions, word for word, that the operators are held against."""

import re

import xxhash


def brute_windows(doc, items, size):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = split(doc), set(), set()
    for i, t in items:
        ws = split(t)
        for k in range(max(1, len(ws) - size + 1) if ws else 0):
            win = ws[k : k + size]
            for at in range(len(words) - len(win) + 1):
                if words[at : at + len(win)] == win:
                    hit |= set(range(at, at + len(win)))
                    if i is not None:
                        found.add(str(i))
    return len(words), len(hit), sorted(found)


def brute_secrets(t):
    t, out = t or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def brute_fingerprint(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    """Root of each distinct fingerprint over links of at most 2 bits."""
    ids = sorted(set(fps))
    root = {f: f for f in ids}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in ids:
        for b in ids:
            if a < b and (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in ids}


def shingles(t, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute_similar(rows):
    """The smallest id of each id's group, by all pairs that have 0.8 of their five-word shingles in common; rows: (id, text), ids may repeat."""
    known = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in known}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(known):
        for j, b in known[:k]:
            if (not a and not b) or 5 * len(a & b) >= 4 * len(a | b) > 0:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}
