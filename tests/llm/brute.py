"""Plain restatements of the operators' contracts, for small tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def roots(ids, pairs):
    """The smallest id that each id reaches."""
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def embedding_groups(rows, threshold=0.95):
    ok = {i: np.asarray(v, float) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ok = {i: v / abs(v).max() for i, v in ok.items()}
    unit = {i: v / np.linalg.norm(v) for i, v in ok.items()}
    ids = sorted(ok)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    links = Counter(x for p in pairs for x in p)
    top = roots([i for i, _ in rows], pairs)
    return {i: (links[i], top[i], top[i] == i) for i, _ in rows}


def repeats(rows, length=20):
    """{(doc_id, text): (n_words, removed places, kept words)}; documents in order of their ids, null first, then of their texts' digests."""
    seen, out = set(), {}
    for i, text in sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0], sha(r[1]))):
        w = words(text)
        gone = set()
        for k in range(len(w) - length + 1):
            window = tuple(w[k : k + length])
            if window in seen:
                gone.update(range(k, k + length))
            seen.add(window)
        out[i, text] = (len(w), gone, [x for k, x in enumerate(w) if k not in gone])
    return out


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def fingerprint_groups(rows):
    fp = {i: fingerprint(t) for i, t in rows}
    ids = sorted(fp)
    return fp, roots(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 2])


def quality(text):
    w, text = words(text), text or ""
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    often = Counter(windows)
    covered = {k + j for k, x in enumerate(windows) if often[x] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
