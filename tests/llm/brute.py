"""Plain versions of what the operators compute."""

import hashlib

import xxhash


def brute_repeats(rows, window=13):
    """(words, removed, kept text's digest) of each (doc_id, text); a null id is larger than all others."""
    words = [(r[0] is None, r[0] or 0, (r[1] or "").encode().split()) for r in rows]
    first = {}
    for none, d, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, (none, d)), (none, d))
    out = []
    for none, d, w in words:
        gone = {p for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < (none, d) for p in range(i, i + window)}
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


def brute_fingerprint(text):
    words = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    k = min(4, len(words))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)] if words else []
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))
