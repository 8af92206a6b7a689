"""Brute force that several tests compare with."""

import hashlib
import re
from collections import Counter

WORD = r"[^\x20\x09-\x0D]+"


def sha(b) -> str:
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def words_removed(rows, span):
    seen, out = set(), {}
    for doc_id, text, *_ in sorted(rows, key=lambda r: r[0]):
        words, gone = re.findall(WORD, text or ""), set()
        for i in range(len(words) - span + 1):
            w = tuple(words[i : i + span])
            gone |= set(range(i, i + span)) if w in seen else set()
            seen.add(w)
        out[doc_id] = (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
    return out


def bytes_removed(rows, span):
    raw = {r[0]: (r[1] or "").encode() for r in rows}
    seen = Counter(b[i : i + span] for b in raw.values() for i in range(len(b) - span + 1))
    out = {}
    for d, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                gone[i : i + span] = b"\x01" * span
        out[d] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def by_hand(text: str | None) -> int:
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints: dict, budget: int) -> dict:
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= budget:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in prints}
