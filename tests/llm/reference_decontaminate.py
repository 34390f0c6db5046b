"""Brute force for decontamination: every window of every item at every place of every text."""

import hashlib
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    wins = set()
    for item_id, text in items:
        w = words(text)
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            wins.add((tuple(w[s : s + n]), item_id))
    by, lengths = {}, {len(x) for x, _ in wins}
    for x, item_id in wins:
        by.setdefault(x, set()).add(item_id)
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                found = by.get(tuple(w[s : s + n]))
                if found:
                    hit.update(range(s, s + n))
                    ids |= found
        ids = sorted(str(i) for i in ids if i is not None)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out
