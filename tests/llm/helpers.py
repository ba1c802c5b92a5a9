"""Helpers of the tests: invented prose, and near-duplicate classes by brute force."""

import random
import re


def prose(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    vowels = "aeiou"
    return ["".join(r.choice("bdfgklmnprstv") + r.choice(vowels) for _ in range(r.randint(1, 4))) for _ in range(n)]


def sentences(seed: int, n: int) -> str:
    w = prose(seed, n)
    return " ".join(x + ("." if k % 9 == 8 else "") for k, x in enumerate(w))


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_near_classes(docs, similarity=0.8):
    """Smallest id of the component of each document under Jaccard similarity of five-word shingles."""
    sets = {i: shingles(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in docs}
