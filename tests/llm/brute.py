"""Plain Python statements of what the operators return, for comparison."""
from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

SECRETS = {
    "assign": re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
PERSONAL = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def sha(s) -> str:
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def secrets(text):
    """(n_assign, n_access, n_hex, base_sha256)."""
    found, good = [], {"assign": lambda m: len(m[2]) >= 12, "access": lambda m: len(m[0]) >= 18, "hex": lambda m: len(m[0]) >= 16}
    for rank, (kind, p) in enumerate(SECRETS.items()):
        found += [(m.start(), rank, m.end(), kind) for m in p.finditer(text or "") if good[kind](m)]
    found.sort()
    n = Counter(f[3] for f in found)
    return n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in found))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    """(n_email, n_ip, n_card, n_phone, base_sha256)."""
    only = lambda s: re.sub("[^0-9]", "", s)
    good = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m[0].split(".")),
            "card": lambda m: 13 <= len(only(m[0])) <= 19 and luhn(only(m[0])), "phone": lambda m: 9 <= len(only(m[0])) <= 15}
    found = [(kind, m.start(), m.end()) for kind, p in PERSONAL.items() for m in p.finditer(text or "") if good[kind](m)]
    n = Counter(f[0] for f in found)
    return *(n[k] for k in PERSONAL), sha(",".join(f"{k}:{s}:{e}" for k, s, e in found))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(docs):
    """{doc_id: (set size, component)} of (doc_id, text) rows with distinct ids."""
    sets, where = {d: shingles(t) for d, t in docs}, {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    links = []
    for d, s in sets.items():
        for e, n in Counter(e for x in s for e in where[x] if e < d).items():
            if 100 * n >= 75 * (len(s) + len(sets[e]) - n):
                links.append((d, e))
    comp = union_find(sets, links)
    return {d: (len(s), comp[d]) for d, s in sets.items()}


def contaminated(docs, items):
    """{(doc_id, item_id): (size, shared)}; an item of fewer than five words is one run of them."""
    sets, out, where = {i: shingles(t) for i, t in items}, {}, {}
    short = {len(words(t)) for _, t in items} & {1, 2, 3, 4}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    for d, t in docs:
        w = words(t)
        have = shingles(t) | {tuple(w[j:j + k]) for k in short for j in range(len(w) - k + 1)}
        for i, n in Counter(i for x in have for i in where.get(x, ())).items():
            if 100 * n >= 75 * len(sets[i]):
                out[d, i] = len(sets[i]), n
    return out


def crc(x) -> int:
    return zlib.crc32(str(x).encode())


def base_scores(docs):
    """{doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)}."""
    end, count = object(), Counter()
    tokens = {d: words(t) + [end] for d, t in docs}
    for d, t in tokens.items():
        if crc(d) % 10:
            count.update(t)
    n, v = sum(count.values()), len(count)
    return {d: (crc(d) % 10 == 0, len(t), sum(count[w] > 0 for w in t), n,
                sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for d, t in tokens.items()}


def bigram_scores(docs, mu):
    """{doc_id: log10 probability} under the smoothed bigram model, not quantised."""
    end, start, one, two = object(), object(), Counter(), Counter()
    tokens = {d: words(t) + [end] for d, t in docs}
    for d, t in tokens.items():
        if crc(d) % 10:
            one.update([start] + t)
            two.update(zip([start] + t, t))
    n, v = sum(one.values()) - one[start], len(one) - (start in one)
    p1 = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))
    return {d: sum(math.log10(two[u, w] / (one[u] + mu) + mu / (one[u] + mu) * p1(w)) for u, w in zip([start] + t, t))
            for d, t in tokens.items()}
