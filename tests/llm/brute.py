"""Plain versions of what the operators compute, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def secrets(text):
    text = text or ""
    found = []
    low = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    n = [0, 0, 0]
    for kind, (name, pattern, ok) in enumerate((("assign", low, lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24))):
        for m in pattern.finditer(text):
            if ok(m):
                found.append((m.start(), kind, f"{name}:{m.start()}:{m.end()}"))
                n[kind] += 1
    return *n, sha(",".join(x[2] for x in sorted(found)))


def words3(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(docs, items):
    windows = {}
    for item, text in items:
        w = words3(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    sizes = {len(x) for x in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words3(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def shingles(text, width=4):
    w = (text or "").translate(LOWER).encode().split()
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def near(docs, width=4):
    sets = {d: shingles(t, width) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    common = Counter((a, b) for own in holders.values() for i, a in enumerate(own) for b in own[i + 1 :])
    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def unigram(docs):
    tokens = {i: [*(t or "").translate(LOWER).encode().split(), None] for i, (_, t) in enumerate(docs)}
    held = {i: zlib.crc32(str(d).encode()) % 10 == 0 for i, (d, _) in enumerate(docs)}
    c = Counter(x for i, own in tokens.items() if not held[i] for x in own)
    n, v = sum(c.values()), len(c)
    return [(d, held[i], len(tokens[i]), sum(c[x] > 0 for x in tokens[i]), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens[i])) for i, (d, _) in enumerate(docs)]


def repeats(docs, length):
    seen = Counter()
    raws = [(d, (t or "").encode()) for d, t in docs]
    for _, raw in raws:
        seen.update(raw[k : k + length] for k in range(len(raw) - length + 1))
    out = []
    for d, raw in raws:
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if seen[raw[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((d, len(raw), sum(gone), runs, sha(kept)))
    return out


def rule(url, rules):
    url = url or ""
    if "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = host.translate(LOWER)
    best = [h + p for h, p, _ in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(best, key=len, default=None)
