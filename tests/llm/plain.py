"""The operators' results by definition, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingle_set(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def sha(data):
    return hashlib.sha256(data).hexdigest()


def cut_bytes(docs, size):
    texts = [(t or "").encode() for _, t in docs]
    seen = Counter(t[p : p + size] for t in texts for p in range(len(t) - size + 1))
    out = []
    for (i, _), t in zip(docs, texts):
        gone = [False] * len(t)
        for p in range(len(t) - size + 1):
            if seen[t[p : p + size]] > 1:
                gone[p : p + size] = [True] * size
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone) if not g))))
    return out


def components(docs, n, num, den):
    sets = [shingle_set(t, n) for _, t in docs]
    root = list(range(len(docs)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return [(docs[k][0], len(sets[k]), docs[top(k)][0]) for k in range(len(docs))]


def items_inside(docs, items, n=5, percent=80):
    out = []
    for i, text in docs:
        for j, item in items:
            want = shingle_set(item, n)
            short = len(next(iter(want))) if want else n
            w = words(text)
            have = {tuple(w[k : k + short]) for k in range(len(w) - short + 1)}
            if want and 100 * len(want & have) >= percent * len(want):
                out.append((i, j, len(want & have), len(want)))
    return out


def cut_lines(docs, run):
    seen, out = set(), []
    for i, text in docs:
        lines = (text or "").split("\n")
        spoken = [k for k, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for k in range(len(spoken) - run + 1):
            key = tuple(lines[m].strip(" \t\n\x0b\x0c\r") for m in spoken[k : k + run])
            if key in seen:
                gone |= set(spoken[k : k + run])
            seen.add(key)
        flags = [k in gone for k in spoken]
        spans = sum(g and (k == 0 or not flags[k - 1]) for k, g in enumerate(flags))
        out.append((i, len(spoken), len(gone), spans, sha("\n".join(x for k, x in enumerate(lines) if k not in gone).encode())))
    return out


def score_all(docs, order=4):
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs]
    padded = [b"\n" * order + (t or "").encode() + b"\xff" for _, t in docs]
    counts, follow = Counter(), [{} for _ in range(order + 1)]
    for (_, text), h, b in zip(docs, held, padded):
        if h:
            continue
        counts.update([*words(text), None])
        for p in range(order, len(b)):
            for k in range(order + 1):
                follow[k].setdefault(b[p - k : p], Counter())[b[p]] += 1

    def log_p(before, x):
        excluded, escape = set(), 0.0
        for k in range(order, -1, -1):
            seen = {s: n for s, n in follow[k].get(before[order - k :], {}).items() if s not in excluded}
            if not seen:
                continue
            total = sum(seen.values()) + (len(seen) if 256 - len(excluded) > len(seen) else 0)
            if x in seen:
                return escape + math.log10(seen[x] / total)
            escape += math.log10(len(seen) / total)
            excluded |= set(seen)
        return escape - math.log10(256 - len(excluded))

    n, v, out = sum(counts.values()), len(counts), []
    for (i, text), h, b in zip(docs, held, padded):
        tokens = [*words(text), None]
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
        out.append((i, h, len(tokens), sum(counts[t] > 0 for t in tokens), n, base, sum(log_p(b[p - order : p], b[p]) for p in range(order, len(b)))))
    return out


def trie(rows):
    """Every distinct prefix of the rebuilt conversations, by definition."""
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            turns.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    turns = {c: [(r, x) for _, r, x in sorted(v, key=lambda q: q[0])] for c, v in turns.items()}
    built, members = {}, {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(turns.get(c - c % 5, [])[:h] + v[h:])
        for d in range(len(built[c]) + 1):
            members.setdefault(built[c][:d], []).append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += not kids[p]
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(ends.encode())))
    return sorted(out, key=lambda r: r[:2])


def spelling(docs, least_length=5, least_count=3):
    """(word, form, root, n, n_near, form_n) by definition."""
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least_length and c >= least_count}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
        return a != b and len(b) - len(a) < 2 and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :])

    others = {w: [x for x in n if near(w, x)] for w in n}
    best = {w: min(o, key=lambda x: (-n[x], x)) for w, o in others.items() if o}
    form = {w: b for w, b in best.items() if n[b] >= 2 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w, ""), root(w), n[w], len(others[w]), n.get(form.get(w), -1)) for w in n)
