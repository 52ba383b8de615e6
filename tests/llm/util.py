"""Small document tables with the awkward cases, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re

WORDS = "the of house river stone green walk table under light seven apple often birds winter paper road quiet lamp".split()


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice(WORDS) if r.random() < 0.5 else "") for _ in range(n))


def edge_rows() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars, kept, key): ties, repeats, nulls, empty and long texts."""
    a, b, long = prose(60, 1), prose(80, 2), prose(9000, 3)
    near = b.split()
    near[40] = "changed"
    texts = [(1, a), (2, a), (3, None), (4, ""), (5, b), (6, " ".join(near)), (7, long), (7, long), (8, a.replace(" ", " \t\n")),
             (9, "  "), (None, "no id at all, only text"), (None, None), (10, "x"), (11, "é ß ñ 漢字 \U0001F600 " * 30), (12, long[:5000] + "!" + long[5000:]),
             (13, "ab" * 400), (14, "one two three four"), (15, "one two three four")]
    return [(i, t, "en", None, None if t is None else len(t), "extra", 5) for i, t in texts]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, `key` int"


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def order(i) -> tuple:
    return (i is not None, i or 0)


def brute_exact(rows):
    groups: dict[str, list] = {}
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    out = []
    for i, t in norm:
        keep = min((x for x in groups[t] if x is not None), default=None)
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return out


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_contaminated(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = []
    for item, t in items:
        w = word.findall(lower(t))
        n = min(13, len(w))
        wins += [(item, w[i : i + n]) for i in range(len(w) - n + 1)] if n else []
    out = []
    for i, t in rows:
        w = word.findall(lower(t))
        hit, found = set(), set()
        for item, g in wins:
            for p in range(len(w) - len(g) + 1):
                if w[p : p + len(g)] == g:
                    hit |= set(range(p, p + len(g)))
                    found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def brute_near(rows, percent=85):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * len(sets[x] | sets[y]):
                parent[root(x)] = root(y)
    out = []
    for x, (i, _) in enumerate(rows):
        same = [rows[y][0] for y in range(len(rows)) if root(y) == root(x)]
        low = min((s for s in same if s is not None), default=None) if sets[x] else i
        out.append((i, len(sets[x]), low, i == low))
    return out


def brute_repeats(rows, length):
    """rows: distinct (id, th, text); repeats of a row are one document."""
    seen, out = set(), {}
    for i, th, t in sorted({(i, th, t or "") for i, th, t in rows}, key=lambda d: (order(d[0]), d[1])):
        raw = t.encode()
        mark = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            g = raw[s : s + length]
            if g in seen:
                mark[s : s + length] = b"\1" * length
            seen.add(g)
        runs = sum(1 for k in range(len(mark)) if mark[k] and (not k or not mark[k - 1]))
        rest = bytes(x for x, m in zip(raw, mark) if not m)
        out[i, t] = (i, len(raw), sum(mark), runs, hashlib.sha256(rest).hexdigest())
    return out


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)


def want(rows):
    return sorted(rows, key=repr)
