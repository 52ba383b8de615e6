"""Secret scan with a linear-chain conditional random field.

Tokens are tagged as beginning, inside or outside of a secret from their shape, their neighbours and features of
the file, and decoded by Viterbi. The field is trained (conditional likelihood, forward-backward) on a bounded
sample of documents whose fixed-format secrets are the labels, and then finds others that look and stand alike.
The fixed formats themselves are always reported.

Decoding is exact and skips most of a text: far from every token that looks unusual, the trained weights prove
that no path may leave the outside state (``Field.quiet_holds``), so only regions around such tokens are decoded.
If the weights do not prove it, whole texts are decoded.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, mapped, table, text_or_empty

# fixed values
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "field")

KEYWORDS = set("password passwd pwd secret token key apikey api access auth credential credentials private bearer".split())
TOKENS = re.compile(r"[^\W_]+|[^\s\w]|_")
#: where a token that is not quiet stands: digits, quotes and joining signs, mixed or all-upper case, very long runs, keywords
LOUD = [re.compile(x) for x in (r"[0-9_=+/:\"']+", r"[a-z](?=[A-Z])", r"[A-Z]{2,}", r"\b[^\W_]{24,}")]
LOUD_WORDS = ("passw", "pwd", "secret", "token", "key", "api", "access", "auth", "credential", "private", "bearer")
LOUD_WORD = re.compile("|".join(LOUD_WORDS), re.I | re.A)
O, B, I = 0, 1, 2
REACH, PAD = 3, 8  # neighbours that a token looks at; quiet tokens kept around a region


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed formats: (kind, start, end) in code points, leftmost and not overlapping within a kind."""
    low, out = text.lower(), []
    if any(n in low for n in NAMES):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def loud(text: str) -> list[tuple[int, int]]:
    """Where tokens that are not quiet stand, by start."""
    low = text.lower()
    hits = [m.span() for r in LOUD for m in r.finditer(text)]
    if any(w in low for w in LOUD_WORDS):
        hits += [m.span() for m in LOUD_WORD.finditer(text)]
    return sorted(hits)


def kind_of(token: str) -> str:
    """Class of a token, as its neighbours see it."""
    if not token[0].isalnum():
        return token if token in "=:\"'_/+-.@" else "sign"
    if token.lower() in KEYWORDS:
        return "keyword"
    digits = sum("0" <= c <= "9" for c in token)
    if digits:
        return "digits" if digits == len(token) else "mixed"
    if token.islower() or (token[0].isupper() and token[1:].islower()) or not token.isascii():
        return "word"
    return "upper" if token.isupper() and len(token) > 1 else "word" if len(token) == 1 else "camel"


def own_features(token: str) -> tuple[str, ...]:
    n, kind = len(token), kind_of(token)
    size = str(min(n, 4) if n < 6 else 6 if n < 8 else 8 if n < 12 else 12 if n < 16 else 16 if n < 20 else 20 if n < 24 else 24 if n < 32 else 32)
    if kind in ("word", "keyword") or not token[0].isalnum():
        return ("bias", "kind=" + kind, "letters=" + (size if n < 24 else "24+"))
    digits = sum(c.isdigit() for c in token)
    turns = sum(a.isdigit() != b.isdigit() or a.isupper() != b.isupper() for a, b in zip(token, token[1:]))
    hexa = all(c in "0123456789abcdef" for c in token)
    return ("bias", "kind=" + kind, "size=" + size, f"{kind}/{size}", f"digits={4 * digits // n}", f"turns={min(6, 8 * turns // n)}",
            f"hex={hexa}/{size}", "start=" + (token[:4] if token[:4].isupper() and n >= 16 else "-"))


def file_features(text: str) -> tuple[str, ...]:
    n = max(len(text), 1)
    return (f"file-signs={min(4, 200 * (text.count('=') + text.count('{') + text.count(';')) // n)}",
            f"file-lines={min(4, 100 * text.count(chr(10)) // n)}")


def beyond(text: str, tagged: list[tuple[int, int]], base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The spans of ``tagged`` with a letter or digit outside all ``base`` spans, in one walk over both by start."""
    out, covers, i = [], sorted((a, b) for _, a, b in base), 0
    end = 0  # of the base spans that begin before the place looked at
    for a, b in sorted(tagged):
        place = a
        while place < b:
            while i < len(covers) and covers[i][0] <= place:
                end = max(end, covers[i][1])
                i += 1
            if end > place:
                place = end
                continue
            stop = min(b, covers[i][0]) if i < len(covers) else b
            if any(c.isalnum() for c in text[place:stop]):
                out.append((a, b))
                break
            place = stop
    return out


class Field:
    """Weights of features (name -> three scores) and transitions. Features that training never saw weigh 0."""

    def __init__(self, weights: dict[str, list[float]], moves: list[list[float]]):
        self.weights, self.moves = weights, moves
        self.known: dict[str, tuple[list[float], str]] = {}
        self.skips = self.quiet_holds()

    def _sum(self, names) -> list[float]:
        rows = [self.weights[f] for f in names if f in self.weights]
        return [sum(r[y] for r in rows) for y in (O, B, I)]

    def quiet_holds(self) -> bool:
        """Whether the best path stays outside wherever all tokens within reach are quiet. ``least`` is how much
        outside leads at such a token at least. A run of k quiet tokens inside costs k times that; it must cost
        more than the transitions can give back: for every k that a region does not already hold (a run of
        PAD or more, whatever stands at its ends), and for short runs between outside tokens."""
        quiet = ["word", "sign", "-", ".", "@"]
        sizes = ["1", "2", "3", "4", "6", "8", "12", "16", "20"]
        least = min(self._lead(("bias", "kind=" + k, "letters=" + s)) for k in quiet for s in sizes)
        for d in [*range(-REACH, 0), *range(1, REACH + 1)]:
            least += min(self._lead((f"at{d}={k}", f"at{d}=edge")[j : j + 1]) for k in quiet for j in (0, 1))
        for group in ("file-signs", "file-lines"):
            least += min(self._lead((f"{group}={v}",)) for v in range(5))
        least += min(self._lead((f"gap={v}",)) for v in (True, False))
        t, inner = self.moves, (B, I)
        best = {y: t[O][y] for y in inner}
        for k in range(1, PAD + 1):
            if k * least <= max(best[y] + t[y][O] for y in inner) - (k + 1) * t[O][O]:
                return False
            best = {y: max(best[x] + t[x][y] for x in inner) for y in inner}
        step = least + t[O][O] - max(t[x][y] for x in inner for y in inner)
        ends = max(t[x][y] - t[x][O] for x in range(3) for y in inner) + max(t[x][y] - t[O][y] for x in inner for y in range(3))
        return step > 0 and PAD * step > ends + max(0.0, t[O][O] - max(t[x][y] for x in inner for y in inner))

    def _lead(self, names) -> float:
        s = self._sum(names)
        return s[O] - max(s[B], s[I])

    def token(self, token: str) -> tuple[list[float], str]:
        got = self.known.get(token)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[token] = (self._sum(own_features(token)), kind_of(token))
        return got

    def decode(self, text: str, lo: int, hi: int, file: list[float]) -> list[tuple[int, int]]:
        """Spans tagged as secret in ``text[lo:hi]``, split where white space stands between tokens."""
        found = list(TOKENS.finditer(text, lo, hi))
        if not found:
            return []
        own = [self.token(m[0]) for m in found]
        around = {k: [self.weights.get(f"at{d}={k}", ZERO) for d in OFFSETS] for k in {k for _, k in own} | {"edge"}}
        n, t, score, back = len(own), self.moves, None, []
        for i, (e, _) in enumerate(own):
            s = [e[y] + file[y] for y in (O, B, I)]
            for j, d in enumerate(OFFSETS):
                row = around[own[i + d][1] if 0 <= i + d < n else "edge"][j]
                s = [s[0] + row[0], s[1] + row[1], s[2] + row[2]]
            gap = self.weights.get(f"gap={i == 0 or found[i - 1].end() < found[i].start()}", ZERO)
            s = [s[0] + gap[0], s[1] + gap[1], s[2] + gap[2]]
            if score is None:
                score = s
                continue
            came = [max((O, B, I), key=lambda x: score[x] + t[x][y]) for y in (O, B, I)]
            score = [score[came[y]] + t[came[y]][y] + s[y] for y in (O, B, I)]
            back.append(came)
        y = max((O, B, I), key=lambda x: score[x])
        path = [y]
        for came in reversed(back):
            y = came[y]
            path.append(y)
        spans: list[list[int]] = []
        last = O
        for m, y in zip(found, reversed(path)):
            if y != O:
                if y == B or last == O or spans[-1][1] < m.start():
                    spans.append([m.start(), m.end()])
                else:
                    spans[-1][1] = m.end()
            last = y
        return [(a, b) for a, b in spans]

    def regions(self, text: str) -> list[tuple[int, int]]:
        """Stretches to decode: around what is not quiet, with PAD + REACH quiet tokens on each side."""
        if not self.skips:
            return [(0, len(text))]
        out: list[list[int]] = []
        margin = 24 * (PAD + REACH + 1) * 2  # quiet tokens have fewer than 24 characters
        for a, b in loud(text):
            if out and a - out[-1][1] < 2 * margin:
                out[-1][1] = max(b, out[-1][1])
            else:
                out.append([a, b])
        spans = []
        for a, b in out:
            lo = text.rfind(" ", 0, max(0, a - margin)) + 1 if a > margin else 0
            hi = text.find(" ", b + margin)
            spans.append((max(lo, spans[-1][1] if spans else 0), hi if hi >= 0 else len(text)))
        return spans

    def spans(self, text: str, least: int = 6) -> list[tuple[str, int, int]]:
        """Fixed formats and what the field tags of ``least`` characters or more, by start, then kind. What the field
        tags is left out if the fixed formats hold all its letters and digits."""
        found = base_spans(text)
        file = self._sum(file_features(text))
        tagged = [(a, b) for lo, hi in self.regions(text) for a, b in self.decode(text, lo, hi, file) if b - a >= least]
        found += [("field", a, b) for a, b in beyond(text, tagged, found)]
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


ZERO = [0.0, 0.0, 0.0]
OFFSETS = [*range(-REACH, 0), *range(1, REACH + 1)]


def sequences(texts: list[str], length: int = 40, most: int = 1500) -> list[tuple[list[list[str]], list[int]]]:
    """At most ``most`` training chains, features and tags of the tokens around a place: fixed-format secrets
    (half at most), one other unusual token of a text, and one place anywhere in it."""
    out, secrets = [], 0
    for n, text in enumerate(texts):
        if len(out) >= most:
            break
        secret = [(m.start(2), m.end(2)) if k == "assign" and (m := ASSIGN.match(text, a)) else (a, b) for k, a, b in base_spans(text)]
        centres = [a for a, _ in secret][: min(20, max(0, most // 2 - secrets))]
        secrets += len(centres)
        if len(out) < most // 2 + secrets:
            others = loud(text)
            centres += [others[n * 7919 % len(others)][0]] if others else []
            centres.append(n * 104729 % max(len(text), 1))
        file = file_features(text)
        for c in centres:
            lo = text.rfind(" ", 0, max(0, c - 140)) + 1
            found = list(TOKENS.finditer(text, lo, min(len(text), c + 220)))[:length]
            if not found:
                continue
            kinds = [kind_of(m[0]) for m in found]
            feats, tags = [], []
            for i, m in enumerate(found):
                near = [f"at{d}=" + (kinds[i + d] if 0 <= i + d < len(found) else "edge") for d in OFFSETS]
                feats.append([*own_features(m[0]), *near, f"gap={i == 0 or found[i - 1].end() < m.start()}", *file])
                inside = next(((a, b) for a, b in secret if a <= m.start() and m.end() <= b), None)
                tags.append(O if inside is None else B if m.start() == inside[0] or not tags or tags[-1] == O else I)
            out.append((feats, tags))
    return out


def fit(texts: list[str], rounds: int = 100, rate: float = 0.2, ridge: float = 2e-6) -> tuple[dict, list]:
    """Weights by full-batch gradient steps (Adam) on the conditional likelihood of the chains."""
    chains = sequences(texts)
    names = {f: i + 1 for i, f in enumerate(dict.fromkeys(f for feats, _ in chains for fs in feats for f in fs))}
    size = max((len(t) for _, t in chains), default=1)
    width = max((len(f) for feats, _ in chains for f in feats), default=1)
    ids = np.zeros((len(chains), size, width), dtype=np.int32)
    gold, real = np.zeros((len(chains), size), dtype=np.int8), np.zeros((len(chains), size), dtype=bool)
    for s, (feats, tags) in enumerate(chains):
        for i, fs in enumerate(feats):
            ids[s, i, : len(fs)] = [names[f] for f in fs]
        gold[s, : len(tags)], real[s, : len(tags)] = tags, True
    w, t = np.zeros((len(names) + 1, 3)), np.zeros((3, 3))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    total = max(1, int(real.sum()))
    both = real[:, 1:] & real[:, :-1]
    want = np.zeros((3, 3))
    np.add.at(want, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    target = np.eye(3)[gold] * real[..., None]
    flat, scale = ids.reshape(-1), 1000.0 / total
    for k in range(1, rounds + 1):
        e = w[ids].sum(axis=2) * real[..., None]
        a = np.empty_like(e)
        a[:, 0] = e[:, 0]
        for i in range(1, size):
            nxt = _lse(a[:, i - 1, :, None] + t, 1) + e[:, i]
            a[:, i] = np.where(real[:, i, None], nxt, a[:, i - 1])
        z = _lse(a[:, -1], 1)
        b, pair = np.zeros_like(e), np.zeros((3, 3))
        for i in range(size - 2, -1, -1):
            on = both[:, i]
            if on.any():
                inner = t + (e[:, i + 1] + b[:, i + 1])[:, None, :]
                b[on, i] = _lse(inner[on], 2)
                pair += np.exp(a[on, i, :, None] + inner[on] - z[on, None, None]).sum(axis=0)
        p = np.exp(a + b - z[:, None, None]) * real[..., None]
        g = (p - target).reshape(-1, 3)
        gw = np.stack([np.bincount(flat, np.repeat(g[:, y], width), len(names) + 1) for y in range(3)], axis=1) * scale
        gt = (pair - want) * scale
        gw += ridge * 1000 * w
        gw[0] = 0
        gt += ridge * 1000 * t
        for x, gx, m, v in ((w, gw, *state[:2]), (t, gt, *state[2:])):
            m += 0.1 * (gx - m)
            v += 0.01 * (gx * gx - v)
            x -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return {f: w[i].round(6).tolist() for f, i in names.items()}, t.round(6).tolist()


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 3000, max_chars: int = 20_000) -> tuple:
    """Fit on at most ``max_rows`` documents (of the smallest id hashes), the first ``max_chars`` characters of
    each. The bound is on learning alone: whole texts are scanned."""
    rows = docs.select(F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text"))
    got = hash_sample(rows, "h", max_rows).select("h", F.substring("text", 1, max_chars).alias("text")).collect()
    return fit([r["text"] for r in sorted(got, key=lambda r: (r["h"], r["text"] or "")) if r["text"]])


def scan(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_assign``, ``n_access``, ``n_hex``, ``n_field``, ``base_sha256``,
    ``spans`` (kind:start:end in code points by start, then kind).

    Null and empty texts have no spans. Texts are scanned whole. Null ids pass through; rows that repeat an id
    are scanned each. No rows give no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the weights of a few hundred features

    def run(batches):
        field = Field(*shared.value)
        for b in batches:
            counts, base, spans = [[] for _ in KINDS], [], []
            for text in b.column(1).to_pylist():
                got = field.spans(text)
                for k, c in zip(KINDS, counts):
                    c.append(sum(s[0] == k for s in got))
                written = [f"{k}:{a}:{z}" for k, a, z in got]
                base.append(hashlib.sha256(",".join(x for x in written if not x.startswith("field")).encode()).hexdigest())
                spans.append(",".join(written))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(spans, pa.string())],
                ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    return mapped(rows, run, f"id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
                  ).withColumnRenamed("id", id_col)


def op3_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs))


QUERIES = {"op3_secrets": (op3_secrets, None)}
