"""Byte-pair encoding as a tokenization automaton.

The states of the automaton are "after token t", its arcs are tokens, and a path spells a word exactly if it is
the word's byte-pair encoding. It starts with an arc for every symbol out of every state. Each merge (u, v) -> w,
in rank order, adds one gadget: the state after u is split, its copy loses the arc v, and wherever u could be
followed by v an arc w is laid. So a state inherits the arcs of the state after its right part as they were when
it was made, and an arc w leaves the states that its left part left at that time. ``Automaton`` keeps the gadgets
in this inherited form (two parts and a rank per token, one cut per merge), so compiling is linear in the merges;
rows of the transition table are filled in as words use them.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, table


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where printable, else the next free code point from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class Automaton:
    """Compiled merges. ``vocab``: symbol string -> id; ``merges``: pairs of strings in rank order."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], word_end: str):
        self.label = {i: s for s, i in vocab.items()}
        self.rank = {i: -1 for i in self.label}  # when the arc was laid; symbols are there from the start
        self.parts: dict[int, tuple[int, int]] = {}
        self.cut: dict[tuple[int, int], int] = {}
        self.dead: set[int] = set()  # merged tokens that no path reaches
        self.table: dict[int, dict[int, bool]] = {}
        for r, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if w in self.parts:
                raise ValueError(f"two merges make the token {a + b!r}")
            self.parts[w], self.rank[w] = (u, v), r
            if u in self.dead or v in self.dead or not self._arc(u, v, r):
                self.dead.add(w)
            self.cut.setdefault((u, v), r)
        live = [(s, i) for s, i in vocab.items() if i not in self.dead]
        ends = (lambda s: s.endswith(word_end)) if word_end else (lambda s: True)
        self.final = {s.removesuffix(word_end): i for s, i in live if ends(s)}  # arcs that end a word
        self.inner = {s: i for s, i in live if not (word_end and ends(s))}
        self.reach: dict[str, int] = {}  # the longest arc by its first four symbols
        for x in [*self.final, *self.inner]:
            self.reach[x[:4]] = max(len(x), self.reach.get(x[:4], 0))

    def _arc(self, t: int, x: int, now: int) -> bool:
        """Whether the state after t has an arc x just before the merge of rank ``now``."""
        rank, parts, cut = self.rank, self.parts, self.cut
        while True:
            if cut.get((t, x), now) < now:
                return False
            rt, rx = rank[t], rank[x]
            if rx > rt:  # the arc is younger than the state: laid where its left part had an arc
                u, v = parts[x]
                if u == v == t:
                    return False  # this copy had just lost the arc
                x, now = u, rx
            elif rt > rx:  # the state is younger: split off the state after its right part
                t, now = parts[t][1], rt
            elif rt < 0:  # two symbols
                return True
            else:  # a token after itself: its gadget laid the arc where its right part had an arc to its left part
                (x, t), now = parts[t], rt

    def encode(self, word: str) -> list[int]:
        """Ids of one word given as its byte symbols. One path alone spells it; longer arcs are tried first,
        and a state from which nothing led on (at a place) is not entered again."""
        n, reach, end, table = len(word), self.reach.get, len(self.rank), self.table
        inner, final = self.inner.get, self.final.get
        path, bad, state, j, i = [], set(), -1, 0, min(len(word), reach(word[:4], 3))
        while True:
            row = table.get(state)
            if row is None:
                row = table[state] = {}
            while i > j:
                x = inner(word[j:i]) if i < n else final(word[j:])
                if x is not None:
                    ok = row.get(x)
                    if ok is None:
                        ok = row[x] = state < 0 or self._arc(state, x, end)
                    if ok and (not bad or (i, x) not in bad):
                        break
                i -= 1
            if i > j:
                path.append((x, j, i))
                if i == n:
                    return [p[0] for p in path]
                state, j, i = x, i, min(n, i + reach(word[i:i + 4], 3))
            elif path:
                bad.add((j, state))
                _, j, i = path.pop()
                state, i = path[-1][0] if path else -1, i - 1
            else:
                raise ValueError(f"no path spells {word!r}")

    def forget(self, rows: int) -> None:
        """Drop the filled-in rows once there are more than ``rows``; they fill in again on use."""
        if len(self.table) > rows:
            self.table.clear()


class Codec:
    """Normaliser, word splitter, automaton and labels of one tokenizer file (BPE over byte symbols)."""

    def __init__(self, path: str, cached_words: int = 150_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]
                                         for a in spec["added_tokens"]):
            raise ValueError(f"{path}: not a plain byte-symbol BPE file")
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern).findall
        self.path, self.library = path, None
        self.automaton = Automaton({s: i for s, i in model["vocab"].items() if s not in self.special},
                                   [tuple(m) for m in model["merges"]], model["end_of_word_suffix"] or "")
        self.labels = np.array([""] * (max([*self.automaton.label, *self.special.values()]) + 1), dtype=object)
        for i, s in [*self.automaton.label.items(), *((i, s) for s, i in self.special.items())]:
            self.labels[i] = s
        self.symbols, self.cached_words = byte_symbols(), cached_words
        self.cache: dict[str, bytes] = {}

    def normalise(self, text: str) -> str:
        """NFC and lower case, each character for itself (sigma has no final form here)."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _newer_words(self, text: str) -> list[str]:
        """Words, as symbols, of a text with characters that Python's Unicode tables do not class."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        normal = self.library.normalizer.normalize_str(text)
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def _word(self, word: str) -> bytes:
        if len(self.cache) >= self.cached_words:
            self.cache.clear()
            self.automaton.forget(5_000)
        spelled = "".join(map(self.symbols.__getitem__, word.encode()))
        got = np.array(self.automaton.encode(spelled), dtype="<u4").tobytes()
        if len(word) <= 64:
            self.cache[word] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Special tokens' strings are those tokens."""
        out, cache, word = [], self.cache, self._word
        for piece in self.split_special.split(text) if self.split_special else [text]:
            if piece in self.special:
                out.append(np.uint32(self.special[piece]).tobytes())
            elif not piece.isascii() and any(unicodedata.category(ch) == "Cn" for ch in set(piece)):
                out += [np.array(self.automaton.encode(w), dtype="<u4").tobytes() for w in self._newer_words(piece)]
            else:
                out += [cache.get(w) or word(w) for w in self.words(self.normalise(piece))]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Labels of the arcs, one after the other; the file names no decoder, so a space parts them."""
        return " ".join(self.labels[np.frombuffer(ids, dtype="<u4")].tolist())


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a file, compiled once per worker process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, ``with_ids``, the
    ids themselves and the decoded text. ``path`` is the tokenizer file, which every worker can read.

    Null text is empty; an empty text has no ids and decodes to the empty text. Texts of any length are
    encoded whole. Null and repeated ids pass through. An empty table gives no rows.
    """

    def run(batches):
        c = codec(path)
        for b in batches:
            ids = [c.encode(t or "") for t in b.column(1).to_pylist()]
            decoded = [c.decode(x) for x in ids]
            columns = [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                       pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                       pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])]
            if with_ids:
                columns += [pa.array([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())),
                            pa.array(decoded)]
            yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    out = mapped(rows, run, schema + (", ids array<int>, decoded string" if with_ids else ""))
    return out.withColumnRenamed("id", id_col)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_bpe(spark, sf_dir):
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary_path(), with_ids=False)


QUERIES = {"op10_bpe": (op10_bpe, None)}
