"""Alignment of two tokenizers over the same bytes by galloping intersection of their token ends.

Both tokenizers cut the same bytes, so each gives a strictly growing list of end offsets. Every end of the shorter
list is looked for in the longer one by exponential and then binary search. The common ends cut both lists into
groups; the difference of two neighbouring ranks is the number of tokens that a group has on that side. A pair of
tokens that end together is a link.

Of two linked tokens the shorter one's bytes are a suffix of the longer one's, so the pairs that can occur are at
most as many as the two vocabularies have bytes (``pair_bound``), whatever the corpus. Their counts may therefore be
broadcast.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_symbols, vocabulary_path
from .common import mapped, stored, table

PART = 1000  # rows handed on at a time


class Pair:
    """The two tokenizers, the bytes of their tokens and the text of their ids."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor

        self.a, self.bytes_a = byte_level(path_a)
        self.b = SentencePieceProcessor(model_file=path_b)
        self.bytes_b = piece_bytes(self.b)
        self.size_a, self.size_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        # an id's text and what follows it: within a side, after side A, after side B
        self.words = np.array([b"%d%c" % (i, c) for c, n in (*((c, len(self.bytes_a)) for c in b",|"), *((c, len(self.bytes_b)) for c in b",;"))
                               for i in range(n)], dtype=object)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides, or nothing if one side does not cover the text to the byte."""
        a = np.array(self.a.encode_ordinary(" " + text), dtype=np.int64)
        b = np.array(self.b.encode(text), dtype=np.int64)
        raw = b" " + text.encode()
        if text and b"".join(self.bytes_a[a].tolist()) == raw and b"".join(self.bytes_b[b].tolist()) == raw:
            return a, b
        return None


def byte_level(path: str):
    """Encoder of a byte-level file (byte-pair encoding whose merges come in the order of their ids) and the bytes of
    each id. tiktoken runs the file's vocabulary at a sixth of the time of the library that the file is written for;
    special tokens' strings are plain text to it."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    made = [vocab["".join(m)] for m in merges]
    if spec["model"]["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or made != sorted(made):
        raise ValueError(f"{path}: not a plain byte-level file with merges in the order of ids")
    byte = {s: i for i, s in enumerate(byte_symbols())}
    special = {a["id"]: a["content"].encode() for a in spec["added_tokens"]}
    plain = {i: bytes(byte[c] for c in s) for s, i in vocab.items() if i not in special}
    encoder = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks={x: i for i, x in plain.items()}, special_tokens={})
    return encoder, _table(special | plain)


def piece_bytes(model) -> np.ndarray:
    """The bytes of each piece: U+2581 is a space, <0xHH> the byte HH."""
    return _table({i: bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
                   for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))})


def _table(label: dict[int, bytes]) -> np.ndarray:
    out = np.full(max(label) + 1, b"", dtype=object)
    for i, x in label.items():
        out[i] = x
    return out


def pair_bound(a: np.ndarray, b: np.ndarray) -> int:
    """How many pairs of tokens can end together: those of which one is a suffix of the other."""
    known_a, known_b = {x for x in a if x}, {x for x in b if x}
    return sum(x[k:] in known_b for x in known_a for k in range(len(x))) + sum(x[k:] in known_a for x in known_b for k in range(1, len(x)))


def gallop(keys: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each key the first place of ``ends`` that is not below it. Both grow strictly and the last of each is the
    same. A key starts at the place in proportion to its rank and doubles its steps, up or down, until it has the
    place between two steps; halving finds it there. All keys step at the same time."""
    n = len(ends)
    start = np.arange(len(keys)) * n // max(len(keys), 1)
    up = ends[start] < keys
    low, high = np.where(up, start, -1), np.where(up, n - 1, start)  # ends[low] < key <= ends[high]
    live, step = np.arange(len(keys)), 1
    while len(live):
        at = np.where(up[live], np.minimum(start[live] + step, n - 1), np.maximum(start[live] - step, -1))
        below = (at < 0) | (ends[at] < keys[live])
        low[live[below]], high[live[~below]] = at[below], at[~below]
        live, step = live[below == up[live]], 2 * step
    live = np.flatnonzero(high - low > 1)
    while len(live):
        mid = (low[live] + high[live]) // 2
        below = ends[mid] < keys[live]
        low[live[below]], high[live[~below]] = mid[below], mid[~below]
        live = live[high[live] - low[live] > 1]
    return high


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks, in each of two lists of ends, of the ends that they share."""
    if len(a) > len(b):
        return common_ends(b, a)[::-1]
    at = gallop(a, b)
    met = b[at] == a
    return np.flatnonzero(met), at[met]


def group_text(pair: Pair, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: ids of the groups, whose last tokens are given by rank."""
    from_a, from_b = np.concatenate(([0], last_a[:-1] + 1)), np.concatenate(([0], last_b[:-1] + 1))
    many_a, many_b = last_a + 1 - from_a, last_b + 1 - from_b  # rank differences
    na, nb = len(pair.bytes_a), len(pair.bytes_b)
    word_a, word_b = a.copy(), b + 2 * na
    word_a[last_a] += na
    word_b[last_b] += nb
    out = np.empty(len(a) + len(b), dtype=np.int64)
    out[np.arange(len(a)) + np.repeat(from_b, many_a)] = word_a
    out[np.arange(len(b)) + np.repeat(last_a + 1, many_b)] = word_b
    return b"".join(pair.words[out].tolist())[:-1]


_pairs: dict[tuple[str, str], Pair] = {}


def tokenizers(path_a: str, path_b: str) -> Pair:
    """The two tokenizers, loaded once per worker process."""
    if (path_a, path_b) not in _pairs:
        _pairs[path_a, path_b] = Pair(path_a, path_b)
    return _pairs[path_a, path_b]


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
          with_groups: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, ``n_a``, ``n_b``, ``n_groups``, ``groups_sha256``, ``links`` (for each pair
    that ends together the id of A times the size of B plus the id of B, as little-endian 32-bit integers) and, ``with_groups``, ``last_a`` and ``last_b``, the
    ranks of the last token of each group in A and B. ``path_a``: byte-level file of the tokenizers library,
    ``path_b``: model file of sentencepiece; every worker can read them.

    Null and empty texts, and texts that one of the two does not give back to the byte, have no tokens: zeros,
    nothing in the lists, and the digest is the empty string. Texts of any length are encoded whole. Null and repeated ids pass
    through; no other column is read. An empty table gives no rows.
    """

    def run(batches):
        pair = tokenizers(path_a, path_b)
        nb = len(pair.bytes_b)
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                counts, digests, links, cuts = [], [], [], []
                for text in part.column(1).to_pylist():
                    got = pair.encode(text or "")
                    if got is None:
                        counts.append((0, 0, 0))
                        digests.append("")
                        links.append(b"")
                        cuts.append((none, none))
                        continue
                    a, b = got
                    last_a, last_b = common_ends(np.cumsum(pair.size_a[a]), np.cumsum(pair.size_b[b]))
                    counts.append((len(a), len(b), len(last_a)))
                    digests.append(hashlib.sha256(group_text(pair, a, b, last_a, last_b)).hexdigest())
                    links.append((a[last_a] * nb + b[last_b]).astype("<i4").tobytes())
                    cuts.append((last_a.astype(np.int32), last_b.astype(np.int32)))
                columns = [part.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)), pa.array(digests, pa.string()), pa.array(links, pa.binary())]
                if with_groups:
                    columns += [_lists([c[k] for c in cuts]) for k in range(2)]
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    none = np.empty(0, dtype=np.int32)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "last_a", "last_b"]
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"
    return mapped(rows, run, schema + (", last_a array<int>, last_b array<int>" if with_groups else "")).withColumnRenamed("id", id_col)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, dtype=np.int32), *parts])))


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(``pair``, ``n``, ``best``): how many links of the whole corpus hold a pair, and whether no pair of its B id has
    more. At most ``pair_bound`` rows."""
    def tally(batches):
        for b in batches:
            pair, n = np.unique(np.frombuffer(b"".join(b.column(0).to_pylist()), "<i4"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n, pa.int64())], ["pair", "n"])

    counts = stored(mapped(aligned.select("links"), tally, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    top = counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("n").alias("top"))
    return counts.join(top, F.col("pair") % size_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def link_statistics(aligned: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``align`` (read twice: store it first) with ``n_links``, ``n_best`` (links whose pair is the most
    frequent of its B id, ties included) and ``count_sum`` (over the links, their pair's count)."""
    sc = aligned.sparkSession.sparkContext
    found = pair_counts(aligned, len(tokenizers(path_a, path_b).bytes_b)).orderBy("pair").toArrow()  # bounded by the vocabularies
    known = sc.broadcast([found.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")])

    def run(batches):
        pairs, n, best = known.value
        for b in batches:
            links = b.column(5).to_pylist()
            at = np.searchsorted(pairs, np.frombuffer(b"".join(links), "<i4"))
            size = np.array([len(x) // 4 for x in links], dtype=np.int64)
            to = np.cumsum(size)
            sums = [np.concatenate(([0], np.cumsum(x[at], dtype=np.int64))) for x in (best, n)]
            columns = [b.column(i) for i in range(4)] + [pa.array(x, pa.int64()) for x in (size, *(s[to] - s[to - size] for s in sums))]
            yield pa.RecordBatch.from_arrays([*columns, b.column(4)], names)

    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = aligned.select(F.col(id_col).alias("id"), "n_a", "n_b", "n_groups", "groups_sha256", "links")
    kind = rows.schema["id"].dataType.simpleString()
    return mapped(rows, run, f"id {kind}, " + ", ".join(f"{c} long" for c in names[1:7]) + ", groups_sha256 string").withColumnRenamed("id", id_col)


def op13_token_align(spark, sf_dir):
    paths = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return link_statistics(stored(align(docs, *paths, with_groups=False), "aligned"), *paths)


QUERIES = {"op13_token_align": (op13_token_align, None)}
