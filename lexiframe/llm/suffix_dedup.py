"""Repeated byte strings across documents, by suffix arrays of shards.

Every string of ``length`` bytes holds an anchor, the smallest hash of its ``gram``-byte substrings, so equal
strings have equal anchors. Stretches of consecutive strings with one anchor (contexts) are grouped by it; only
anchors that occur twice go on, and equal contexts count once, with their first place. Shards of whole groups are
sorted into a suffix array by induced sorting; permuted common prefixes of ``length`` bytes tell which strings are
equal, and all but the first of them are repeats. The contexts of one anchor that are too many for a shard are
taken apart into strings, which Spark groups by hash.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_is_set, bitmap_of, free_shuffles, mapped, stored, table, text_or_empty
from .suffix_array import permuted_lcp, suffix_array

MIX = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)]
MIX64 = np.uint64(0x9E3779B97F4A7C15)


def byte_codes(seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


def gram_hashes(a: np.ndarray, size: int, codes: np.ndarray) -> np.ndarray:
    """32-bit hash of each run of ``size`` bytes, from runs of half the size, and so on."""
    h, s, level = codes[a], 1, 0
    while s < size:
        more = min(s, size - s)  # the last step overlaps if the size is no power of two
        h = h[: len(h) - more] * MIX[level % len(MIX)] + h[more:]
        h ^= h >> np.uint32(15)
        s, level = s + more, level + 1
    return h | np.uint32(1)  # 0 stands for none


def long_hashes(a: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash (as signed) of the ``size`` bytes, eight at least, from each place on."""
    words = np.lib.stride_tricks.sliding_window_view(a, 8)
    h = np.full(len(places), size, dtype=np.uint64)
    for at in [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]:
        h = (h ^ np.ascontiguousarray(words[places + at]).view("<u8").ravel()) * MIX64
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    s = 1
    while s < width:
        more = min(s, width - s)
        h = np.minimum(h[: len(h) - more], h[more:])
        s += more
    return h


def chunks(texts: list, length: int, size: int = 1 << 18) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts of ``length`` bytes or more with their positions, some ``size`` bytes together."""
    where, raws, n = [], [], 0
    for k, text in enumerate(texts):
        raw = (text or "").encode()
        if len(raw) < length:
            continue
        where.append(k)
        raws.append(raw)
        n += len(raw)
        if n >= size:
            yield where, raws
            where, raws, n = [], [], 0
    if raws:
        yield where, raws


def anchors_of(raws: list[bytes], length: int, gram: int, codes: np.ndarray):
    """Of texts laid end to end: (bytes, lowest short hash of each string, which strings lie in one text, places of
    anchors, their short hashes). A place is an anchor if its gram has the lowest short hash of some string of
    ``length`` bytes that it lies in."""
    a = np.frombuffer(b"".join(raws), dtype=np.uint8)
    g, width = gram_hashes(a, gram, codes), length - gram + 1
    low = sliding_min(g, width)
    ends = np.cumsum([len(r) for r in raws])[:-1]
    crossing = np.zeros(len(low) + 1, dtype=np.int32)
    crossing[ends - length + 1] = 1
    crossing[ends] = -1
    whole = np.cumsum(crossing[:-1]) == 0
    edge = np.zeros(width - 1, dtype=np.uint32)
    most = ~sliding_min(~np.concatenate([edge, np.where(whole, low, np.uint32(0)), edge]), width)
    places = np.flatnonzero(g == most)
    return a, low, whole, places, g[places]


def anchor_keys(raws: list[bytes], length: int, gram: int, codes: np.ndarray) -> np.ndarray:
    """The long hash of every anchor of the texts."""
    a, _, _, places, _ = anchors_of(raws, length, gram, codes)
    return long_hashes(a, places, gram)


def contexts(raws: list[bytes], length: int, gram: int, codes: np.ndarray, longest: int = 256):
    """Stretches of strings with one anchor: (number of the text, long hash of the anchor, first start, number of
    starts, place of the anchor in the text, or -1 if it may have several)."""
    a, low, whole, places, values = anchors_of(raws, length, gram, codes)
    width, offsets = length - gram + 1, np.cumsum([0, *map(len, raws)])
    new = whole & np.append(True, (low[1:] != low[:-1]) | ~whole[:-1])
    begin, nth = np.flatnonzero(new), np.cumsum(whole)
    count = np.diff(np.append(nth[begin] - 1, nth[-1]))
    text = np.searchsorted(offsets, begin, side="right") - 1
    pairs = np.cumsum(np.append(False, values[1:] == values[:-1]))
    first, last = np.searchsorted(places, begin), np.searchsorted(places, begin + count + width - 1) - 1
    where, own = first.copy(), low[begin]
    while len(far := np.flatnonzero(values[where] != own)):
        where[far] += 1
    several = pairs[last] > pairs[first]
    at = np.where(several, -1, places[where] - offsets[text])
    out = [text, long_hashes(a, places[where], gram), begin - offsets[text], count, at]
    # A string's anchor is its first place. A stretch whose places have different long hashes (two grams of one
    # short hash) is parted by them, and one of a repeating pattern where it grows long.
    parted, more = np.zeros(len(begin), dtype=bool), []
    for k in np.flatnonzero(several).tolist():
        mine = places[first[k] : last[k] + 1][values[first[k] : last[k] + 1] == own[k]]
        named, n = long_hashes(a, mine, gram), int(count[k])
        if n <= longest and (named == named[0]).all():
            continue
        parted[k] = True
        of = named[np.searchsorted(mine, np.arange(begin[k], begin[k] + n))]
        cuts = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (np.arange(1, n) % longest == 0)))
        more += [(text[k], of[c], out[2][k] + c, e - c, -1) for c, e in zip(cuts.tolist(), np.append(cuts[1:], n).tolist())]
    if more:
        out = [np.append(x[~parted], np.array(y, dtype=np.int64)) for x, y in zip(out, zip(*more))]
    return out


def worth_sorting(group: list[tuple], length: int, gram: int) -> list[tuple]:
    """The contexts (id, th, start, anchor place, bytes) of one anchor that may share a string with another. Every
    string holds half of the bytes that it has beside the anchor on one side of it, so contexts that share
    neither side with another are left out; all stay if an anchor has several places."""
    group = list({c[:3]: c for c in group}.values())  # rows that repeat id and text are one document
    if any(c[3] < 0 for c in group):
        return group
    half = (length - gram) // 2
    left, right = Counter(), Counter()
    for i, th, start, at, raw in group:
        p = at - start
        left[raw[p - half : p] if p >= half else None] += 1
        right[raw[p + gram : p + gram + half] if len(raw) >= p + gram + half else None] += 1
    left[None] = right[None] = 0
    return [c for c in group if left[c[4][c[3] - c[2] - half : c[3] - c[2]] if c[3] - c[2] >= half else None] > 1
            or right[c[4][c[3] - c[2] + gram : c[3] - c[2] + gram + half] if len(c[4]) >= c[3] - c[2] + gram + half else None] > 1]


def repeats(shard: list[tuple], length: int) -> Iterator[tuple]:
    """Spans (id, th, start, end) of strings in a shard that are not the first of their kind. ``shard``: contexts
    as (id, th, start, anchor place, bytes)."""
    # characters: 0 ends the text, 1 parts contexts, bytes follow
    sizes = np.array([len(c[4]) for c in shard])
    at = np.cumsum(sizes + 1) - sizes - 1
    t = np.ones(int((sizes + 1).sum()) + 1, dtype=np.int32)
    flat = np.frombuffer(b"\0".join(c[4] for c in shard) + b"\0", dtype=np.uint8)
    t[:-1] = flat.astype(np.int32) + 2
    t[at + sizes] = 1
    t[-1] = 0
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(shard)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    is_start = np.full(len(t), -1, dtype=np.int64)
    is_start[at[owner] + offset] = np.arange(len(owner))
    sa = suffix_array(t, 258)
    places = sa[is_start[sa] >= 0]
    padded = np.zeros(len(flat) + length + 8, dtype=np.uint8)
    padded[: len(flat)] = flat
    new = permuted_lcp(padded, places, length) < length
    named = sorted({c[:2] for c in shard}, key=lambda d: (d[0] is not None, d))
    rank = {d: i for i, d in enumerate(named)}
    order = np.array([rank[c[:2]] for c in shard], dtype=np.int64)
    first = np.array([c[2] for c in shard], dtype=np.int64)
    which = is_start[places]
    # first in the order of documents, then of starts
    turn = np.lexsort((first[owner[which]] + offset[which], order[owner[which]], np.cumsum(new)))
    again = np.ones(len(owner), dtype=bool)
    again[which[turn[np.flatnonzero(np.append(True, np.diff(np.cumsum(new)[turn]) > 0))]]] = False
    starts = np.flatnonzero(again & np.append(True, ~(again[:-1] & (owner[1:] == owner[:-1]))))
    ends = np.flatnonzero(again & np.append(~(again[1:] & (owner[1:] == owner[:-1])), True))
    for a, b in zip(starts.tolist(), ends.tolist()):
        c = shard[owner[a]]
        yield c[0], c[1], int(c[2] + offset[a]), int(c[2] + offset[b] + length)


def repeat_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = 48,
                 slots: int = 1 << 27, shard_bytes: int = 1 << 20, group_limit: int = 1 << 14) -> DataFrame:
    """(id, th, start, end): bytes covered by strings that also start earlier; th is the hash of the text. Spans of
    one document may overlap. See ``remove_repeats`` for the order of documents."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))

    def anchors(batches):
        codes = byte_codes()
        for b in batches:
            got = [anchor_keys(raws, length, gram, codes) for _, raws in chunks(b.column(0).to_pylist(), length)]
            h, n = np.unique(np.concatenate([np.empty(0, np.int64), *got]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])

    twice = stored(mapped(rows.select("text"), anchors, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
                   .where("n > 1").select((F.pmod("h", F.lit(slots)) + 1).alias("slot")), "suffix-anchors")
    # a bitmap of the anchors that occur twice: at most slots / 32,768 rows of 4 KB reach the driver
    bits = np.zeros(slots // 8 + 4096, dtype=np.uint8)
    for r in bitmap_of(twice).toLocalIterator():
        bits[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def candidates(batches):
        codes, seen = byte_codes(), shared.value
        for b in batches:
            for which, raws in chunks(b.column(2).to_pylist(), length):
                text, h, start, n, at = contexts(raws, length, gram, codes)
                slot = h % slots
                hit = np.flatnonzero(seen[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                text, h, start, n, at = (x[hit] for x in (text, h, start, n, at))
                own = [raws[k][s : s + m + length - 1] for k, s, m in zip(text.tolist(), start.tolist(), n.tolist())]
                digest = np.fromiter(map(xxhash.xxh3_64_intdigest, own), dtype=np.uint64, count=len(own)).view(np.int64)
                row = pa.array(np.array(which)[text])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(digest), b.column(0).take(row), b.column(1).take(row), pa.array(start),
                     pa.array(n), pa.array(at), pa.array(own, pa.binary())], names)

    names = ["h", "c", "id", "th", "start", "n", "at", "context"]
    found = stored(mapped(rows, candidates, f"h long, c long, id {kind}, th long, start long, n long, at long, context binary"),
                   "suffix-contexts", compression="zstd")  # neighbouring contexts overlap
    # equal contexts (by anchor and own hash, 128 bits) count once, at their first place
    distinct = stored(found.groupBy("h", "c").agg(F.min(F.struct("id", "th", "start")).alias("first"), F.min("at").alias("at")),
                      "suffix-distinct")
    first = distinct.select(F.col("h").alias("gh"), F.col("c").alias("gc"), "first")
    # a context that is all the same as an earlier one is all repeats
    copies = stored(found.select("h", "c", "id", "th", "start", "n").join(
        first, (F.col("h") == F.col("gh")) & (F.col("c") == F.col("gc"))).where(
        ~F.struct("id", "th", "start").eqNullSafe(F.col("first"))).select(
        "id", "th", "start", (F.col("start") + F.col("n") + (length - 1)).alias("end")), "suffix-copies")
    groups = stored(distinct.groupBy("h").agg(F.count("*").alias("k"), F.min("at").alias("at"))
                    .where("k > 1 or at < 0").select(F.col("h").alias("kh"), "k"), "suffix-groups")
    # bytes are read for the first contexts of such groups; what a crowded slot lets through is only sorted in vain
    slot = F.pmod(F.xxhash64("h", "id", "th", "start"), F.lit(slots)) + 1
    needed = F.broadcast(stored(bitmap_of(distinct.join(groups, F.col("h") == F.col("kh")).select("h", "first.*")
                                          .select(slot.alias("slot"))), "suffix-needed"))
    several = found.select("h", "id", "th", "start", "at", "context", slot.alias("slot")).join(
        needed, F.expr("bitmap_bucket_number(slot)") == F.col("bucket")).where(bit_is_set("bits", "slot")).join(
        groups, F.col("h") == F.col("kh")).select("h", "k", "id", "th", "start", "at", "context")

    def sort_shards(batches):
        shard, size, group, last = [], 0, [], None
        for b in batches:
            out = []
            for h, *c in zip(*(b.column(k).to_pylist() for k in range(6))):
                if h != last:
                    group = worth_sorting(group, length, gram)
                    shard += group
                    size += sum(len(c[4]) for c in group)
                    if size >= shard_bytes:
                        out += repeats(shard, length)
                        shard, size = [], 0
                    group, last = [], h
                group.append(tuple(c))
            yield spans(out)
        shard += worth_sorting(group, length, gram)
        if shard:
            yield spans(list(repeats(shard, length)))

    def spans(out):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 4, [_arrow(kind), pa.int64(), pa.int64(), pa.int64()])],
            ["id", "th", "start", "end"])

    sortable = (several.where(F.col("k") <= group_limit).select("h", "id", "th", "start", "at", "context")
                .repartition("h").sortWithinPartitions("h"))
    sorted_ = mapped(sortable, sort_shards, f"id {kind}, th long, start long, end long")
    # groups beyond the limit: each string by itself, minima before the shuffle
    loose = several.where(F.col("k") > group_limit).select("id", "th", "start", "context", F.explode(
        F.sequence(F.lit(0), F.length("context") - length)).alias("o")).select(
        "id", "th", (F.col("start") + F.col("o")).alias("start"),
        F.sha2(F.expr(f"substring(context, o + 1, {length})"), 256).alias("s"))
    low = stored(loose.groupBy("s").agg(F.min(F.struct("id", "th", "start")).alias("low")).withColumnRenamed("s", "ls"), "suffix-loose")
    beyond = loose.join(low, F.col("s") == F.col("ls")).where(
        ~F.struct("id", "th", "start").eqNullSafe(F.col("low"))).select(
        "id", "th", "start", (F.col("start") + length).alias("end"))
    return copies.unionByName(sorted_).unionByName(beyond)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100,
                   with_text: bool = True, **options) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, ``with_text``,
    the bytes that stay.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document of smaller id,
    or before in the same. Null ids come first; documents that share an id are ordered by the hash of their text,
    and rows that repeat id and text are one document with one result for each. Null and empty texts have no
    bytes, texts shorter than ``length`` lose none. No rows give no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spans = repeat_spans(docs, id_col, text_col, length, **options)
    of_doc = stored(spans.groupBy("id", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
                    .select(F.col("id").alias("sid"), F.col("th").alias("sth"), "spans"), "suffix-spans")

    def cut(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part, out = b.slice(lo, 512), []
                for i, text, marks in zip(*(part.column(k).to_pylist() for k in range(3))):
                    raw, kept, end, runs, gone = (text or "").encode(), [], 0, 0, 0
                    for s, e in sorted((m["start"], m["end"]) for m in marks or []):
                        if s > end or not runs:
                            kept.append(raw[end:s])
                            runs, gone, end = runs + 1, gone + e - s, e
                        elif e > end:
                            gone, end = gone + e - end, e
                    rest = b"".join(kept) + raw[end:]
                    out.append((i, len(raw), gone, runs, hashlib.sha256(rest).hexdigest(), rest)[: len(names)])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * len(names), kinds)], names)

    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if with_text else 5]
    kinds = [_arrow(kind), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    free_shuffles(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), text_or_empty(F.col(text_col)).alias("text"))
    joined = rows.join(of_doc, F.col("id").eqNullSafe(F.col("sid")) & (F.col("th") == F.col("sth")), "left").select("id", "text", "spans")
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return mapped(joined, cut, schema).withColumnRenamed("id", id_col)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def op9_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM d)),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM w),
m AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM f WHERE k > 1),
i AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM m),
s AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY ALL),
r AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM s),
t AS (SELECT doc_id, CAST(sum(r.b - r.a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(r.b) AS last,
             string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) AS kept FROM r JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""

QUERIES = {"op9_suffix_dedup": (op9_suffix_dedup, SQL)}
