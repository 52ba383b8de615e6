"""Benchmark decontamination by winnowing.

Of every window of words the fingerprint is its smallest k-gram hash; a stretch shared by a document and an item
that is as long as the window has the same smallest hash in both. With windows of ``window`` words that is
``window`` - k + 1 k-grams to choose from, so every shared span of ``window`` words is found. Document and item
windows are joined on the fingerprint and, to extend the hit, on their words. An item shorter than a window is one
window of its own length, found by the hash of all its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bitmap_of, mapped, stored, table

#: a word is a run of these bytes after lower-casing A-Z: digits, a-z, all of any character beyond ASCII
SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """64-bit hash of each word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(SPLIT).split()


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, from the words' hashes."""
    if len(h) < k:
        return h[:0]
    g = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        g = (g ^ (g >> np.uint64(31))) * MIX + h[i : len(h) - k + 1 + i]
    return g ^ (g >> np.uint64(29))


def fingerprints(h: np.ndarray, window: int, k: int) -> np.ndarray:
    """The smallest k-gram hash of each window of ``window`` words."""
    g = grams(h, k)
    n = len(h) - window + 1
    if n <= 0:
        return g[:0]
    m = g[:n].copy()
    for i in range(1, window - k + 1):
        np.minimum(m, g[i : i + n], out=m)
    return m


def slot_of(h: np.ndarray, slots: int) -> np.ndarray:
    return (h >> np.uint64(16)) % np.uint64(slots)


def find_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text: str = "text", window: int = 13, k: int = 5,
               slots: int = 1 << 24) -> tuple[DataFrame, DataFrame]:
    """(documents, occurrences). Documents: ``row`` (a number of the row of ``docs``), ``id``, ``th`` (xxhash64 of the
    text), ``n_words``;
    occurrences: ``row``, ``start``, ``n`` (words), ``item``, one row for each place and item.

    Null or wordless texts have no words and no occurrences, in documents and items alike; null ids are kept.
    Rows that repeat an id are documents of their own; items that repeat an id are one item. Empty tables give
    empty results. Before the join a bitmap of the items' fingerprints (``slots`` bits, so of bounded size)
    holds back windows that no item can have.
    """
    item_kind = items.schema[item_col].dataType.simpleString()

    def item_windows(batches):
        known = Hashes()
        for b in batches:
            out = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words_of(text)
                h = np.array([known[x] for x in w], dtype=np.uint64)
                size = min(window, len(w))
                if not size:
                    continue
                fp = fingerprints(h, window, k) if size == window else grams(h, size)
                slot = slot_of(fp, slots)
                out += [(item, size, f, s + 1, " ".join(x.decode("utf-8", "surrogatepass") for x in w[i : i + size]))
                        for i, (f, s) in enumerate(zip(fp.view(np.int64).tolist(), slot.tolist()))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 5,
                                                [b.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.string()])],
                ["item", "n", "fp", "slot", "gram"])

    texts = items.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text"))
    wanted = stored(mapped(texts, item_windows, f"item {item_kind}, n int, fp long, slot long, gram string").distinct(),
                    "decon-items")
    sizes = sorted(r["n"] for r in wanted.select("n").distinct().collect())  # at most ``window`` numbers
    marked = np.zeros(slots // 8 + 4096, dtype=np.uint8)
    for r in bitmap_of(wanted.select("slot").distinct()).collect():  # at most slots / 32,768 rows of 4 KB
        at = (r["bucket"] - 1) * 4096
        marked[at : at + 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    maps = docs.sparkSession.sparkContext.broadcast(np.unpackbits(marked, bitorder="little")[:slots].tobytes())

    def doc_windows(batches):
        known, seen = Hashes(), np.frombuffer(maps.value, dtype=bool)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                n_words, found = [], []
                for text in part.column(3).to_pylist():
                    w = words_of(text)
                    n_words.append(len(w))
                    h = np.array([known[x] for x in w], dtype=np.uint64)
                    mine = []
                    for size in sizes:
                        fp = fingerprints(h, window, k) if size == window else grams(h, size)
                        for i in np.flatnonzero(seen[slot_of(fp, slots)]).tolist():
                            gram = " ".join(x.decode("utf-8", "surrogatepass") for x in w[i : i + size])
                            mine.append({"start": i, "n": size, "fp": int(fp[i].view(np.int64)), "gram": gram})
                    found.append(mine)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(n_words, pa.int64()), pa.array(found, pa.list_(pa.struct(
                        [("start", pa.int32()), ("n", pa.int32()), ("fp", pa.int64()), ("gram", pa.string())])))],
                    ["row", "id", "th", "n_words", "windows"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                        F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    scanned = stored(mapped(texts, doc_windows, f"row long, id {kind}, th long, n_words long, "
                                                "windows array<struct<start:int,n:int,fp:long,gram:string>>"),
                     "decon-documents")
    hits = scanned.select("row", F.explode("windows").alias("w")).select("row", "w.*")
    want = wanted.select(F.col("item"), F.col("fp").alias("wfp"), F.col("gram").alias("wgram"))
    found = hits.join(want, (F.col("fp") == F.col("wfp")) & (F.col("gram") == F.col("wgram")))
    return scanned.select("row", "id", "th", "n_words"), found.select("row", "start", "n", "item")


def decontaminate(docs: DataFrame, items: DataFrame, share: int = 20, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", with_hash: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``
    (a 1 / ``share`` of the words, and at least one, is inside an occurrence) and, ``with_hash``, the xxhash64 of
    the text as ``text_hash``. See ``find_spans`` for nulls."""
    rows, places = find_spans(docs, items, id_col, text_col, item_col, item_text)
    places = stored(places, "decon-places")
    spans = places.select("row", "start", (F.col("start") + F.col("n")).alias("end")).groupBy("row", "start").agg(
        F.max("end").alias("end"))
    # merge overlapping places: a word counts for the first span that reaches it
    before = W.partitionBy("row").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    hit = spans.withColumn("reached", F.coalesce(F.max("end").over(before), F.lit(0))).groupBy("row").agg(
        F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reached"))).cast("long").alias("hit"))
    named = places.select("row", F.col("item").cast("string").alias("item")).distinct().groupBy("row").agg(
        F.array_sort(F.collect_list("item")).alias("names"))
    out = rows.join(hit.join(named, "row"), "row", "left")
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    return out.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"),
        F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("names", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"), *[F.col("th").alias("text_hash")] * with_hash)


def op5_decontaminate(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _windows_sql(name: str, key: str, cut: str) -> str:
    return f"""
{name}_w AS (
  SELECT {key} AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {name}
), {name}_g AS (
  SELECT k, p, len, array_to_string(w[p + 1 : p + len], ' ') AS gram FROM (
    SELECT k, w, len, unnest(range(0, greatest(len(w) - len + 1, 0))) AS p FROM {cut})
)"""


SQL = f"""
WITH {_windows_sql("benchmark", "item_id", "(SELECT k, w, least(13, len(w)) AS len FROM benchmark_w WHERE len(w) > 0)")},
{_windows_sql("documents", "doc_id", "(SELECT d.k, d.w, l.len FROM documents_w d, (SELECT DISTINCT len FROM benchmark_g) l)")},
hits AS (SELECT d.k AS doc_id, d.p, d.len, b.k AS item_id FROM documents_g d JOIN (SELECT DISTINCT k, len, gram FROM benchmark_g) b
  ON d.len = b.len AND d.gram = b.gram),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + len)) AS q FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY 1)
SELECT d.k AS doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM documents_w d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""".replace("LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)",
            "LEFT JOIN words w ON w.doc_id = d.k LEFT JOIN items i ON i.doc_id = d.k")

QUERIES = {"op5_decontaminate": (op5_decontaminate, SQL)}
