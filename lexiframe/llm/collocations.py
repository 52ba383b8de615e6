"""Phrases whose words keep together, found with mergeable Misra-Gries summaries and counted exactly.

First pass: runs of one to three words are hashed; the hash says to which of many hash partitions a run belongs. Each
block of texts gives one summary for each partition, and a partition's summaries are merged: counters are added, and
while there are more than the capacity, the first counter beyond it is subtracted from all. The capacity is more than
the partition's mass (its count of runs) divided by the threshold, so what is subtracted in all stays below the
threshold, and each run that reaches the threshold keeps a counter. The number of partitions grows with the corpus;
a summary's size does not.

Second pass: the runs whose hash survived (a bitmap of ``slots`` bits, bounded whatever the corpus, tells) are counted
by their words. Other runs that meet a survivor in a slot are counted too and fall to the threshold then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap_of, mapped, stored, table, text_or_empty

BREAK, BLANK = b".,;:!?\n\x0b\x0c\r", b" \t"
WORD = r"[^\x20\x09.,;:!?\x0A-\x0D]+"
BLOCK = 8 << 20  # bytes of text summarised at a time
MASS = 1 << 21  # runs in a hash partition, about


def _kinds() -> np.ndarray:
    kind = np.zeros(256, dtype=np.uint8)
    kind[list(BLANK)], kind[list(BREAK)] = 1, 2
    return kind


KIND = _kinds()
SMALL = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64 bits evenly."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD1B54A32D192ED03)
    return h ^ (h >> np.uint64(32))


class Block:
    """The distinct runs of one to three words of some texts, with their counts and hashes."""

    def __init__(self, texts: list[str], lang: str):
        raw = SMALL[np.frombuffer("\n".join([*texts, ""]).encode(), dtype=np.uint8)]
        kind = KIND[raw]
        inside = kind == 0
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        starts, ends = edge[::2], edge[1::2]  # the last byte is a line feed
        offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
        coded = words.dictionary_encode()
        self.words = coded.dictionary
        word = coded.indices.to_numpy().astype(np.int64)
        piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
        v = np.int64(max(len(self.words), 1))

        self.one = np.arange(len(self.words))
        pairs = np.flatnonzero(piece[:-1] == piece[1:])
        two, of, many_two = np.unique(word[pairs] * v + word[pairs + 1], return_inverse=True, return_counts=True)
        self.two = two // v, two % v
        at = np.full(len(word), -1, dtype=np.int64)
        at[pairs] = of
        triples = np.flatnonzero(piece[:-2] == piece[2:])
        three, many_three = np.unique(at[triples] * v + word[triples + 2], return_counts=True)
        self.three = self.two[0][three // v], self.two[1][three // v], three % v

        seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
        h = np.array([xxhash.xxh3_64_intdigest(w) for w in self.words.cast(pa.large_binary()).to_pylist()], dtype=np.uint64)
        first = mix(h + seed)
        second = mix(first[self.two[0]] * np.uint64(3) + h[self.two[1]])
        third = mix(mix(first[self.three[0]] * np.uint64(3) + h[self.three[1]]) * np.uint64(5) + h[self.three[2]])
        self.hashes = np.concatenate((first, second, third))
        self.counts = np.concatenate((np.bincount(word, minlength=len(self.words)), many_two, many_three))

    def phrases(self, chosen: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Text, words and count of the runs of a boolean choice."""
        ends = np.cumsum([len(self.one), len(self.two[0])])
        picks = np.split(chosen, ends)
        sides = [(self.one,), self.two, self.three]
        texts = []
        for pick, side in zip(picks, sides):
            got = [self.words.take(pa.array(x[pick])) for x in side]
            texts.append(got[0] if len(got) == 1 else pc.binary_join_element_wise(*got, pa.scalar(" ", pa.large_string())))
        length = np.repeat(np.array([1, 2, 3], dtype=np.int32), [int(p.sum()) for p in picks])
        return pa.concat_arrays(texts).cast(pa.string()), length, self.counts[chosen]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Block]]:
    """Blocks of whole texts of one language each, of columns language and text."""
    waiting: dict[str, list[str]] = {}
    size = 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            waiting.setdefault(lang, []).append(text)
            size += len(text)
            if size >= BLOCK:
                yield from ((k, Block(t, k)) for k, t in waiting.items())
                waiting, size = {}, 0
    yield from ((k, Block(t, k)) for k, t in waiting.items())


def partition_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), dtype=np.int64)


def slot_of(part, low, slots: int):
    """Place in the bitmap (from 0) of a run of a partition and the low half of its hash."""
    return (np.asarray(part, dtype=np.int64) * 2_654_435_761 + np.asarray(low, dtype=np.int64)) % slots


def merge(summaries: Iterator[tuple[np.ndarray, np.ndarray]], capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """One summary of at most ``capacity`` counters, and what was subtracted from any counter in all (never more than
    the mass of all divided by capacity + 1)."""
    keys, counts, less = np.empty(0, np.uint32), np.empty(0, np.int64), 0
    waiting, size = [], 0

    def add():
        nonlocal keys, counts, less
        all_keys = np.concatenate([keys, *(k for k, _ in waiting)])
        order = np.argsort(all_keys, kind="stable")
        all_keys = all_keys[order]
        new = np.flatnonzero(np.diff(all_keys, prepend=all_keys[:1] ^ np.uint32(1)))
        keys = all_keys[new]
        counts = np.add.reduceat(np.concatenate([counts, *(c for _, c in waiting)])[order], new)
        if len(keys) > capacity:
            cut = np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1]
            more = counts > cut
            keys, counts, less = keys[more], counts[more] - cut, less + int(cut)

    for s in summaries:
        waiting.append(s)
        size += len(s[0])
        if size > max(capacity, 1 << 18):
            add()
            waiting, size = [], 0
    if size:
        add()
    return keys, counts, less


def run_counts(docs: DataFrame, threshold: int, lang_col: str = "lang", text_col: str = "text", slots: int = 1 << 27) -> tuple[DataFrame, DataFrame]:
    """(``lang``, ``n``): words of each language; and (``lang``, ``phrase``, ``k``, ``f``): every run of ``k`` = 1 to 3
    words within a piece that occurs ``threshold`` times or more in its language, with its exact count."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), text_or_empty(F.col(text_col)).alias("text"))
    totals = stored(rows.groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit(WORD))).cast("long").alias("n")), "words")
    mass = 3 * (totals.agg(F.sum("n")).first()[0] or 0)
    bits = max(mass // MASS, 1).bit_length() - 1

    def summarise(batches):
        for _, block in blocks(batches):
            order = np.argsort(block.hashes)
            h, n = block.hashes[order], block.counts[order].astype(np.uint32)
            part, low = partition_of(h, bits), h.astype(np.uint32)
            parts, at = np.unique(part, return_index=True)
            ends = [*at[1:].tolist(), len(h)]
            for i in range(0, len(parts), 4096):
                cut = list(zip(at[i:i + 4096].tolist(), ends[i:i + 4096]))
                yield pa.RecordBatch.from_arrays([pa.array(parts[i:i + 4096]), pa.array([low[s:e].tobytes() for s, e in cut]),
                                                  pa.array([n[s:e].tobytes() for s, e in cut])], ["part", "keys", "counts"])

    def survivors(group: pa.Table) -> pa.Table:
        summaries = [(np.frombuffer(k, np.uint32), np.frombuffer(c, np.uint32).astype(np.int64))
                     for k, c in zip(group.column("keys").to_pylist(), group.column("counts").to_pylist())]
        capacity = sum(int(c.sum()) for _, c in summaries) // threshold + 1
        keys, counts, less = merge(iter(summaries), capacity)
        kept = keys[counts + less >= threshold]  # a count is at most what its counter shows and what was subtracted
        return pa.table({"slot": slot_of(group.column("part")[0].as_py(), kept, slots) + 1})

    summaries = mapped(rows, summarise, "part long, keys binary, counts binary")
    slot = summaries.groupBy("part").applyInArrow(survivors, "slot long")
    bits_found = np.zeros(slots // 8, dtype=np.uint8)
    for r in stored(bitmap_of(slot), "survivors").toLocalIterator():
        bits_found[(r["bucket"] - 1) * 4096:r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    known = spark.sparkContext.broadcast(bits_found)  # slots / 8 bytes, whatever the corpus

    def count(batches):
        for lang, block in blocks(batches):
            at = slot_of(partition_of(block.hashes, bits), block.hashes.astype(np.uint32), slots)
            phrase, length, n = block.phrases((known.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))
            for i in range(0, len(n), 65536):
                part = slice(i, i + 65536)
                size = len(n[part])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), phrase[part], pa.array(length[part], pa.int32()),
                                                  pa.array(n[part], pa.int64())], ["lang", "phrase", "k", "f"])

    exact = mapped(rows, count, "lang string, phrase string, k int, f long").groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f"))
    return totals, stored(exact.where(F.col("f") >= threshold), "runs")


def _with_count(df: DataFrame, part: str, counts: DataFrame, heavy: DataFrame, name: str) -> DataFrame:
    """``df`` with the count of its run ``part``. Counts of heavy runs come by broadcast; rows that have theirs take a
    key that nobody shares, so no key of the join holds many rows."""
    some = df.join(F.broadcast(heavy.select(F.col("lang").alias("__l"), F.col("phrase").alias("__p"), F.col("f").alias("__heavy"))),
                   (F.col("lang") == F.col("__l")) & (F.col(part) == F.col("__p")), "left").drop("__l", "__p")
    key = F.when(F.col("__heavy").isNull(), F.col(part)).otherwise(F.concat(F.lit("\n"), "phrase"))
    light = counts.select(F.col("lang").alias("__l"), F.col("phrase").alias("__p"), F.col("f").alias("__f"))
    return some.withColumn("__key", key).join(light, (F.col("lang") == F.col("__l")) & (F.col("__key") == F.col("__p")), "left").withColumn(
        name, F.coalesce("__heavy", "__f")).drop("__l", "__p", "__key", "__heavy", "__f")


def _cut(k: int, left: Column, right: Column) -> Column:
    return F.struct(F.lit(k).alias("cut"), left.alias("left"), right.alias("right"))


#: 1,000,000 a a / (l r), rounded down; counts of up to 14 digits give products of up to 37
SCORE = "(cast(1000000 as decimal(7, 0)) * cast(a as decimal(14, 0)) * cast(a as decimal(14, 0))) div (cast(l as decimal(14, 0)) * cast(r as decimal(14, 0)))"


def collocations(docs: DataFrame, threshold: int = 10, top: int = 2000, lang_col: str = "lang", text_col: str = "text",
                 slots: int = 1 << 27) -> DataFrame:
    """The ``top`` phrases of two or three words of each language: ``lang``, ``rank``, ``phrase``, ``a`` (its count,
    ``threshold`` at least), ``l`` and ``r`` (counts of the two parts of its lowest-scoring cut), ``n`` (words of the
    language), ``score``. A phrase inside a longer one at least half as frequent is dropped.

    Null languages are ``und``, null texts empty; rows that repeat count as often as they occur. No ids and no other
    columns are read. Texts of any length are read whole, and no phrase reaches over two of them. Empty tables, and
    texts without frequent phrases, give no rows. Equal scores go by count, then by the phrase's bytes.
    """
    totals, counts = run_counts(docs, threshold, lang_col, text_col, slots)
    words = totals.agg(F.sum("n")).first()[0] or 0
    heavy = counts.where(F.col("f") > words / 10_000)  # fewer than 10,000 of each length
    phrase, first = F.col("phrase"), F.substring_index("phrase", " ", 1)
    after = F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)")
    cuts = F.when(F.col("k") == 2, F.array(_cut(1, first, after))).otherwise(
        F.array(_cut(1, first, after), _cut(2, F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -1))))
    cut = counts.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.inline(cuts))
    cut = _with_count(_with_count(cut, "left", counts, heavy, "l"), "right", counts, heavy, "r")
    lowest = cut.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct(F.expr(SCORE).alias("score"), "cut", "l", "r")).alias("m"))

    longer = counts.where("k = 3").select("lang", "f", F.explode(F.array(F.substring_index(phrase, " ", 2), after)).alias("part"))
    longer = longer.groupBy(F.col("lang").alias("__l"), F.col("part").alias("__p")).agg(F.max("f").alias("longer"))
    kept = lowest.join(longer, (F.col("lang") == F.col("__l")) & (F.col("phrase") == F.col("__p")), "left").where(
        "longer is null or 100 * longer < 50 * a").select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    kept = stored(kept, "phrases")

    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    size = kept.count()
    level = 0
    while size > 3 * top:  # a language may hold all rows: its best come from buckets of it, level by level
        buckets = -(-size // (12 * top)) if size > 24 * top else 2
        bucket = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase", F.lit(level)), F.lit(buckets))).orderBy(*best)
        kept = kept.withColumn("rank", F.row_number().over(bucket)).where(F.col("rank") <= top).drop("rank")
        size, level = min(size - 1, buckets * top), level + 1
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    totals = totals.select(F.col("lang").alias("__l"), "n")
    return ranked.join(totals, F.col("lang") == F.col("__l")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces
), total AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
), runs AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM words
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words
), f AS (
  SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM runs GROUP BY lang, k, phrase HAVING count(*) >= 10
), cuts AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, x.cut, l.f AS l, r.f AS r,
         (1000000 * c.f::HUGEINT * c.f::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS score
  FROM f c JOIN (VALUES (1), (2)) x(cut) ON x.cut < c.k
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[:x.cut], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[x.cut + 1:], ' ')
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), longer AS (
  SELECT lang, part, max(f) AS f FROM (
    SELECT lang, f, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM f WHERE k = 3) GROUP BY lang, part
), ranked AS (
  SELECT p.*, row_number() OVER (PARTITION BY p.lang ORDER BY p.score DESC, p.a DESC, p.phrase) AS rank
  FROM lowest p LEFT JOIN longer g ON g.lang = p.lang AND g.part = p.phrase WHERE g.f IS NULL OR 100 * g.f < 50 * p.a
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

QUERIES = {"op12_collocations": (op12_collocations, SQL)}
