"""Near duplicates by MinHash, banding and sequential Bayesian verification.

Documents with the same set of shingles are one class, and only classes are compared. Classes that agree in a
band of their signatures meet in a bucket. A bucket's pairs are compared by batches of signature values: after
each batch a pair is dropped if the posterior probability that its similarity reaches the threshold (uniform
prior) is below ``miss``. What survives is verified on the full shingle sets. Buckets with the same members are
compared once, and a pair only in the first band that it shares. Within a cell, pairs that accepted links already
connect are not verified again, so a cell returns fewer links than it has members, whatever its number of similar pairs.

A bucket of more than a chunk is compared in two steps, in cells of at most two chunks. First one chunk of its members,
chosen by hash, meets itself and every other chunk: two copies of each text. The links found so far, of all buckets,
give components; in most hot buckets nearly all members are then in one. Pairs inside a component need no comparison.
In the second step the members outside a bucket's largest component meet all of its members: every pair of different
components has such a member. A bucket that is one component is done.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, stored, table, with_hit
from .components import components
from .decontaminate import Hashes, grams

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text: str | None, known: Hashes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of ``size`` words (of all words, if there are fewer)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    return np.unique(grams(np.array([known[w] for w in words], dtype=np.uint64), min(size, len(words))))


def permutations(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), r.integers(0, 1 << 32, n, dtype=np.uint32)


def signature(s: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    x, low = (s >> np.uint64(32)).astype(np.uint32), np.full(len(mul), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, (x[i : i + 2048, None] * mul + add).min(axis=0), out=low)
    return low


def needed(n: int, percent: int, miss: float) -> int:
    """The fewest matches among n signature values at which the posterior probability of a similarity of
    ``percent`` or more is at least ``miss``: with a uniform prior it is P(Binomial(n + 1, t) <= matches)."""
    t, p = percent / 100, 0.0
    for m in range(n + 1):
        p += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if p >= miss:
            return m
    return n


def cell_links(sets, sigs: np.ndarray, sizes: np.ndarray, side: np.ndarray, band: int, rows: int, percent: int,
               need: list[tuple[int, int]], block: int = 1 << 16, labels: list | None = None) -> list[tuple[int, int]]:
    """Links (positions) that connect the members of a cell. ``sets(i)`` gives a member's shingles; ``side``: 0 or 1
    for the two chunks of a cell (pairs across), all 0 for pairs within one chunk. Members of one of the ``labels`` are
    connected already."""
    m = len(sizes)
    first = {}
    parent = [first.setdefault(x, i) for i, x in enumerate(range(m) if labels is None else labels)]
    group = np.array(parent)
    if side.any():
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side)
    else:
        left = right = np.arange(m)
    step, found = max(1, block // max(1, len(right))), []
    for lo in range(0, len(left), step):
        a, b = (x.ravel() for x in np.meshgrid(left[lo : lo + step], right, indexing="ij"))
        if not side.any():
            a, b = a[a < b], b[a < b]
        near = (100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b])) & (group[a] != group[b])
        a, b = a[near], b[near]
        agree, at = np.zeros(len(a), dtype=np.int32), 0
        for upto, least in need:
            agree += (sigs[a, at:upto] == sigs[b, at:upto]).sum(axis=1, dtype=np.int32)
            stay, at = agree >= least, upto
            a, b, agree = a[stay], b[stay], agree[stay]
        if len(a):
            same = (sigs[a] == sigs[b])[:, : sigs.shape[1] // rows * rows].reshape(len(a), -1, rows).all(axis=2)
            own = same.argmax(axis=1) == band
            found.append((a[own], b[own], agree[own]))
    if not found:
        return []
    a, b, agree = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(-agree, kind="stable")
    links = []

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, j in zip(a[order].tolist(), b[order].tolist()):
        ri, rj = root(i), root(j)
        if ri == rj:
            continue
        x, y = sets(i), sets(j)
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
        if 100 * both >= percent * (len(x) + len(y) - both):
            parent[ri] = rj
            links.append((i, j))
    return links


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 85,
               hashes: int = 128, band_rows: int = 5, miss: float = 1e-5, batch: int = 32,
               chunk: int = 768, with_hash: bool = False, slots: int = 1 << 23) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id``, ``kept`` and, ``with_hash``, the
    xxhash64 of the text as ``text_hash``.

    Documents are linked if 100 x shared shingles >= ``percent`` x all shingles of both; ``component_id`` is the
    smallest id that links reach, and ``kept`` says that the row has it. Null, empty and wordless texts have no
    shingles and are linked with nothing; their component is their own id. Null ids never become a component
    unless it has no other id. Rows that repeat an id with the same text share one decision. An empty table
    gives an empty result. A pair at the threshold shares no band with probability (1 - t^rows)^(hashes // rows),
    4e-7 at 85 and 5e-5 at 80, and is pruned with probability ``miss`` at most; above the threshold both fall quickly.
    ``chunk``: members on a side of a cell, about. ``slots``: bits of the bitmap that tells which texts are compared; when they fill, more texts shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    need = [(n, needed(n, percent, miss)) for n in range(batch, hashes + 1, batch)]
    bands = hashes // band_rows

    def sketch(batches):
        known, (mul, add) = Hashes(), permutations(hashes)
        for b in batches:
            n, keys, sigs = [], [], []
            for text in b.column(2).to_pylist():
                s = shingles(text, known, size)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s, mul, add).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(sigs, pa.binary())], ["id", "th", "n", "key", "sig"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"),
                       F.col(text_col).cast("string").alias("text"))
    known = stored(mapped(rows, sketch, f"id {kind}, th long, n long, key binary, sig binary"), "near-sketches")
    classes = stored(known.where("n > 0").groupBy("key").agg(
        F.min(F.struct("id", "th")).alias("rep"), F.min("id").alias("first"), F.any_value("sig").alias("sig"),
        F.any_value("n").alias("n")), "near-classes")
    width = 4 * band_rows
    member = classes.select("key", F.posexplode(F.expr(
        f"transform(sequence(0, {bands - 1}), b -> xxhash64(b, substring(sig, b * {width} + 1, {width})))")
    ).alias("band", "h"))
    buckets = member.groupBy("band", "h").agg(
        F.count("*").alias("m"), F.bit_xor(F.xxhash64("key")).alias("x"),
        F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")).where("m > 1")
    # of buckets with the same members the one of the lowest band; every pair's first shared band stays
    buckets = stored(buckets.groupBy("m", "x", "y").agg(F.min(F.struct("band", "h")).alias("s"))
                     .select(F.col("s.band").alias("bband"), F.col("s.h").alias("bh"), "m"), "near-buckets")
    met = stored(member.join(buckets, (F.col("band") == F.col("bband")) & (F.col("h") == F.col("bh"))).select(
        "key", "band", "h", F.ceil(F.col("m") / F.lit(chunk)).cast("int").alias("chunks")), "near-members")
    asked = stored(met.select("key").distinct().join(classes.select("key", "rep", "sig", "n"), "key").select(
        "key", "sig", "n", F.col("rep.id").alias("rid"), F.col("rep.th").alias("rth")), "near-asked")
    likely = with_hit(rows, ["id", "th"], asked.select("rid", "rth"), slots).where("__hit").drop("__hit")
    texts = stored(likely.join(asked, F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth")))
                   .select(F.col("key").alias("tkey"), "sig", "n", "text").dropDuplicates(["tkey"]), "near-texts")
    chunk_of = F.pmod(F.xxhash64("key", "band"), F.col("chunks")).cast("int")
    met = met.withColumn("c", chunk_of)
    cell = ["band", "h", "i", "j"]
    columns = [*cell, "side", "label", "key", "sig", "n", "text"]

    def solved(cells):
        """Links of the cells (``cell`` columns; ``j`` above 0: pairs across sides)."""
        cells = cells.join(texts, F.col("key") == F.col("tkey")).select(columns)
        cells = cells.repartition(*cell).sortWithinPartitions(*cell)
        return stored(mapped(cells, link, "a binary, b binary").distinct(), "near-links")

    def link(batches):
        words = Hashes()

        def solve(cell, sides, labels, keys, sigs, sizes, texts):
            band, _, _, j = cell
            cache = {}

            def sets(k):
                if k not in cache:
                    cache[k] = shingles(texts[k], words, size)
                return cache[k]

            side = np.array(sides)
            if len(keys) < 2 or (j > 0 and (side.all() or not side.any())):
                return []
            got = cell_links(sets, np.frombuffer(b"".join(sigs), dtype=np.uint32).reshape(len(keys), -1),
                             np.array(sizes), side, band, band_rows, percent, need, labels=labels)
            return [(keys[x], keys[y]) for x, y in got]

        held, at = None, None
        for b in batches:
            out = []
            d = b.to_pydict()
            for row in zip(*[d[c] for c in columns]):
                if row[:4] != at:
                    if held:
                        out += solve(at, *held)
                    at, held = row[:4], ([], [], [], [], [], [])
                for x, v in zip(held, row[4:]):
                    x.append(v)
            yield _pairs(out)
        if held:
            yield _pairs(solve(at, *held))

    # chunk 0 meets itself (j = 0) and every other chunk
    links = solved(met.withColumn("j", F.explode(F.expr("if(c = 0, sequence(0, chunks - 1), array(c))"))).select(
        "band", "h", F.lit(0).alias("i"), "j", (F.col("c") > 0).cast("int").alias("side"), F.col("key").alias("label"), "key"))
    hot = met.where("chunks > 1")
    if not hot.isEmpty():
        tree = components(links)
        hot = stored(hot.join(tree, F.col("key") == F.col("node"), "left").select(
            "key", "band", "h", "c", "chunks", F.coalesce("root", "key").alias("label")), "near-hot")
        # the bucket's largest component, one row a chunk, so that the rows of a hot bucket are not one key
        most = hot.groupBy("band", "h", "chunks", "label").agg(F.count("*").alias("k")).groupBy("band", "h", "chunks").agg(
            F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("all"))
        most = most.select(F.col("band").alias("mband"), F.col("h").alias("mh"), F.col("top.label").alias("mlabel"), F.ceil(
            (F.col("all") - F.col("top.k")) / F.lit(chunk)).cast("int").alias("parts"), "chunks").where("parts > 0")
        most = most.withColumn("mc", F.explode(F.expr("sequence(0, chunks - 1)"))).drop("chunks")
        rest = hot.join(most, (F.col("band") == F.col("mband")) & (F.col("h") == F.col("mh")) & (F.col("c") == F.col("mc")))
        part = F.pmod(F.xxhash64("key", "band", F.lit(1)), F.col("parts")).cast("int")
        outside = rest.where("label <> mlabel").withColumn("i", part).withColumn(
            "j", F.explode(F.expr("sequence(1, chunks)"))).withColumn("side", F.lit(0))
        members = rest.withColumn("i", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("j", F.col("c") + 1).withColumn(
            "side", F.lit(1))
        wanted = [*cell, "side", "label", "key"]
        links = stored(links.union(solved(outside.select(wanted).union(members.select(wanted)))).distinct(), "near-links")
    tree = components(links)
    rooted = classes.select("key", "first").join(tree, F.col("key") == F.col("node"), "left").select(
        "key", "first", F.coalesce("root", "key").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "lroot")
    of_class = stored(rooted.join(lowest, F.col("root") == F.col("lroot")).select(F.col("key").alias("ckey"), "component_id"),
                      "near-components")
    # rows without shingles need no class; a key of their own keeps them from meeting in one task
    out = known.select("id", "th", "n", F.coalesce(
        "key", F.concat_ws(":", F.lit("alone"), F.col("id").cast("string"), F.col("th").cast("string")).cast("binary")
    ).alias("key"))
    out = out.join(of_class, F.col("key") == F.col("ckey"), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"), *[F.col("th").alias("text_hash")] * with_hash)


def _pairs(links):
    return pa.RecordBatch.from_arrays(
        [pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], ["a", "b"])


def op7_near_dedup(spark, sf_dir):
    return near_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[p + 1 : p + 5], ' ')) AS g FROM (
    SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 4, 1) END)) AS p FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS shared FROM s p JOIN s q USING (g)
                        WHERE p.doc_id <> q.doc_id GROUP BY 1, 2) x
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 85 * (na.n + nb.n - shared)
), reach(doc_id, o) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.o
), c AS (SELECT doc_id, min(o) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.doc_id = d.doc_id
"""

QUERIES = {"op7_near_dedup": (op7_near_dedup, SQL)}
