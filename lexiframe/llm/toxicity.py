"""Toxicity by compression distance.

Two Zstandard dictionaries are trained, one on toxic and one on ordinary texts. A dictionary's content are the
segments (whole words, or beginnings of words) that recur in more different surroundings of its class than the
other class explains; a surrounding counts once, so copies of a text add nothing. Every window of a text is
compressed with both, and the difference of the lengths is its evidence. Thresholds on the windows and their
share, highest values and number are calibrated to a probability on labelled rows that the dictionaries have
not seen. Each window is led by a preamble that both dictionaries hold: zstd then always compresses the block,
and a single match shows in its length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence
from itertools import groupby
from math import log

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, mapped, table, text_or_empty
from .decontaminate import SPLIT

PREAMBLE = bytes(range(1, 17))
WINDOW, HOP = 40, 24
SHORTEST, LONGEST = 6, 12  # bytes of a segment that begins a word, its space included
COUNTED = (2, 4, 6)  # a window counts from these differences on


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(SPLIT).split()


def support(docs: Iterable[list[bytes]], least: int = 2) -> tuple[Counter, int]:
    """In how many different (word before, word, word after) each segment occurs, from ``least`` on, and how many
    there are."""
    known: dict[bytes, int] = {}
    seen = []
    for w in docs:
        if not w:
            continue
        for x in w:
            if x not in known:
                known[x] = xxhash.xxh3_64_intdigest(x)
        h = np.zeros(len(w) + 2, dtype=np.uint64)
        h[1:-1] = [known[x] for x in w]
        seen.append(np.unique(np.stack([h[1:-1], (h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(0x9E3779B97F4A7C15) + h[2:]]), axis=1))
    if not seen:
        return Counter(), 0
    pairs = np.concatenate(seen, axis=1)
    del seen
    _, at = np.unique(pairs[1], return_index=True)
    words, counts = np.unique(pairs[0][at], return_counts=True)
    del pairs
    count_of = dict(zip(words.tolist(), counts.tolist()))
    ordered = sorted((b" " + x + b" ", count_of[h]) for x, h in known.items())
    del known, count_of
    out = Counter({w: n for w, n in ordered if n >= least})
    for size in range(SHORTEST, LONGEST):  # words that begin alike stand together
        for start, same in groupby(ordered, key=lambda wn: wn[0][:size]):
            n = sum(n for w, n in same if len(w) > size)
            if n >= least and len(start) == size:
                out[start] += n
    return out, len(at)


def segments(own: Counter, n_own: int, other: Counter, n_other: int, least: int = 4, times: float = 5.0) -> list[bytes]:
    """Segments over-represented in ``own`` beyond chance (likelihood ratio, held to the number of segments
    tried), strongest first; of segments within one another the strongest stays."""
    bar = 2 * log(max(len(own), 2)) + 5
    found = []
    for s, a in own.items():
        b = other[s]
        if a < least or a * n_other <= times * (b + 1) * n_own:
            continue
        rate, g = (a + b) / (n_own + n_other), 0.0
        for k, e in ((a, rate * n_own), (b, rate * n_other), (n_own - a, (1 - rate) * n_own), (n_other - b, (1 - rate) * n_other)):
            g += 2 * k * log(k / e) if k > 0 else 0
        if g >= bar:
            found.append((g, s))
    kept: list[bytes] = []
    for _, s in sorted(found, reverse=True):
        if not any(s in k or k in s for k in kept):
            kept.append(s)
    return kept


class Scorer:
    """Window differences and the calibrated score. ``model``: two dictionary contents, and the calibration."""

    def __init__(self, model: dict):
        self.model = model
        self.zips = []
        for content in (model["ordinary"], model["toxic"]):
            p = zstandard.ZstdCompressionParameters(
                window_log=max(12, (len(content) + 255).bit_length()), hash_log=12, chain_log=12, search_log=3,
                min_match=6, strategy=zstandard.STRATEGY_GREEDY, target_length=0, write_content_size=False)
            d = zstandard.ZstdCompressionDict(content + PREAMBLE, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            self.zips.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p))

    def differences(self, text: str | None, block: int = 8192) -> np.ndarray:
        """Ordinary minus toxic compressed length of each window of the whole text."""
        a = np.frombuffer(b" " + b" ".join(words_of(text)) + b" ", dtype=np.uint8)
        n = max(1, -(-(len(a) - WINDOW) // HOP) + 1)
        padded = np.full(HOP * (n - 1) + WINDOW, 32, dtype=np.uint8)
        padded[: len(a)] = a[: len(padded)]
        windows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::HOP]
        out = np.empty(n, dtype=np.int64)
        size = len(PREAMBLE) + WINDOW
        for lo in range(0, n, block):
            part = windows[lo : lo + block]
            led = np.empty((len(part), size), dtype=np.uint8)
            led[:, : len(PREAMBLE)] = np.frombuffer(PREAMBLE, dtype=np.uint8)
            led[:, len(PREAMBLE) :] = part
            at = np.stack([np.arange(len(part), dtype=np.uint64) * np.uint64(size),
                           np.full(len(part), size, dtype=np.uint64)], axis=1)
            ends = [z.multi_compress_to_buffer(zstandard.BufferWithSegments(led.tobytes(), at.tobytes())) for z in self.zips]
            out[lo : lo + block] = [len(o) - len(t) for o, t in zip(*ends)]
        return out

    def features(self, text: str | None) -> list[float]:
        d = self.differences(text)
        n, top = len(d), np.sort(d)[::-1]
        hits = [int((d >= c).sum()) for c in COUNTED]
        return [hits[0] / n, hits[1] / n, *(log(1 + h) for h in hits), float(top[0]), float(top[:4].sum()), log(n),
                log(hits[0] / n + 1 / (n + 20))]

    def scores(self, texts: list) -> np.ndarray:
        m = self.model
        x = (np.array([self.features(t) for t in texts], dtype=float).reshape(len(texts), -1) - m["mean"]) / m["scale"]
        return 1 / (1 + np.exp(-np.clip(x @ m["weights"][1:] + m["weights"][0], -40, 40)))


def dictionaries(rows: list[tuple[str | None, int]], most: int = 65536) -> dict:
    """Contents of the two dictionaries, at most ``most`` bytes each; the strongest segments lie nearest."""
    toxic, n_toxic = support(words_of(t) for t, y in rows if y)
    plain, n_plain = support(words_of(t) for t, y in rows if not y)
    return {"toxic": b"".join(segments(toxic, n_toxic, plain, n_plain)[::-1])[-most:],
            "ordinary": b"".join(segments(plain, n_plain, toxic, n_toxic)[::-1])[-most:]}


def fit(rows: list[tuple[str | None, int]], folds: int = 3, ridge: float = 0.05) -> dict:
    """Dictionaries from all rows; the calibration (ridge logistic regression) sees each row through dictionaries
    of the other folds. Without rows, or without toxic ones, every score is near 0."""
    x, y = [], []
    for k in range(folds):
        scorer = Scorer(dictionaries([r for i, r in enumerate(rows) if i % folds != k]))
        x += [scorer.features(t) for t, _ in rows[k::folds]]
        y += [float(v) for _, v in rows[k::folds]]
    width = len(scorer.features(""))
    x, y = np.array(x, dtype=float).reshape(-1, width), np.array(y)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(width), np.ones(width))
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w, penalty = np.zeros(width + 1), np.full(width + 1, ridge)
    w[0] = -4.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        pull = penalty * (w - np.r_[-4.0, np.zeros(width)])
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - pull)
        w = w + step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return dictionaries(rows) | {"mean": mean, "scale": scale, "weights": w}


def held_out(id_col: str):
    """Rows whose labels are not learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_rows: int = 6000, max_chars: int = 20_000) -> dict:
    """Fit on at most ``max_rows`` labelled rows that are not held out (of the smallest id hashes), the
    first ``max_chars`` characters of each; the bound is on learning alone, every text is scored whole. Of
    several labels of an id the highest counts; null ids and labels are no labels. Rows that repeat an id are
    learnt from once for each text."""
    y = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("lid")).agg(
        (F.max(label_col) > 0).cast("int").alias("y"))
    rows = (docs.where(~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .join(y, F.col("id") == F.col("lid")).select("id", "text", "y", F.xxhash64("id").alias("h")))
    sample = hash_sample(rows, "h", max_rows).select("id", F.substring("text", 1, max_chars).alias("text"), "y", "h")
    return fit([(r["text"], r["y"]) for r in sorted(sample.collect(), key=lambda r: (r["h"], r["id"], r["text"] or ""))])


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3,
          carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from ``threshold``), and
    the ``carry`` columns.

    Null text is the empty text, which has one blank window and so a score. Texts are scored whole, whatever
    their length. Null ids are not held out; rows that repeat an id are scored each. No rows give no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most 64 KB, and ten weights

    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            scores = pa.array(scorer.scores(b.column(2).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([scores, *(b.column(i) for i in (0, 1, *range(3, b.num_columns)))], names)

    rows = docs.select(F.col(id_col).alias("__id"), held_out(id_col).alias("__held"),
                       text_or_empty(F.col(text_col)).alias("__text"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)])
    names = ["__score", "__id", "__held", *(f"__c{i}" for i in range(len(carry)))]
    kinds = dict(rows.dtypes) | {"__score": "double"}
    return mapped(rows, run, ", ".join(f"{n} {kinds[n]}" for n in names)).select(
        F.col("__id").alias(id_col), *[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)],
        F.col("__held").alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= threshold).cast("int").alias("predicted"))


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op1_toxicity": (op1_toxicity, None)}
