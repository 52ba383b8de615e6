"""Archives and shards."""

import base64
import hashlib
import struct
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import zstandard

from lexiframe.llm.common import shared_folder
from lexiframe.llm.sharding import pack, place, place_groups
from lexiframe.llm.warc import DICT_FRAME, parse, read_archives, write_archives

from .util import edge_docs, edge_rows, got, no_docs, prose, want

SCHEMA = "page_id long, url string, html string, refers_to int"


def pages():
    rows = [(i, f"http://x/{i}", "<p>" + prose(30, i % 40), 0) for i in range(120)]
    return rows + [(200, None, None, 0), (201, "a\r\nb", "", 0), (202, "u", "\r\n\r\n", 0), (203, "u", "é" * 70_000, 0), (1, "http://x/1", "<p>" + prose(30, 1), 0),
                   (None, "u", "no id", 0)]


def archived(rows, least=0):
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        f = first.get(h or "")
        revisit = len(raw) >= least and f is not None and f != i
        yield i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", f if revisit else None


def test_round_trip(spark):
    for least in (0, 10):
        folder = shared_folder(spark, "warc-test")
        archives = write_archives(spark.createDataFrame(pages(), SCHEMA).repartition(3), folder, archive_bytes=2000, min_payload=least)
        out = read_archives(archives, folder)
        assert got(out, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want(archived(pages(), least))
    assert archives.count() > 5 and out.rdd.getNumPartitions() == archives.count()
    path = Path(archives.first()["path"])
    raw = path.read_bytes()
    magic, n = struct.unpack("<II", raw[:8])
    assert magic == DICT_FRAME and n > 0
    # any reader of Zstandard can go on record by record with the dictionary from the first frame
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + n])).decompressobj()
    fields, payload = parse(d.decompress(raw[8 + n :]))
    assert fields["warc-type"] in ("response", "revisit") and (payload or fields["warc-type"] == "revisit" or fields["x-payload-length"] == "0")
    assert archives.agg({"records": "sum"}).first()[0] == len(pages())


def test_no_pages(spark):
    folder = shared_folder(spark, "warc-none")
    assert read_archives(write_archives(spark.createDataFrame([], SCHEMA), folder), folder).count() == 0


def test_damage_is_noticed(spark):
    import pytest

    folder = shared_folder(spark, "warc-damaged")
    archives = write_archives(spark.createDataFrame(pages()[:5], SCHEMA).coalesce(1), folder)
    path = Path(archives.first()["path"])
    path.write_bytes(path.read_bytes()[:-3])
    with pytest.raises(Exception, match="record|frame|checksum|Zstd|zstd|ends"):
        read_archives(archives, folder).count()


def test_place_is_greedy_by_dot_product():
    v = np.random.default_rng(1).random((200, 3))
    shard = place(v, 4)
    loads = np.array([v[shard == s].sum(axis=0) for s in range(4)])
    assert (loads.max(axis=0) / loads.mean(axis=0)).max() < 1.05
    assert place(np.zeros((0, 3)), 4).tolist() == []
    # the first and largest item goes to the lowest shard, and the next to another
    assert place(np.array([[3.0, 3, 3], [2, 2, 2]]), 2).tolist() == [0, 1]


def shard_rows():
    rows = [(i, prose(3 + i % 60, i)) for i in range(900)]
    return rows + [(1000 + i, "the hot text of a third of all rows") for i in range(450)] + [(2000 + i, rows[i][1]) for i in range(40)]


def test_pack(spark):
    rows = shard_rows()
    out = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), n_shards=8).collect()
    text = dict(rows)
    assert sorted(r["doc_id"] for r in out) == sorted(text)
    load, count, slots, where = Counter(), Counter(), {}, {}
    for r in out:
        t = text[r["doc_id"]]
        assert r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode())
        load[r["shard"]] += r["size"]
        count[r["shard"]] += 1
        slots.setdefault(r["shard"], []).append(r["slot"])
        where.setdefault(t, set()).add(r["shard"])
    assert set(load) == set(range(8))
    assert max(load.values()) < 1.03 * min(load.values()) and max(count.values()) < 1.05 * min(count.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # groups stay together, but for the one that no shard could hold
    assert all(len(s) == 1 for t, s in where.items() if not t.startswith("the hot")) and len(where["the hot text of a third of all rows"]) > 1


def test_only_groups_that_must_be_are_cut():
    cells = np.tile([10.0, 2.0, 1.0], (4000, 1))

    def shards_of(vector, fine):
        vectors = np.vstack([cells, np.tile(np.array(vector) / fine, (fine, 1))])
        shard = place_groups(vectors, np.append(np.arange(4000), np.full(fine, 4000)), 4, 0.005, 1 / 32)
        load = np.stack([np.bincount(shard, weights=x, minlength=4) for x in vectors.T])
        assert (load.max(axis=1) < 1.02 * load.min(axis=1)).all()
        return len(set(shard[4000:]))

    assert shards_of([5000.0, 1000.0, 500.0], 64) == 1  # half of a shard
    assert shards_of([25000.0, 5000.0, 2500.0], 300) > 1  # more than a shard
    assert shards_of([100.0, 20.0, 900.0], 100) > 1  # fits a shard, but leaves its rows unequal


def test_pack_rows_without_ids(spark):
    rows = [(None, "")] * 300 + [(7, "same")] * 60 + [(i, prose(5, i)) for i in range(200)]
    out = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), n_shards=4).collect()
    count = Counter(r["shard"] for r in out)
    assert len(out) == len(rows) and max(count.values()) < 1.2 * min(count.values())
    for s in count:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(count[s]))


def test_pack_awkward_rows(spark):
    out = pack(edge_docs(spark), n_shards=4)
    assert got(out, "doc_id", "size", "text_crc32") == want(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in edge_rows())
    assert pack(no_docs(spark)).count() == 0
