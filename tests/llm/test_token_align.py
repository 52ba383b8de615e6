"""Alignment of two tokenizers against a slow version."""

import hashlib
from bisect import bisect_left
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiframe.llm.bpe import vocabulary_path
from lexiframe.llm.common import stored
from lexiframe.llm.token_align import align, common_ends, gallop, link_statistics, op13_token_align, pair_bound, tokenizers

from .util import edge_docs, edge_rows, got, no_docs, want

SF = "/root/testdata/sf0.01"
PATHS = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")


def slow(rows):
    """(id, text) -> the query's rows, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    ta = Tokenizer.from_file(PATHS[0])
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in own)}
    rest = []
    for i, t in rows:
        t = t or ""
        a = ta.encode(" " + t, add_special_tokens=False)
        ids, b = a.ids, tb.encode(t)
        pieces = [tb.id_to_piece(x) for x in b]
        bytes_a = [bytes(byte[c] for c in x) for x in a.tokens]
        bytes_b = [bytes([int(p[3:5], 16)]) if tb.is_byte(x) else p.replace("▁", " ").encode() for x, p in zip(b, pieces)]
        raw = (" " + t).encode()
        if not t or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            rest.append((i, 0, 0, [], ""))
            continue
        ends = [dict(zip(np.cumsum([len(x) for x in s]).tolist(), range(len(s)))) for s in (bytes_a, bytes_b)]
        groups, links, ia, ib = [], [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            ja, jb = ends[0][e] + 1, ends[1][e] + 1
            groups.append(",".join(map(str, ids[ia:ja])) + "|" + ",".join(map(str, b[ib:jb])))
            links.append((ids[ja - 1], b[jb - 1]))
            ia, ib = ja, jb
        rest.append((i, len(ids), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    n = Counter(x for r in rest for x in r[3])
    top = Counter()
    for (_, b), c in n.items():
        top[b] = max(top[b], c)
    return [(i, na, nb, len(ln), len(ln), sum(n[x] == top[x[1]] for x in ln), sum(n[x] for x in ln), h) for i, na, nb, ln, h in rest]


COLS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_token_align_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    out = op13_token_align(spark, SF)
    assert out.columns == COLS and [t for _, t in out.dtypes] == ["bigint"] * 7 + ["string"]
    assert got(out, *COLS) == want(slow(rows))


def test_token_align_edges(spark):
    odd = [" " * 300_000, "\n" * 300_000 + "x", "<|endoftext|> and </s><s>", "a▁b", "a\x00b", "　x y", " ", "\n\n", "  lead", "trail  ", "­​" * 40, "x" * 20_000, "😀" * 300, "é é ﬁ"]
    docs = edge_docs(spark).unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"), allowMissingColumns=True)
    rows = [(r[0], r[1]) for r in edge_rows()] + [(100 + i, t) for i, t in enumerate(odd)]
    out = link_statistics(stored(align(docs, *PATHS), "aligned"), *PATHS)
    assert got(out, *COLS) == want(slow(rows))
    assert link_statistics(align(no_docs(spark), *PATHS), *PATHS).count() == 0
    # groups by rank: the last of each side is its last token, and as many on both sides
    for r in align(docs, *PATHS).where("n_a > 0").collect():
        assert r["last_a"][-1] == r["n_a"] - 1 and r["last_b"][-1] == r["n_b"] - 1 and len(r["last_a"]) == len(r["last_b"]) == r["n_groups"]


def test_pairs_are_bounded(spark):
    pair = tokenizers(*PATHS)
    bound = pair_bound(pair.bytes_a, pair.bytes_b)
    assert bound < 400_000
    nb = len(pair.bytes_b)
    linked = {p for r in align(spark.read.parquet(f"{SF}/documents.parquet"), *PATHS).select("links").collect() for p in np.frombuffer(r["links"], "<i4").tolist()}
    for p in linked:
        a, b = pair.bytes_a[p // nb], pair.bytes_b[p % nb]
        assert a.endswith(b) or b.endswith(a)
    assert len(linked) <= bound


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 400)), st.sets(st.integers(1, 400)))
def test_gallop(x, y):
    a, b = (np.array(sorted(s | {401})) for s in (x, y))
    assert gallop(a, b).tolist() == [bisect_left(b, k) for k in a]
    ia, ib = common_ends(a, b)
    assert a[ia].tolist() == b[ib].tolist() == sorted((x & y) | {401})


def test_library_and_encoder_agree_on_characters():
    """Every assigned and unassigned character of the first plane, at word, number and blank borders."""
    from tokenizers import Tokenizer

    ta = Tokenizer.from_file(PATHS[0])
    ta.encode_special_tokens = True
    texts = [f" a{chr(c)}b 1{chr(c)}2  {chr(c)}{chr(c)} !{chr(c)}" for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    a = tokenizers(*PATHS).a
    assert all(x.ids == a.encode_ordinary(t) for t, x in zip(texts, ta.encode_batch_fast(texts, add_special_tokens=False)))
