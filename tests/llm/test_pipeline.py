"""The stages of the pipeline, one on the other, against brute force."""

import hashlib

import numpy as np

import corpus_pipeline
from lexiframe.llm.bpe import vocabulary_path
from lexiframe.llm.queries import QUERIES

from .util import brute_contaminated, brute_exact, brute_near, edge_rows, SCHEMA, got, prose, want


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    item = prose(20, 999)
    rows = edge_rows() + [(100 + i, prose(70, 300 + i % 25) + (" horrid nasty" * 2 if i % 4 == 0 else "") + (" " + item if i % 7 == 0 else ""), "en", "s", 1, "x", 1)
                          for i in range(200)]
    labels = [(100 + i, int(i % 4 == 0)) for i in range(200)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontaminate", "encode"]

    stages = [f for _, f in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns

    def texts(df):
        return [(r["doc_id"], r["text"]) for r in df.collect()]

    clean = stages[0](spark, docs, str(tmp_path))
    assert clean.columns == columns
    left = texts(clean)
    kept_toxic = sum("horrid" in (t or "") for _, t in left)
    assert kept_toxic <= 2 and len(left) >= len(rows) - 50 - 4

    unique = stages[1](spark, clean, str(tmp_path))
    assert unique.columns == columns
    assert want(texts(unique)) == want(r for r, b in zip(left, brute_exact(left)) if b[3])
    left = texts(unique)
    apart = stages[2](spark, unique, str(tmp_path))
    assert want(texts(apart)) == want(r for r, b in zip(left, brute_near(left)) if b[3])
    left = texts(apart)
    pure = stages[3](spark, apart, str(tmp_path))
    assert pure.columns == columns
    assert want(texts(pure)) == want(r for r, b in zip(left, brute_contaminated(left, [(1, item)])) if not b[5])
    left = texts(pure)

    library = Tokenizer.from_file(vocabulary_path())
    library.no_truncation()
    library.no_padding()
    expected = []
    for i, t in left:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    cols = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got(corpus_pipeline.run(spark, str(tmp_path)), *cols) == want(expected)


def test_near_stage_links_from_four_fifths(spark):
    def edited(*places):
        words = prose(100, 7).split()
        for p in places:
            words[p] = f"edit{p}"
        return " ".join(words)

    rows = [(1, edited()), (2, edited(20, 60)), (3, edited(30, 50, 80))]  # 1 and 2 share 86 of 106, 1 and 3 share 81 of 111
    assert [b[3] for b in brute_near(rows)] == [True, True, True]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = got(corpus_pipeline.drop_near_copies(spark, docs, ""), "doc_id")
    assert left == want((r[0],) for r, b in zip(rows, brute_near(rows, 80)) if b[3]) == [(1,), (3,)]


def test_queries_are_named():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
