"""The pipeline against plain versions of its stages, and the stages' contract."""

import random
import zlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from flowloom.llm import pii
from flowloom.llm.queries import QUERIES


def test_pipeline(spark, make, tmp_path):
    rng = random.Random(12)

    def text(n):
        return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))

    shared, leak = text(9), text(12)
    rows = [f"{shared}\n{text(60)}" for _ in range(40)]  # a frequent line of one source
    rows += [text(50) + " call +1 (444) 555-4984 or mail a@b.example.com" for _ in range(5)]
    rows += [f"{text(20)} {leak} {text(20)}" for _ in range(5)]
    rows += [text(70)] * 4 + ["too short", "", None] + ["same five words come again " * 8]
    rows = [(k, t, "en", "a") for k, t in enumerate(rows)]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = {}
    for k, t, _, _ in rows:
        n, _, _, _, again = brute.quality(t)
        if n >= 10 and 100 * again <= 20 * n:
            kept[k] = "\n".join(x for x in t.split("\n") if x != shared)
    roots = brute.grouped({brute.fingerprint(t) for t in kept.values()})
    seen, single = set(), {}
    for k, t in sorted(kept.items()):
        root = roots[brute.fingerprint(t)]
        if root not in seen:
            seen.add(root)
            single[k] = t
    clean = {k: t for k, t in single.items() if not brute.leaks(t, [(1, leak)])[1]}
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = Counter()
    for k, t in clean.items():
        ids = [*whole.encode(pii.redact(t, pii.find(t)[1]), add_special_tokens=False).ids, 1]
        expected[k, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got) == expected
    assert len(clean) == 46

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, str(tmp_path))
            assert out.columns == docs.columns and out.count() <= given.count()


def test_one_query_for_each_operator():
    assert {n.split("_")[0] for n in QUERIES} == {*(f"op{k}" for k in range(1, 14)), "pipeline"}
