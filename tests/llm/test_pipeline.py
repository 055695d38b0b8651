"""Each stage of the pipeline against a plain computation on its own input."""

import os
from collections import Counter

import pytest

import corpus_pipeline as cp
from geolake.llm import bpe, mix, quality
from geolake.llm.common import table
from geolake.llm.queries import QUERIES, SQL, tokenizer_path
from tests.llm.test_operators import brute_classes, brute_lines

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver tables")


def test_names():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} and set(SQL) <= set(QUERIES)
    assert [f for _, f in cp.STAGES] == [cp.quality_stage, cp.line_stage, cp.near_stage, cp.mix_stage, cp.encode_stage]


def test_stages(spark, tmp_path):
    docs = table(spark, DIR, "documents")
    model = quality.fit(docs, table(spark, DIR, "labels"))
    at = docs
    for k, (_, stage) in enumerate(cp.STAGES):
        before = at
        stage(spark, before, DIR).write.parquet(str(tmp_path / str(k)))
        at = spark.read.parquet(str(tmp_path / str(k)))
        old = before.select("doc_id", "text").collect()
        new = at.collect()
        if k < 4:
            assert at.columns == docs.columns
        if k == 0:
            good = {r.doc_id for r in quality.score(before, model).where("predicted = 1").collect()}
            assert {r.doc_id for r in new} == good and 0 < len(good) < docs.count()
        elif k == 1:
            assert {r.doc_id: r.text for r in new} == brute_lines([(r.doc_id, r.text) for r in old])
            assert all(r.n_chars == len(r.text) for r in new)
        elif k == 2:
            rows = [(r.doc_id, r.text) for r in old]
            assert sorted(r.doc_id for r in new) == sorted(set(brute_classes(rows)))
        elif k == 3:
            assert Counter(r.doc_id for r in new) == Counter({r.doc_id: r.copies for r in mix.mix(before).collect() if r.copies})
        else:
            enc = bpe.Encoder(bpe.Vocabulary.read(tokenizer_path()))
            want = Counter((r.doc_id, *enc.encode([r.text])[0]) for r in old)
            assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in new) == want
