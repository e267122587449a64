"""Every stage on its own input, against the operators' brute-force versions."""

import hashlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from laurel.llm import registry, secret_scan
from test_near_dup import brute
from test_texts import hits


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "secrets", "encoding"]
    inputs, outputs = [], []
    for _, stage in corpus_pipeline.STAGES:
        inputs.append(docs)
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs, sf).schema).cache()
        outputs.append(docs)
    for out in outputs[:-1]:
        assert sorted(out.columns) == sorted(inputs[0].columns)
    scores = {r.doc_id: r.score for r in registry.quality_scores(inputs[0], spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert {r.doc_id for r in outputs[0].collect()} == {k for k, s in scores.items() if s >= registry.QUALITY_CUT}
    groups = brute([(r.doc_id, r.text) for r in inputs[1].collect()], 5, 80)
    assert {r.doc_id for r in outputs[1].collect()} == {k for k, (_, c) in groups.items() if k == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in inputs[2].collect() if (h := hits(r.text, items))[1] == 0 or 20 * h[1] < h[0]}
    assert {r.doc_id for r in outputs[2].collect()} == clean
    found = secret_scan.scan(inputs[3]).where("is_secret").collect()
    before, after = {r.doc_id: r.text for r in inputs[3].collect()}, {r.doc_id: (r.text, r.n_chars) for r in outputs[3].collect()}
    for k, text in before.items():
        for r in sorted((r for r in found if r.doc_id == k), key=lambda r: -r.start):
            text = text[: r.start] + "[secret]" + text[r.start + r.length :]
        assert after[k] == (text, len(text))
    library = Tokenizer.from_file(registry.TOKENIZER)
    for r in outputs[4].collect():
        ids = library.encode(after[r.doc_id][0], add_special_tokens=False).ids
        assert bytes(r.ids) == np.array(ids, "<u4").tobytes() and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest()
    assert outputs[4].count() == outputs[3].count()


def test_stages_on_odd_documents(spark, sf, odd, nothing):
    base = odd.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"), "score", "id")
    for docs in (base, base.where("doc_id < 0")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            rows = out.collect()
            if name == "secrets":
                assert len(rows) == docs.count()
            if name != "encoding":
                assert set(out.columns) >= {"doc_id", "text", "lang", "source", "n_chars"}


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
