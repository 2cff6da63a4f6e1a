import zlib
from collections import Counter

import corpus_pipeline
from test_decontaminate import brute as contained
from test_mixing import shares
from test_pipeline_near import links_by_tokens
from test_tokens import brute as encoded

from bibliospark.llm.common import WORD


def test_stages_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = lambda df: [(r.doc_id, r.text, r.source) for r in df.collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "mixing", "tokens"]

    first = stages["quality"](spark, docs, folder).cache()
    assert first.columns == docs.columns
    kept = {r.doc_id for r in first.collect()}
    judged = [(q, i in kept) for i, q in labels.items() if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(bool(q) == k for q, k in judged) >= 0.95 * len(judged)

    second = stages["near_duplicates"](spark, first, folder).cache()
    assert second.columns == docs.columns and Counter(i for i, *_ in rows(second)) == Counter(links_by_tokens([(i, t) for i, t, _ in rows(first)]))

    third = stages["decontamination"](spark, second, folder).cache()
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {d for d, *_ in contained(rows(second), items)}
    assert dirty and third.columns == docs.columns and {i for i, *_ in rows(third)} == {i for i, *_ in rows(second)} - dirty

    fourth = stages["mixing"](spark, third, folder).cache()
    copies, sizes, taken = Counter(i for i, *_ in rows(fourth)), Counter(), Counter()
    for i, text, source in rows(third):
        sizes[source] += len(WORD.findall(text or ""))
        taken[source] += copies[i] * len(WORD.findall(text or ""))
    want = shares(sizes)
    assert fourth.columns == docs.columns and max(copies.values()) <= 3 and set(copies) <= {i for i, *_ in rows(third)}
    assert all(abs(taken[s] - want[s]) <= 0.1 * want[s] for s in want)

    last = [tuple(r) for r in stages["tokens"](spark, fourth, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert Counter(last) == Counter(encoded(rows(fourth)))


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 100
