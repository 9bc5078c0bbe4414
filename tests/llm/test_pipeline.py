"""Every stage of the pipeline against brute force on its own input, and the odd cases through all of them."""

from __future__ import annotations

from collections import Counter

import public_tokenizers
import pytest
from brute import DOCS, odd_documents
from tokenizers import Tokenizer

import brute
import corpus_pipeline
from seaplate.llm import quality
from seaplate.sources.sinks import stage_table


def run_stages(spark, docs, sf_dir):
    out = [docs]
    for name, step in corpus_pipeline.STAGES:
        out.append(stage_table(step(spark, out[-1], sf_dir), name))
    return out


@pytest.fixture(scope="module")
def stages(spark, folder):
    return run_stages(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[1:-1])


def test_quality_stage(spark, folder, stages):
    model = quality.learn(stages[0], spark.read.parquet(f"{folder}/labels.parquet"))
    rows = pairs(stages[0])
    scores = model.score([t for _, t in rows])
    assert Counter(pairs(stages[1])) == Counter(r for r, s in zip(rows, scores, strict=True) if s >= quality.THRESHOLD)


def test_near_duplicate_stage(stages):
    rows = pairs(stages[1])
    kept = [r for r, (*_, keep) in zip(rows, brute.near_duplicates(rows), strict=True) if keep]
    assert Counter(pairs(stages[2])) == Counter(kept)


def test_decontamination_stage(spark, folder, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    rows = pairs(stages[2])
    clean = [r for r, (*_, bad) in zip(rows, brute.benchmark_hits(rows, items), strict=True) if not bad]
    assert Counter(pairs(stages[3])) == Counter(clean)


def test_mix_stage(stages):
    size = lambda t: len(brute.SPACE_WORD.findall(t or ""))
    before, sizes = {}, Counter()
    for r in stages[3].collect():
        before[r["doc_id"]] = r["text"]
        sizes[r["source"]] += size(r["text"])
    taken, cut = Counter(), 0
    for r in stages[4].collect():
        assert before[r["doc_id"]].startswith(r["text"])
        cut += before[r["doc_id"]] != r["text"]
        taken[r["source"]] += size(r["text"])
    wanted = brute.targets(sizes)
    assert cut <= len(sizes)
    for s, n in sizes.items():
        assert taken[s] == pytest.approx(wanted[s], rel=0.08)
        assert taken[s] <= 3 * n


def test_token_stage(stages):
    rows = sorted(pairs(stages[4]))
    found = sorted(map(tuple, stages[5].select("doc_id", "n_tokens", "ids_crc32").collect()))
    expected = brute.token_rows(rows, Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER)))
    assert found == sorted((d, n, c) for d, _, n, c in expected)
    spans = sorted(map(tuple, stages[5].select("start", "n_tokens").collect()))
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("rows", [[], odd_documents()])
def test_odd_documents(spark, folder, rows):
    out = run_stages(spark, spark.createDataFrame(rows, DOCS), folder)
    assert all(df.columns == out[0].columns for df in out[1:-1])
    assert out[-1].count() == out[-2].count()


def test_run(spark, folder, stages):
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == Counter(map(tuple, stages[-1].collect()))
