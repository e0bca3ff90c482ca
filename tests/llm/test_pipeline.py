"""The corpus pipeline's stages, one after the other, against plain versions over a small corpus."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline
from streamctx.llm import dedup, mixing, staging
from tests.llm.test_operators import edited, plain_components, plain_dedup, words


@pytest.fixture(scope="module")
def sf_dir(spark, documents, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows, labels = [], []
    for i in range(300):
        toxic = i % 6 == 0
        r = random.Random(i)
        t = words(60, i, 3000).split() + [r.choice(["slurone", "slurtwo", "slurthree"]) for _ in range(3)] * toxic
        rows.append((i, " ".join(t), "en", f"s{i % 4}"))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[i][1].replace(" ", "  "), "en", "s1") for i in range(1, 60, 3)]
    rows += [(2000 + i, edited(rows[i][1], 1, i), "en", "s2") for i in range(1, 40, 3)]
    rows += [(3000, None, "en", None), (3001, "", "en", "s0")]
    clashing = {c: F.lit(f"own {c}") for c in "_metadata locator _locator mix_locator mix_locator_copy _times _copy repeats kept at _key".split()}
    documents(rows).withColumns(clashing).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, sf_dir):
    docs, stages = spark.read.parquet(f"{sf_dir}/documents.parquet"), dict(corpus_pipeline.STAGES)
    columns, before = docs.columns, docs.collect()
    kept = {}
    for name, stage in stages.items():
        docs = staging.stage(stage(spark, docs, sf_dir), "test")
        kept[name] = docs.collect()
        if name != "best-fit packing":
            assert docs.columns == columns and all(r["_locator"] == "own _locator" and r["_metadata"] == "own _metadata" and r["_copy"] == "own _copy" for r in kept[name])
    ids = {name: {r.doc_id for r in rows} for name, rows in kept.items()}
    clean = {r.doc_id for r in before if "slur" not in (r.text or "")}
    assert len(clean - ids["toxicity"]) <= 3 and len(ids["toxicity"] - clean) <= 3
    of = [(r.doc_id, r.text) for r in kept["toxicity"]]
    assert ids["exact dedup"] == {k for _, k, _, _ in plain_dedup(of)} and len(kept["exact dedup"]) == len(ids["exact dedup"])
    of = [(r.doc_id, r.text) for r in kept["exact dedup"]]
    assert ids["n-gram Jaccard join"] == {i for i, _, c in plain_components(of) if i == c}
    mixed = Counter(r.doc_id for r in kept["mixing sources to target weights"])
    assert set(mixed) <= ids["n-gram Jaccard join"] and max(mixed.values()) <= 3
    assert Counter(r.doc_id for r in kept["best-fit packing"] if r.piece == 0) == mixed


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    filled = Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    assert rows and max(filled.values()) <= 2048


def test_null_and_shared_ids(spark, documents):
    base, other = words(80, 1, 10**6), words(80, 2, 10**6)
    rows = [(3, base, "en", "s0"), (5, base + " y", "en", "s0"), (5, other, "en", "s1"), (None, words(70, 3), "en", "s0"), (None, words(70, 4), "en", "s1"), (8, words(5, 5), "en", "s0"), (8, words(6, 6), "en", "s0")]
    docs = staging.stage(documents(rows), "test")
    left = staging.stage(corpus_pipeline.drop_near_copies(spark, docs, ""), "test")
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter((i, t) for i, t, *_ in rows if t != base + " y")
    plan = mixing.mix(left, locator=dedup.place_in_file(left)).collect()
    mixed = corpus_pipeline.mix_sources(spark, left, "").collect()
    assert Counter((r.doc_id, len(r.text.split())) for r in mixed) == sum((Counter({(r.doc_id, r["size"]): r.repeats}) for r in plan), Counter())
    assert any(r.doc_id is None for r in mixed)


def test_empty_corpus(spark, sf_dir, tmp_path):
    for table in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").where("false").write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
