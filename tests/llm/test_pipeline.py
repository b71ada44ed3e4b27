"""The pipeline, stage by stage, against brute force over small tables."""

import os
import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lorekeeper.llm import mixing, sentencepiece_codec, toxicity

from .test_dedup import brute_similar

pytestmark = pytest.mark.skipif(not os.path.exists(sentencepiece_codec.MODEL), reason="no tokenizer files")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("aeioulmnrst", k=rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(240):
        words = rng.choices(vocabulary, k=80)
        if i % 6 == 0:
            words[4] = words[50] = words[30] = "dreckling"
        text = " ".join(words)
        if i % 10 == 3 and i > 20:
            text = rows[i - 20][1] + " \n"
        if i % 10 == 7 and i > 20:
            text = rows[i - 20][1] + " and five more words here"
        rows.append((i, text, "en", f"src{i % 4}", len(text)))
        labels.append((i, 1, int("dreckling" in text)))
    rows += [(900, None, "en", None, None), (901, "", None, "src0", 0)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_have_their_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding and decoding"]


def test_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        seen[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            docs = spark.createDataFrame(seen[name], docs.schema)
    start = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(start, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert {r.doc_id for r in seen["toxicity"]} == {i for i, p in scores.items() if not p}
    bad = lambda rows: sum("dreckling" in (r.text or "") for r in rows)
    assert bad(seen["toxicity"]) <= 0.1 * bad(start.collect())

    best = {}
    for r in seen["toxicity"]:
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        best.setdefault(key, []).append((-len(r.text or ""), r.doc_id))
    assert {r.doc_id for r in seen["exact dedup"]} == {min(v)[1] for v in best.values()}

    groups = brute_similar([(r.doc_id, r.text) for r in seen["exact dedup"]], 5, Fraction(4, 5))
    assert {r.doc_id for r in seen["n-gram Jaccard join"]} == {i for i, _, least in groups if i == least}

    plan = mixing.curriculum(spark.createDataFrame(seen["n-gram Jaccard join"], start.schema)).collect()
    order = sorted((p, r.doc_id) for r in plan for p in r.positions)
    assert [r.doc_id for r in seen["mixing sources to target weights"]] == [i for _, i in order]

    last = seen["SentencePiece encoding and decoding"]
    assert Counter((r.doc_id, r.decoded) for r in last) == Counter((r.doc_id, r.text or "") for r in seen["mixing sources to target weights"])
    ran = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r.doc_id, r.ids) for r in ran.collect()) == sorted((r.doc_id, r.ids) for r in last)


def test_stages_take_odd_rows(spark, odd, none, sf_dir):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == odd.columns, name
            assert out.count() <= 3 * docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_order_and_copies_of_the_mix_survive_many_files(spark, tmp_path):
    """Positions are those of the sorted write, whatever the sizes of its files; copies are cut differently."""
    rows = [(i, f"the words of document number {i} " * (5 + i % 9), "en", f"src{i % 3}", 1) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = mixing.mix_sources(docs)
    order = [r.doc_id for r in mixed.collect()]
    mixed.write.option("maxRecordsPerFile", 7).parquet(str(tmp_path / "mix"))
    out = corpus_pipeline.encode(spark, spark.read.parquet(str(tmp_path / "mix")), "").collect()
    assert [r.doc_id for r in sorted(out, key=lambda r: r.position)] == order and [r.position for r in sorted(out, key=lambda r: r.position)] == list(range(len(order)))
    cuts = {}
    for r in out:
        cuts.setdefault(r.doc_id, {})[r.copy] = tuple(r.ids)
    twice = {i: c for i, c in cuts.items() if len(c) > 1}
    assert twice and all(sorted(c) == list(range(len(c))) for c in cuts.values())
    assert sum(len(set(c.values())) == len(c) for c in twice.values()) > 0.9 * len(twice)
    assert all(r.decoded == rows[r.doc_id][1] for r in out)


def test_stages_leave_columns_with_any_names_alone(spark, odd):
    """Names that stages use for themselves come back as they were."""
    from lorekeeper.llm import exact_dedup, ngram_join

    names = ["__id", "__sha256", "__sha", "__at", "__k", "__lists", "__size", "__source", "__ID2", "own_column_0"]
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(n), F.lit(":"), F.coalesce("doc_id", F.lit(0))).alias(n) for n in names])
    marks = spark.createDataFrame([(4, 1), *[(i, 0) for i in (5, 6, 7, 9, 10, 11, 12, 13, 14, 15)]], "doc_id long, toxic int")
    for stage in (exact_dedup.drop_exact_copies, ngram_join.drop_similar, mixing.mix_sources, lambda d: toxicity.drop_toxic(d, marks)):
        out = stage(docs)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n}:{r.doc_id or 0}" for r in rows for n in names)
