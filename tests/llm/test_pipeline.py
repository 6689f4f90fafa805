"""The pipeline's stages, each on what its predecessor kept, against plain versions."""

from collections import Counter

import brute
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulseframe.llm import bpe, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality", "exact_dedup", "near_dedup", "mixing", "bpe"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    sources = {r.doc_id: r.source for r in docs.collect()}

    good = stage["quality"](spark, docs, SF).cache()
    model = quality.fit(docs, labels)  # the fit is tested by itself; here each text is scored plainly
    score = {i: quality.margins(np.array([quality.text_features(t or "")]), model)[0] for i, t in texts.items()}
    accepted = {i for i, s in score.items() if s >= 0}
    assert {r.doc_id for r in good.collect()} == accepted and len(accepted) > 100

    distinct = stage["exact_dedup"](spark, good, SF).cache()
    largest = {}
    for i in sorted(accepted):
        largest[texts[i] or ""] = i
    assert {r.doc_id for r in distinct.collect()} == set(largest.values())

    single = stage["near_dedup"](spark, distinct, SF).cache()
    stay = brute.near_stay([(i, texts[i]) for i in largest.values()])
    assert {r.doc_id for r in single.collect()} == stay and len(stay) < len(largest)

    mixed = stage["mixing"](spark, single, SF).cache()
    assert good.columns == distinct.columns == single.columns == mixed.columns == docs.columns
    rows = [(i, sources[i], texts[i]) for i in stay]
    copies = Counter({i: n for (i, _, _), n in zip(rows, brute.mix_copies(rows)) if n})
    assert Counter(r.doc_id for r in mixed.collect()) == copies

    library = Tokenizer.from_file(bpe.VOCABULARY)
    coded = stage["bpe"](spark, mixed, SF).collect()
    assert Counter(r.doc_id for r in coded) == copies
    assert all(r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids for r in coded)

    ran = corpus_pipeline.run(spark, SF)
    assert Counter((r.doc_id, r.ids_sha256) for r in ran.collect()) == Counter((r.doc_id, r.ids_sha256) for r in coded)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, name):
    """Nulls in any column, empty and long texts, ties, repeated rows, no rows, and further columns with names used inside."""
    stage = dict(corpus_pipeline.STAGES)[name]
    extra = "_copies string, _features string, _score string, _digest string, word string, id string, key string"
    rows = [(1, None, None, None, None), (1, "", "en", "a", 0), (2, "Some words that stand here.", "en", "a", 27), (2, "Some words that stand here.", "en", "a", 27), (None, "Some words that stand here.", None, None, None)]
    rows += [(3, "word " * 20000, "en", "b", 100000), (4, "word " * 20000, "en", "b", 100000), (5, " \n", "en", None, 2), (6, "y" * 50000, None, "b", 50000)]
    docs = spark.createDataFrame([(*r, *["x"] * 7) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    out = stage(spark, docs, SF)
    if name == "bpe":
        assert out.count() == len(rows) and {r.n_tokens for r in out.filter("doc_id = 1").collect()} == {0}
    else:
        assert out.columns == docs.columns
        got = out.collect()
        assert {r._score for r in got} <= {"x"} and {r._copies for r in got} <= {"x"}
        if name == "exact_dedup":  # null ids lose to others, of rows with id and text in common one stays
            assert sorted((r.doc_id, (r.text or "")[:5]) for r in got) == [(1, ""), (2, "Some "), (4, "word "), (5, " \n"), (6, "yyyyy")]
        if name == "near_dedup":
            assert {(r.doc_id, (r.text or "")[:5]) for r in got} == {(1, ""), (2, "Some "), (3, "word "), (6, "yyyyy")}
        if name == "mixing":
            assert all((r.text or "").split() for r in got) and got
    assert stage(spark, docs.limit(0), SF).count() == 0
    assert set(out.columns) == set(stage(spark, docs.filter(F.lit(False)), SF).columns)
