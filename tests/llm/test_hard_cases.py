"""Tables that are usual in practice and hard on joins: null ids everywhere, nothing to find, columns named like those inside."""

import random
from collections import Counter
from fractions import Fraction

import pytest

from lifethread.llm import decontaminate, jaccard, line_dedup, mixing, queries, token_counts, toxicity
from tests.llm import brute
from tests.llm.test_llm import SF_DIR, got

#: Names that operators use inside.
NAMES = ["of", "of_key", "of_text", "of_id", "of_source", "of_size", "held", "many", "at", "key", "body", "lines", "kept", "drop", "doc", "had_text", "__id", "__lines", "__kept",
         "mix_id", "mix_copy", "mix_words", "mix_size", "mix_shard", "mix_order", "node", "root", "text_hash", "keep_text", "keep_doc_id"]


def near_copies(n, seed=5):
    r = random.Random(seed)
    out = []
    for k in range(n // 2):
        w = [f"w{r.randrange(5000)}" for _ in range(60)]
        out += [" ".join(w), " ".join(w[:-1] + [f"x{k}"])]
    return out


def test_near_copies_without_ids(spark):
    texts = near_copies(1000) + ["the same text in many rows without any id at all"] * 300
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(6)
    out = jaccard.jaccard_join(docs, 3, Fraction(9, 10)).collect()
    assert len(out) == len(texts) and sum(r.links for r in out) == 1000 and all(r.component_id is None for r in out)
    kept = Counter(r.text for r in jaccard.one_of_each(docs, 3, Fraction(9, 10)).collect())
    assert len(kept) == 501 and set(kept.values()) == {1}


def test_equal_ids_on_unlike_texts(spark):
    """A third of all rows has one id; sets are found again by id and text."""
    texts = near_copies(400)
    rows = [(7 if k % 3 == 0 else k + 1000, t) for k, t in enumerate(texts)] + [(7, texts[0])] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(jaccard.jaccard_join(docs, 3, Fraction(9, 10)), "doc_id", "n_shingles", "component_id", "links") == Counter(brute.jaccard(rows, 3, 9, 10))


def test_passages_of_clean_texts(spark):
    docs, labels = (queries.table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    clean = spark.createDataFrame([(k, f"plain words number {k}") for k in range(50)], "doc_id long, text string")
    assert toxicity.toxic_passages(clean, model).count() == 0


@pytest.fixture(scope="module")
def crowded(spark):
    rows = [(k, t, "s", *([k] * len(NAMES))) for k, t in enumerate(near_copies(20) + ["A line that many documents have, word for word\nmore"] * 6 + ["", None])]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in NAMES))


def test_columns_named_like_those_inside(spark, crowded):
    bench = queries.table(spark, SF_DIR, "benchmark")
    labels = queries.table(spark, SF_DIR, "labels")
    for out, n in ((decontaminate.drop_contaminated(crowded, bench), 28), (jaccard.one_of_each(crowded), 13), (line_dedup.line_dedup(crowded), 28), (toxicity.drop_toxic(crowded, labels.limit(0)), None)):
        assert out.columns == crowded.columns
        rows = out.collect()
        assert n is None or len(rows) == n
        assert all(r[c] == r["doc_id"] for r in rows for c in NAMES)
    mixed = mixing.mix_documents(crowded, shards=4)
    assert set(mixed.columns) == set(crowded.columns) and all(r["held"] == r["doc_id"] == r["at"] for r in mixed.collect())
    assert mixing.mix_documents(mixed, shards=4).count() > 0


def test_line_dedup_of_a_crowded_table(spark, crowded):
    left = Counter(r.text for r in line_dedup.line_dedup(crowded).collect())
    assert left["more"] == 5 and left["A line that many documents have, word for word\nmore"] == 1 and left[None] == 1


def test_token_counts_keep_every_id(spark):
    ids = [-1, -5, 7, None, None, (1 << 63) - 1, -(1 << 63), 0]
    docs = spark.createDataFrame([(d, "some words here") for d in ids], "doc_id long, text string")
    assert Counter(r.doc_id for r in token_counts.document_counts(docs).collect()) == Counter(ids)
