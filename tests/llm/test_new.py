"""Language identification, importance resampling and periodic runs against plain Python versions."""

import random
from collections import Counter

import pytest

from lifethread.llm import language_id, periodic, queries, resample
from tests.llm import brute
from tests.llm.test_llm import SF_DIR, documents, empty, got, odd, plain, rows  # noqa: F401

RUNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_word_runs():
    r = random.Random(7)
    for _ in range(400):
        w = [r.randrange(r.choice([1, 2, 3, 5])) for _ in range(r.randrange(0, 40))]
        if r.random() < 0.5 and w:
            p = r.randrange(1, len(w) + 1)
            w = [w[k % p] if r.random() > 0.03 else 9 for k in range(len(w))]
        assert periodic.word_runs(w, 4) == brute.word_runs(w, 4)
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 200:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    assert periodic.word_runs(fibonacci[-1], 2) == brute.word_runs(fibonacci[-1], 2)


def test_periodic(spark, odd, plain, documents, rows):  # noqa: F811
    r = random.Random(3)
    loops = [(None if k % 9 == 0 else k, " ".join(f"w{r.randrange(2)}" if r.random() < 0.1 else f"w{(j % p)}" for j in range(r.randrange(0, 90)))) for k in range(150) for p in [r.randrange(1, 30)]]
    few = [(d, t) for d, t in plain if len(t or "") < 20_000]
    small = spark.createDataFrame([(d, t, 1, 2) for d, t in loops + few], "doc_id long, text string, start int, w int").repartition(3)
    for df, texts in ((small, loops + few), (documents, [x for x in rows if len(x[1] or "") < 6_000])):
        out = periodic.runs_digest(periodic.repeat_some(df))
        assert out.count() == df.count()
        assert not Counter(brute.periodic(texts)) - got(out, *RUNS)
    assert periodic.runs_digest(odd).count() == odd.count()


def test_periodic_general_output(spark):
    docs = spark.createDataFrame([(1, "a " + "x  y\n" * 8 + "b"), (2, None), (2, " \n")], "doc_id long, text string")
    out = sorted(map(tuple, periodic.periodic_runs(docs, least=4).collect()))
    assert out == [(1, 18, [(1, 16, 2)], "a x y b"), (2, 0, [], ""), (2, 0, [], "")]


DRAWN = ("doc_id", "n_features", "weight", "score", "rank")


def test_resample(spark, odd, plain, documents, rows):  # noqa: F811
    bench = queries.table(spark, SF_DIR, "benchmark")
    items = [r.text for r in bench.collect()]
    for df, texts, options in ((documents, rows, {}), (odd, plain, {"chunk": 4, "last": 2, "percent": 60, "min_words": 2}), (documents, rows, {"chunk": 16, "last": 1})):
        want = Counter(brute.resampled(texts, items, options.get("percent", 25), options.get("min_words", 20)))
        assert got(resample.importance_resample(df, bench, **options), *DRAWN) == want
    kept = resample.draw_documents(odd, bench)
    assert kept.columns == odd.columns and kept.count() == sum(1 for _, t in plain if len(brute.resample_words(t)) >= 20) * 25 // 100
    assert resample.importance_resample(odd, bench.limit(0)).count() == odd.count()


def test_resample_of_one_group_of_copies(spark):
    """Rows that differ in nothing: each has a rank of its own."""
    docs = spark.range(4000).selectExpr("CAST(NULL AS long) AS doc_id", "repeat('a b c ', 10) AS text", "id AS score", "'k' AS k_place").repartition(7)
    out = resample.importance_resample(docs, docs.limit(1), chunk=64, last=10, keep=("k_place", "score"))
    assert sorted(r["rank"] for r in out.filter("rank IS NOT NULL").collect()) == list(range(1, 1001)) and out.count() == 4000


def test_cutoff_key(spark):
    r = random.Random(9)
    keys = [(r.randrange(3), 0, r.randrange(40), 0, k) for k in range(5000)]
    df = spark.createDataFrame(keys, ", ".join(f"{k} long" for k in resample.KEY)).repartition(5)
    for k in (1, 2, 1250, 4999, 5000):
        assert resample.cutoff_key(df, k, chunk=100, last=1 if k == 1250 else 50) == sorted(keys)[k - 1]


def test_crc_of_long_words():
    import zlib

    import numpy as np

    words = [b"a", b"x" * 47, b"y" * 48, b"z" * 49, "über".encode() * 60]
    data = np.frombuffer(b" ".join(words), np.uint8)
    split = resample._split(data, np.array([0, len(data)]))
    one, two = (place for place, _ in resample.feature_buckets(split, 2, 10_000))
    assert one.tolist() == [zlib.crc32(w) % 10_000 for w in words]
    assert two.tolist() == [zlib.crc32(a + b" " + b) % 10_000 for a, b in zip(words, words[1:])]


def test_language_id(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    model = language_id.train(docs, max_rows=400)
    assert model.languages == ["de", "en", "es", "fr"] and sorted(sum(model.family, [])) == [0, 1, 2, 3] and len(model.family) == 2
    out = language_id.languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out["held_out"]]
    assert len(out) == docs.count() and out["score"].between(0, 1).all() and 150 < len(held) < 350
    assert (held["lang"] == held["lang_pred"]).mean() >= 0.97
    again = language_id.languages(docs.repartition(5), language_id.train(docs.repartition(3), max_rows=400)).toPandas()
    assert again.sort_values("doc_id")["lang_pred"].tolist() == out.sort_values("doc_id")["lang_pred"].tolist()


def test_language_id_learns_from_the_named_rows_only(spark):
    """Held-out rows, null ids and null languages teach nothing: their labels are words that no prediction may give."""
    from zlib import crc32

    kept = [k for k in range(200) if crc32(str(k).encode()) % 4 != 2]
    held = [k for k in range(200) if crc32(str(k).encode()) % 4 == 2]
    docs = [(k, "der die das und nicht" if k % 2 else "the cat and of not", "de" if k % 2 else "en") for k in kept]
    docs += [(k, "der die das und nicht", "never") for k in held] + [(None, "das nicht", "no"), (kept[0], "das der", None), (kept[1], "1234 !!", "digits"), (kept[2], None, "void")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language_id.train(df)
    assert model.languages == ["de", "en"]
    out = language_id.languages(df, model).collect()
    assert {r.lang_pred for r in out if r.held_out} == {"de"} and sum(r.lang_pred == "und" and r.score == 0 for r in out) == 2


def test_language_sample_is_bounded_and_misses_no_language(spark):
    kept = [k for k in range(9000) if __import__("zlib").crc32(str(k).encode()) % 4 != 2]
    rows = [(k, f"word{k} text", "big") for k in kept[:5000]] + [(kept[5000], "one text many times", f"copy{c}") for c in range(3) for _ in range(900)] + [(kept[6000], "alone", "small")]
    names, sample = language_id.sample_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6), 100, (4, 2))
    found = Counter(r.lang for r in sample.collect())
    assert names == ["big", "copy0", "copy1", "copy2", "small"] and found == {"big": 20, "copy0": 1, "copy1": 1, "copy2": 1, "small": 1}


def test_language_id_odd_rows(spark, odd, empty):  # noqa: F811
    model = language_id.train(odd)
    assert model.languages == ["en"]
    out = language_id.languages(odd, model).collect()
    assert len(out) == odd.count() and {r.lang_pred for r in out} == {"en", "und"}
    none = language_id.languages(odd, language_id.train(empty)).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert language_id.languages(empty, model).count() == 0


def test_many_languages_in_families(spark):
    """Six made-up languages of three scripts: families follow the letters, close languages are told apart inside them."""
    r = random.Random(2)
    letters = {"a1": "abcdeab", "a2": "abcdecd", "b1": "лмноплм", "b2": "лмнопно", "c1": "αβγδεαβ", "c2": "αβγδεγδ"}
    say = lambda v: " ".join("".join(r.choice(v) for _ in range(r.randrange(2, 7))) for _ in range(40))
    rows = [(k, say(v), lang) for k in range(360) for lang, v in [list(letters.items())[k % 6]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language_id.train(docs, families=3)
    assert model.family == [[0, 1], [2, 3], [4, 5]] and model.pairs == [(0, 1), (2, 3), (4, 5)]
    out = {x.doc_id: x for x in language_id.languages(docs, model).collect()}
    held = [(out[k].lang_pred, lang) for k, _, lang in rows if out[k].held_out]
    assert len(held) > 60 and sum(a == b for a, b in held) >= 0.95 * len(held)


def test_blocks_of_a_long_text_give_the_same_margins(spark, monkeypatch):
    import numpy as np

    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    model = language_id.train(docs, max_rows=100)
    texts = [r.text for r in docs.limit(20).collect()]
    data = [f" {t} ".encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    flat = np.frombuffer(b"".join(data), np.uint8)
    one = language_id._margins(flat, offsets, model)
    monkeypatch.setattr(language_id, "BLOCK", 1000)
    assert np.allclose(language_id._margins(flat, offsets, model), one, atol=1e-9)
    alone = [language_id._margins(np.frombuffer(x, np.uint8), np.array([0, len(x)]), model)[0] for x in data]
    assert np.allclose(alone, one, atol=1e-9)


def test_new_operators_on_empty_tables(empty):  # noqa: F811
    assert resample.importance_resample(empty, empty).count() == 0 and resample.draw_documents(empty, empty).count() == 0
    assert periodic.runs_digest(periodic.repeat_some(empty)).count() == 0
