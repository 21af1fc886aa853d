"""The operators against plain Python versions: the driver's smallest tables, and a table of odd cases."""

import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lifethread.llm import decontaminate, jaccard, language_model, line_dedup, mixing, pii, quality, queries, substring, token_counts, toxicity
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"
#: Columns named like those that operators make.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, size string, place string, taken string, row string, y int"


def odd_rows():
    r = random.Random(4)
    vocabulary = ["the", "of", "and", "Zwölf", "été", "keit,", "x", "über"] + [f"w{k}" for k in range(400)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, line = say(60), "A line that many documents have, word for word"
    base = say(120)
    texts = [None, "", "  \n\t ", "\n\n", "one", "one two", "a\x1cb \x0b c d", say(30_000), base, base, base + " more", "new " + base, base.upper(), passage, say(40) + " " + passage + " " + say(40)]
    texts += [say(80) + " " + passage for _ in range(6)] + [f"{say(30)}\n  {line}  \n{say(20)}\n{line.upper()}" for _ in range(7)]
    texts += ["mail me: a.b+c@mail.example.com, or a@b@c.de! 1.2.3.4.5 999.1.1.1 10.0.0.255", "4111 1111 1111 1111 4111111111111111 +1 (017) 555-7713 x+49-30-1234567890.",
              "7536784127813050 4845168114407329", "9" * 60 + "." * 9, "@" * 20 + "a@b.c" * 3]
    texts += ["spam | spam | spam | spam " * 30, "\n".join([say(5)] * 4 + ["", ""])]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(3, say(50)), (8, base), (8, base), (None, passage), (None, None), (1 << 40, say(25)), (-5, passage)]
    source = ["a", "b", None, "", "Z"]
    return [(d, t, None if k % 5 == 0 else "en", source[k % 5], None, k, "s", "p", "t", "r", k % 2) for k, (d, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def plain():
    return [(r[0], r[1]) for r in odd_rows()]


@pytest.fixture(scope="module")
def unique(spark):
    """The odd rows with ids of their own."""
    return spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(odd_rows())], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def documents(spark):
    return queries.table(spark, SF_DIR, "documents")


@pytest.fixture(scope="module")
def rows(documents):
    return [(r.doc_id, r.text) for r in documents.collect()]


@pytest.fixture(scope="module")
def labels(spark):
    return queries.table(spark, SF_DIR, "labels")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


LINES = ("doc_id", "n_lines", "n_dropped", "kept_sha256")


@pytest.mark.parametrize("batches", [1, 5])
def test_lines(odd, plain, documents, rows, batches):
    assert got(line_dedup.line_dedup_digest(odd, batches=batches, fanout=2), *LINES) == Counter(brute.lines(plain))
    assert got(line_dedup.line_dedup_digest(documents, batches=batches), *LINES) == Counter(brute.lines(rows))


def test_line_dedup_keeps_rows_and_columns(odd, empty):
    out = line_dedup.line_dedup(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert line_dedup.line_dedup(empty).count() == 0


@pytest.mark.parametrize(("size", "least", "block"), [(3, Fraction(9, 10), 100), (5, Fraction(4, 5), 2), (1, Fraction(1, 2), 3)])
def test_jaccard(odd, plain, size, least, block):
    out = jaccard.jaccard_join(odd, size, least, block)
    assert got(out, "doc_id", "n_shingles", "component_id", "links") == Counter(brute.jaccard(plain, size, least.numerator, least.denominator))


def test_jaccard_documents(documents, rows):
    out = jaccard.jaccard_join(documents, 3, Fraction(9, 10))
    assert got(out, "doc_id", "n_shingles", "component_id", "links") == Counter(brute.jaccard(rows, 3, 9, 10))


def test_one_of_each(unique, plain):
    kept = {r.doc_id for r in jaccard.one_of_each(unique, 5, Fraction(4, 5)).collect()}
    assert kept == {d for d, _, c, _ in brute.jaccard(list(enumerate(t for _, t in plain)), 5, 4, 5) if c == d}


def test_one_of_each_decides_by_row(odd, unique, plain):
    """Repeated and null ids: every group keeps one row, and rows without words all stay."""
    numbered = brute.jaccard(list(enumerate(t for _, t in plain)), 5, 4, 5)
    groups, none = {}, Counter()
    for k, n, c, _ in numbered:
        if n:
            groups.setdefault(c, []).append(plain[k])
        else:
            none[plain[k]] += 1
    least = {g: min(((d is None, d or 0) for d, _ in rows)) for g, rows in groups.items()}
    kept = got(jaccard.one_of_each(odd, 5, Fraction(4, 5)), "doc_id", "text")
    assert Counter({x: n for x, n in kept.items() if x in none}) == none
    rest = list((kept - none).elements())
    assert len(rest) == len(groups)
    for g, rows in groups.items():
        (one,) = [x for x in rest if x in rows]
        assert (one[0] is None, one[0] or 0) == least[g]


def test_contaminated_rows_go_by_themselves(spark, odd):
    bench = queries.table(spark, "/root/testdata/sf0.01", "benchmark")
    text = max((r.text for r in bench.collect()), key=len)
    bad = odd.limit(1).selectExpr("explode(array(null, 3L)) AS doc_id", "1 AS z").join(odd.drop("doc_id").limit(1)).drop("z").selectExpr("doc_id", *odd.columns[1:])
    from pyspark.sql import functions as F

    both = odd.unionByName(bad.withColumn("text", F.lit(text)))
    assert got(decontaminate.drop_contaminated(both, bench), "doc_id", "text") == got(odd, "doc_id", "text")


SUBSTRING = ("n_words", "n_removed", "kept_sha256")


def test_substring(unique, plain, documents, rows):
    texts = [(k, t) for k, (_, t) in enumerate(plain)]
    for df, want in ((unique, brute.substring(texts)), (documents, brute.substring(rows))):
        assert {r.doc_id: tuple(r[c] for c in SUBSTRING) for r in substring.substring_digest(df).collect()} == want


def test_substring_spans_cover_what_is_removed(unique):
    spans = Counter()
    for r in substring.removal_spans(unique).collect():
        spans[r.doc_id] += r.last_word - r.first_word + 1
    assert spans == Counter({r.doc_id: r.n_removed for r in substring.substring_digest(unique).collect() if r.n_removed})


@pytest.mark.parametrize("frequent", [4096, 40, 1])
def test_substring_hot_windows_are_no_rows(spark, monkeypatch, frequent):
    """Windows of very many documents go to all tasks instead of making a row for each document; results are those of plain Python."""
    monkeypatch.setattr(substring, "FREQUENT", frequent)
    common, rare = " ".join(f"c{i}" for i in range(40)), " ".join(f"r{i}" for i in range(25))
    rows = [(i, f"a{i} b{i} {common} z{i}" + (f" {rare} {common}" if i % 10 == 3 else "")) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: tuple(r[c] for c in SUBSTRING) for r in substring.substring_digest(df).collect()} == brute.substring(rows)
    marked, hot = substring.mark_repeats(df)
    listed = marked.agg(F.sum(F.coalesce(F.size("doomed"), F.lit(0)))).first()[0]
    every = 59 * 21 + 5 * 6  # windows of the passages that a smaller id holds
    assert (len(hot[0]), listed >= every) == (0, True) if frequent == 1 else len(hot[0]) >= 21 and listed < every


def test_substring_same_id_is_one_place(odd):
    assert substring.substring_digest(odd).count() == odd.count()


def test_mixing(odd, documents, rows):
    for df in (odd, documents):
        out = mixing.mix(df, block_words=500, shards=8).toPandas()
        size = out.assign(source=out["source"].astype(object).where(out["source"].notna(), None)).groupby("source", dropna=False)
        sums = {(None if s != s or s is None else s): g for s, g in size}
        want = brute.targets({s: int(g["size"].sum()) for s, g in sums.items()})
        for s, g in sums.items():
            assert abs(g["target"].iloc[0] - want[s]) < 1e-6 and (g["source_size"] == g["size"].sum()).all()
            assert abs(g["taken"].sum() - want[s]) <= 0.5 and (g["taken"] <= 2 * g["size"]).all()
        again = mixing.mix(df.repartition(5), block_words=500, shards=8).toPandas()
        key = ["doc_id", "source", "size", "taken"]
        assert Counter(map(str, again[key].values.tolist())) == Counter(map(str, out[key].values.tolist()))
    assert Counter(r["size"] for r in mixing.mix_digest(documents).collect()) == Counter(len(brute.words(t)) for _, t in rows)


def test_mix_documents_holds_the_drawn_words(odd):
    drawn, out = mixing.mix(odd, shards=4).toPandas(), mixing.mix_documents(odd, shards=4).toPandas()
    assert out["mix_words"].sum() == drawn["taken"].sum() and set(out["mix_shard"]) <= set(range(4))
    assert (out["mix_copy"] < 2).all() and "mix_order" in out


def test_hypergeometric(spark):
    from pyspark.sql import functions as F

    df = spark.range(20_000).select(mixing.hypergeometric(F.lit(30).cast("long"), F.lit(12).cast("long"), F.lit(10).cast("long"), mixing.uniform(F.col("id"))).alias("x"))
    seen = Counter(r.x for r in df.collect())
    from math import comb

    for k in range(11):
        p = comb(12, k) * comb(18, 10 - k) / comb(30, 10)
        assert abs(seen[k] / 20_000 - p) < 5 * (p * (1 - p) / 20_000) ** 0.5 + 1e-4
    quotas = spark.sql("SELECT array(5L, 0L, 40L, 1L) AS quotas")
    tree = [r.quotas for r in mixing.split_quotas(quotas, 8, 3).collect()]
    assert len(tree) == 8 and np.sum(tree, 0).tolist() == [5, 0, 40, 1] and max(map(sum, tree)) - min(map(sum, tree)) <= 3


LM = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")


def test_language_model(odd, plain, documents, rows):
    for df, texts in ((odd, plain), (documents, rows)):
        out, want = language_model.score(df, bucket_bytes=1 << 16), brute.language_base(texts)
        assert got(out, *LM) == Counter(x[:5] for x in want)
        order = lambda v: sorted(v)
        assert np.allclose(order(r.base_score for r in out.collect()), order(x[5] for x in want), rtol=1e-9)
        assert all(r.score < 0 for r in out.collect())


def test_language_model_beats_the_base(spark):
    out = language_model.score(queries.table(spark, "/root/testdata/sf0.01", "documents")).toPandas()
    held = out[out["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()


def test_language_model_sums_to_one(spark):
    """One-word documents: the probabilities of all known first words and the unknown one."""
    docs = spark.createDataFrame([(k, w) for k, w in enumerate(["b", "b c", "c", "a b", "a a a", "longer words here", "c c"] * 3)], "doc_id long, text string")
    vocabulary = sorted({w for _, t in docs.collect() for w in t.split()})
    asked = [w for w in [*vocabulary, "unseen"]]
    held = [k for k in range(1000, 4000) if __import__("zlib").crc32(str(k).encode()) % 7 == 2][: len(asked) + 1]
    both = docs.union(spark.createDataFrame([*zip(held, asked), (held[-1], "")], "doc_id long, text string"))
    out = {r.doc_id: r for r in language_model.score(both).collect()}
    # P(word, end) = P(word) P(end | word's context); all these words are short or not, so only bound the sum of first-word probabilities
    ends = 10 ** out[held[-1]].score
    assert 0 < ends < 1 and all(out[k].score < 0 for k in held)
    assert sum(10 ** out[k].score for k in held) <= 1 + 1e-9


def test_pii(odd, plain, documents, rows):
    for df, texts in ((odd, plain), (documents, rows)):
        model = pii.train(pii.small_table(df, 200))
        out = pii.pii(df, model)
        assert got(out, "doc_id", "base_sha256") == Counter((d, brute.sha(brute.spans(t))) for d, t in texts)
        for r in out.collect():
            assert r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added == len([s for s in r.spans.split(",") if s])


def test_pii_field_adds_joined_cards(spark):
    docs = queries.table(spark, "/root/testdata/sf0.1", "documents")
    model = pii.train(pii.small_table(docs))
    asked = spark.createDataFrame([(1, "aa bb 7536784127813050 4845168114407329 cc dd"), (2, "nothing here, 2024 or 17"), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.pii(asked, model).collect()}
    assert out[1].n_card == 0 and out[1].spans == "card:6:22,card:23:39"
    assert out[2].spans == "" and out[3].spans == ""


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(2)
    n = len(pii.LABELS)
    e, move = r.normal(0, 2, (4, n)), r.normal(0, 1, (n, n))
    (best,) = pii.viterbi([e], move)
    step = move + pii._ALLOWED
    score = lambda y: pii._START[y[0]] + sum(e[t, y[t]] for t in range(4)) + sum(step[y[t], y[t + 1]] for t in range(3))
    every = max(np.ndindex(n, n, n, n), key=score)
    assert tuple(best) == every


def test_token_counts(odd, plain):
    coder = token_counts._encoding(token_counts.vocabulary())
    want = Counter((d, len(coder.encode_ordinary(t or ""))) for d, t in plain)
    assert Counter((r.doc_id, r.n_tokens) for r in token_counts.document_counts(odd).collect()) == want


@pytest.mark.parametrize("block", [7, 16, 1 << 20])
def test_token_parts_are_stitched(spark, tmp_path, block):
    r = np.random.default_rng(0)
    lengths = [int(r.integers(0, 300 if k % 7 == 0 else 40)) for k in range(120)]
    ids = np.concatenate([np.append(r.integers(0, 100, n), token_counts.EOD) for n in lengths] + [[5, 6]]).astype("<u2")
    for k, (a, b) in enumerate([(0, 1000), (1000, 1003), (1003, len(ids))]):
        ids[a:b].tofile(tmp_path / f"part-{k}.bin")
    out = token_counts.count_tokens(spark, str(tmp_path), block=block, stream="(run|part)").toPandas()
    assert sorted(out["n_tokens"]) == sorted([*lengths, 2]) and (~out["closed"]).sum() == 1


QUALITY = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_quality(odd, plain, documents, rows, labels):
    for df, texts in ((odd, plain), (documents, rows)):
        out = quality.quality(df, quality.train(documents, labels))
        assert got(out, "doc_id", *QUALITY) == Counter((d, *brute.quality(t)) for d, t in texts)
        for r in out.collect():
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)


def test_quality_accuracy(spark):
    docs, labels = (queries.table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    fit, ask = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    out = quality.quality(docs, quality.train(docs, fit)).join(ask, "doc_id").filter("NOT base_failed").toPandas()
    assert ((out["p_good"] >= 0.5) == (out["quality"] == 1)).mean() > 0.9


def test_toxic_segments_are_maximal():
    def brute_force(x):
        out = []

        def go(lo, hi):
            best = None
            for a in range(lo, hi):
                total = 0.0
                for b in range(a, hi):
                    total += x[b]
                    if total > 1e-12 and (best is None or total > best[0] + 1e-9):
                        best = (total, a, b)
            if best:
                go(lo, best[1])
                out.append(best[1:])
                go(best[2] + 1, hi)

        go(0, len(x))
        return out

    r = np.random.default_rng(1)
    for _ in range(200):
        v = np.where(r.random(12) < 0.5, r.normal(0.5, 2, 12), 0.0)
        at = np.flatnonzero(v)
        assert [s[:2] for s in toxicity.maximal_segments(at, v[at], 0.3)] == brute_force((v - 0.3).tolist())


def test_toxicity(spark, odd):
    docs, labels = (queries.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    held = toxicity.toxicity(docs, model).filter("held_out").join(labels, "doc_id").toPandas()
    hit = ((held["predicted"] == 1) & (held["toxic"] == 1)).sum()
    assert hit / (held["predicted"] == 1).sum() > 0.75 and hit / (held["toxic"] == 1).sum() > 0.6
    out = toxicity.toxicity(odd, model).toPandas()
    assert len(out) == odd.count() and out["score"].between(0, 1).all() and (out["predicted"] == (out["score"] >= 0.3)).all()
    assert toxicity.toxic_passages(docs, model).limit(5).count() == 5
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns


def test_decontaminate(spark, odd):
    bench = queries.table(spark, "/root/testdata/sf0.01", "benchmark")
    items = {r.item_id: r.text for r in bench.collect()}
    r = random.Random(1)
    drop = lambda t: " ".join(w for w in brute.words(t) if r.random() > 0.15)
    fill = lambda n: " ".join(f"filler{r.randrange(10_000)}" for _ in range(n))
    long = [k for k, t in items.items() if len(brute.words(t)) > 25][:6]
    planted = [(1000 + k, f"{fill(100)} {drop(items[k])} {fill(77)}") for k in long] + [(2000 + k, items[k].upper()) for k in long] + [(3000 + k, fill(300)) for k in range(20)]
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").filter("doc_id < 200").union(spark.createDataFrame(planted, "doc_id long, text string"))
    hits = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, bench).collect()}
    assert {(1000 + k, k) for k in long} | {(2000 + k, k) for k in long} <= hits and not any(d >= 3000 for d, _ in hits)
    assert decontaminate.drop_contaminated(odd, bench).columns == odd.columns
    few = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, bench, block_items=15).collect()}
    assert {(1000 + k, k) for k in long} | {(2000 + k, k) for k in long} <= few


def test_answer_is_of_rare_words(spark):
    """Function words may change, the rare words may not."""
    r = random.Random(6)
    common, fill = [f"common{k}" for k in range(7)], lambda n: [f"filler{r.randrange(10_000)}" for _ in range(n)]
    own = {i: [f"own{i}x{j}" for j in range(9)] for i in range(8)}
    item = lambda i, c, o: " ".join(w for k in range(9) for w in ([c[k], o[k]] if k < 7 else [o[k]]))
    bench = spark.createDataFrame([(i, item(i, common, own[i])) for i in own], "item_id long, text string")
    often = [(900 + k, " ".join(w for _ in range(20) for w in [*r.sample(common, 4), *own[0][4:], *fill(5)])) for k in range(30)]
    changed = ["changed", "words", *common[2:4], "of", "another", "kind"]
    other = ["not", "that", "answer", "here", *own[0][4:]]
    planted = [(1, item(1, changed, own[1])), (2, item(0, common, other)), (3, item(0, common, own[0]))]
    docs = spark.createDataFrame(often + [(d, " ".join([*fill(60), t, *fill(60)])) for d, t in planted], "doc_id long, text string")
    hits = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, bench, answer_share=0.8).collect() if x.doc_id < 900}
    assert hits == {(1, 1), (3, 0)}


def test_blocks_of_items_give_the_same_hits(spark):
    docs, bench = (queries.table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "benchmark"))
    texts = [r.text for r in bench.orderBy("item_id").collect()]
    docs = docs.select("doc_id", "text").filter("doc_id < 300").union(spark.createDataFrame([(5000 + k, f"{t} " * 2) for k, t in enumerate(texts)], "doc_id long, text string"))
    one, many, far = (got(decontaminate.contaminated(docs, bench, **o), "doc_id", "item_id", "first_word", "lcs") for o in ({}, {"block_items": 7}, {"least_cosine": 1.1}))
    assert one == many == far and {(5000 + k, k) for k in range(len(texts))} <= {x[:2] for x in one}


def test_lcs():
    r = random.Random(3)
    for _ in range(100):
        a, b = ([r.randrange(4) for _ in range(r.randrange(1, 12))] for _ in "ab")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(np.array(a), np.array(b)) == t[-1][-1]


def test_empty_tables(spark, empty, labels):
    bench = queries.table(spark, SF_DIR, "benchmark")
    none = labels.limit(0)
    tables = [
        line_dedup.line_dedup_digest(empty), jaccard.jaccard_join(empty), jaccard.one_of_each(empty), substring.substring_digest(empty), mixing.mix_digest(empty),
        mixing.mix_documents(empty), language_model.score(empty), pii.pii(empty, pii.train(pii.small_table(empty))), token_counts.document_counts(empty),
        quality.quality(empty, quality.train(empty, none)), toxicity.toxicity(empty, toxicity.train(empty, none)), decontaminate.contaminated(empty, bench),
    ]
    assert [t.count() for t in tables] == [0] * len(tables)


def test_without_labels_or_items(spark, odd, labels):
    none = labels.limit(0)
    assert all(r.kept != r.base_failed for r in quality.quality(odd, quality.train(odd, none)).collect())
    assert toxicity.toxicity(odd, toxicity.train(odd, none)).count() == odd.count()
    assert decontaminate.contaminated(odd, queries.table(spark, SF_DIR, "benchmark").limit(0)).count() == 0
