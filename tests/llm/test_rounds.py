"""Near copies compared in rounds, and tables that go when nothing reads them any more."""

from __future__ import annotations

import glob
import os
from collections import Counter
from fractions import Fraction

import numpy as np

from lifethread.llm import jaccard
from lifethread.runtime import forget, materialize, scratch_root


def copies(spark):
    rows = [(k, " ".join(f"w{(k * 7919 * (j % 11 == 0) + j * 31 + k % 3) % 5000}" for j in range(40 + k % 9))) for k in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_rounds_give_the_same_links(spark, monkeypatch):
    docs = copies(spark)
    whole = Counter(map(tuple, jaccard.jaccard_join(docs, least=Fraction(1, 3)).collect()))
    seen = []
    rounds = jaccard._rounds
    monkeypatch.setattr(jaccard, "_rounds", lambda rows, size, most: [x for x in rounds(rows, size, 1 << 15) if seen.append(1) is None])
    assert Counter(map(tuple, jaccard.jaccard_join(docs, least=Fraction(1, 3), block=20).collect())) == whole
    assert len(seen) > 4 and sum(x[4] for x in whole.elements()) > 0


def test_parts_of_one_byte_and_of_four():
    few, many = np.arange(128) % 5, np.arange(128) * 300
    assert len(jaccard._packed(few)) == 128 and len(jaccard._packed(many)) == 512
    assert (jaccard._unpacked([jaccard._packed(few)] * 2) == [few, few]).all()
    assert (jaccard._unpacked([jaccard._packed(few), jaccard._packed(many)]) == [few, many]).all()


def test_tables_of_the_join_are_removed(spark):
    root = scratch_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    jaccard.one_of_each(copies(spark), least=Fraction(1, 3)).count()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before}
    assert "jaccard-classed" in left and not left & {"jaccard-named", "jaccard-held", "jaccard-compared", "jaccard-texts", "jaccard-linked", "components-least"}


def test_no_shuffle_files_stay_behind_a_table(spark):
    local = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    files = lambda: {f for d in local for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before = files()
    table = materialize(spark.range(1000).repartition(7, "id").groupBy("id").count(), "stay")
    assert not files() - before and table.count() == 1000
    path = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    forget(table)
    assert not os.path.exists(path)
