"""Line deduplication over levelled sorted runs of line hashes.

The index is a folder of runs. A run is a table of line hashes sorted inside hash partitions, with the number of documents that hold the line
and the largest of their ids. A new batch is anti-joined with the runs: hashes that no run holds go into the run of the batch as new lines, the
others as additions to lines already known. When a level has ``fanout`` runs they are compacted into one run of the next level, so a hash
takes part in as many merges as there are levels. Batches arrive from the largest ids down when the last holder of a line is to keep it.

Line hashes are MD5 (16 bytes) of the key: the line without blanks (space, 0x09-0x0D) at both ends, A-Z lower-cased.

Defined results: null and empty texts are one empty line; rows that repeat a ``doc_id`` are one document when documents are counted, and each
row is returned; null ids are one document that comes before all others; an empty table gives an empty result; columns other than ``doc_id`` and
``text`` are not read and may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lifethread.llm.arrays import BLANKS
from lifethread.runtime import materialize, scratch_path

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUN = "h binary, docs long, last long, fresh boolean"
#: Stands for a null id where documents are counted.
_NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), _UPPER, _LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(key: Column) -> Column:
    return F.unhex(F.md5(key))


def line_records(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, h): the distinct keys of at least ``min_chars`` code points of each row."""
    keys = F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: F.char_length(k) >= min_chars)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array_distinct(F.transform(keys, _hash))).alias("h"))


@dataclass
class LineRuns:
    """The runs by level, as paths in the shared folder. Over all runs a hash has one fresh row, and one more for each batch that added to it."""

    spark: SparkSession
    fanout: int = 4
    levels: list[list[str]] = field(default_factory=list)

    def rows(self) -> DataFrame:
        paths = [p for level in self.levels for p in level]
        return self.spark.read.schema(_RUN).parquet(*paths) if paths else self.spark.createDataFrame([], _RUN)

    def add(self, records: DataFrame) -> DataFrame:
        """Add a batch of (doc_id, h) as a sorted run and compact full levels; gives the batch's run, ``fresh`` where no run held the hash."""
        batch = records.groupBy("h").agg(F.count_distinct(F.coalesce("doc_id", F.lit(_NO_ID))).alias("docs"), F.max("doc_id").alias("last"))
        if any(self.levels):
            seen = self.rows().filter("fresh").select("h", F.lit(False).alias("new"))
            batch = batch.join(seen, "h", "left").select("h", "docs", F.when(F.col("new").isNull(), F.col("last")).alias("last"), F.col("new").isNull().alias("fresh"))
        else:
            batch = batch.withColumn("fresh", F.lit(True))
        return self.spark.read.schema(_RUN).parquet(self._put(0, batch))

    def totals(self) -> DataFrame:
        """(h, docs, last): documents with the line, and the last id of the batch in which it was new."""
        return self._merged(self.rows()).select("h", "docs", "last")

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("h").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"), F.max("fresh").alias("fresh"))

    def _put(self, level: int, rows: DataFrame) -> str:
        while len(self.levels) <= level:
            self.levels.append([])
        path = scratch_path(self.spark, f"lines-{level}")
        rows.select("h", "docs", "last", "fresh").sortWithinPartitions("h").write.parquet(path)
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._merged(self.spark.read.schema(_RUN).parquet(*full)))
        return path


def index_lines(docs: DataFrame, min_chars: int = 40, batches: int = 4, fanout: int = 3) -> tuple[DataFrame, LineRuns]:
    """Records of all documents, and the runs built from them in ``batches`` ranges of ids, largest ids first and null ids last."""
    spark = docs.sparkSession
    records = materialize(line_records(docs, min_chars), "line-records")
    index = LineRuns(spark, fanout)
    low, high = records.agg(F.min("doc_id"), F.max("doc_id")).first()
    cuts = [None, None] if low is None else [high + 1, *(low + (high + 1 - low) * k // batches for k in range(batches - 1, 0, -1)), None]
    for top, bottom in zip(cuts, cuts[1:]):
        part = F.lit(True) if top is None else F.col("doc_id") < top
        if bottom is not None:
            part &= F.col("doc_id") >= bottom
        elif top is not None:
            part |= F.col("doc_id").isNull()
        index.add(records.filter(part))
    return records, index


def drop_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every row as ``keep_<name>``, with ``had_text``, and the arrays ``lines`` (before) and ``kept`` (after).

    Lines whose key has at least ``min_chars`` code points and is in at least ``min_docs`` documents go, except in the largest id that holds it.
    """
    records, index = index_lines(docs, min_chars, batches, fanout)
    common = materialize(index.totals().filter(F.col("docs") >= min_docs).select("h", "last"), "lines-common")  # a plain table, so that Spark can split a very common line
    doomed = records.join(common, "h").filter(~F.col("doc_id").eqNullSafe(F.col("last"))).groupBy("doc_id").agg(F.collect_set("h").alias("drop"))
    doomed = doomed.withColumnRenamed("doc_id", "of")
    kept_as = [f"`keep_{k}`" for k in keep]
    rows = docs.select(*(F.col(f"`{k}`").alias(f"keep_{k}") for k in keep), F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("body"))
    both = rows.join(doomed, F.col("doc").eqNullSafe(F.col("of")), "left").select(*kept_as, lines_of(F.col("body")).alias("lines"), F.col("body").isNotNull().alias("had_text"), "drop")
    kept = F.filter("lines", lambda x: ~F.array_contains(F.col("drop"), _hash(line_key(x))))
    return both.select(*kept_as, "had_text", "lines", F.when(F.col("drop").isNull(), F.col("lines")).otherwise(kept).alias("kept"))


def line_dedup_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of ``drop_lines``."""
    size = lambda c: F.size(c).cast("long")
    return drop_lines(docs, **options).select(
        F.col("keep_doc_id").alias("doc_id"), size("lines").alias("n_lines"), (size("lines") - size("kept")).alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n").cast("binary"), 256).alias("kept_sha256"))


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """The documents with the columns they came with; ``text`` holds the kept lines, ``n_chars`` (if there) its new length."""
    out = drop_lines(docs, keep=tuple(c for c in docs.columns if c != "text"), **options)
    text = F.when(F.col("had_text"), F.array_join("kept", "\n"))
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return out.select(*((new[c] if c in new else F.col(f"`keep_{c}`")).alias(c) for c in docs.columns))


ORACLE = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL AND k.doc_id <> c.last) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL OR k.doc_id = c.last), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY k.doc_id
"""
