"""Tokens per document in flat token files without an index, by a vectorised scan for the end-of-document id.

A token file is a run of 16-bit ids (little-endian); every document ends with ``eod``. Files are read in parts of ``BLOCK`` ids. A part is scanned
once and gives the tokens before its first separator, those between separators, and those after its last; documents that cross parts are
stitched by an exclusive prefix scan over the parts' tails, over parts of a file and over the files of a stream in name order, so a document may span
any number of parts. Files may be gzip streams (``.gz``). ``write_tokens`` makes such files from texts with a public tokenizer.

A document may begin with ``header`` ids that are not counted; the writer puts the document's number there (digits of 13 bits, none of which is
``eod``), as the files have no other place for it.

Defined results: null and empty texts are documents of no token; a null number has a bit of its own and is read as null; a last document without separator is
reported with ``closed`` false; repeated ids give a row each; an empty table or folder gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lifethread.llm.arrays import map_arrow
from lifethread.runtime import scratch_path

EOD = 50256
BLOCK = 1 << 20
_DIGIT, _DIGITS = 13, 5
_ENCODING: dict[str, object] = {}


def vocabulary(name: str = "byte_bpe_50k.tiktoken", folder: str = "/opt/tokenizers") -> str:
    return os.path.join(folder, name)


def _encoding(path: str):  # noqa: ANN202
    """The tokenizer of a rank file, once per worker."""
    if path not in _ENCODING:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        # Fixed value: the splitting pattern that belongs to this vocabulary.
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        _ENCODING[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODING[path]


def tokenize(text: str, path: str, piece: int = 1 << 16) -> np.ndarray:
    """Ids of a text. Long texts are encoded in parts cut before a newline or a space, where the pattern cuts them too."""
    coder, out, lo = _encoding(path), [], 0
    while lo < len(text):
        hi = lo + piece
        if hi < len(text):
            while hi < len(text) and not (text[hi] == " " and text[hi - 1].isalpha() and text[hi + 1: hi + 2].isalpha()):
                hi += 1
        out.append(np.array(coder.encode_ordinary(text[lo:hi]), np.uint16))
        lo = hi
    return np.concatenate(out) if out else np.zeros(0, np.uint16)


def _number(doc_id: int | None) -> list[int]:
    """64 bits in two's complement, and one bit more that only null has."""
    n = 1 << 64 if doc_id is None else doc_id & ((1 << 64) - 1)
    return [(n >> (_DIGIT * k)) & ((1 << _DIGIT) - 1) for k in range(_DIGITS)]


def write_tokens(docs: DataFrame, path: str, vocabulary_path: str | None = None) -> None:
    """Write (doc_id, text) as token files. Spark's text writer puts the separator after every row, so a file is the flat run of ids."""
    at = vocabulary_path or vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                yield {"ids": [np.concatenate((np.array(_number(d), np.uint16), tokenize(t or "", at))).astype("<u2").tobytes() for d, t in zip(ids, texts)]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    end = int(EOD).to_bytes(2, "little").decode("latin-1")
    flat = map_arrow(rows, encode, "ids binary").select(F.col("ids").cast("string").alias("value"))  # the cast keeps the bytes as they are
    flat.write.option("lineSep", end).option("encoding", "ISO-8859-1").option("compression", "gzip").text(path)


def scan_block(ids: np.ndarray, eod: int, header: int) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """(ids before the first separator or all, ids after the last, lengths of the documents between, their headers, first ids of the tail)."""
    cut = np.flatnonzero(ids == eod)
    if not len(cut):
        return len(ids), len(ids), np.zeros(0, np.int64), np.zeros((0, header), np.uint16), ids[:header]
    start, length = cut[:-1] + 1, np.diff(cut) - 1
    heads = ids[np.minimum(start[:, None] + np.arange(header), len(ids) - 1)] if header else np.zeros((len(start), 0), np.uint16)
    return int(cut[0]), len(ids) - int(cut[-1]) - 1, length, heads, ids[cut[-1] + 1: cut[-1] + 1 + header]


def count_tokens(spark: SparkSession, path: str, eod: int = EOD, header: int = 0, block: int = BLOCK, stream: str | None = None) -> DataFrame:
    """(file, position, head, n_tokens, closed) of every document: ``position`` counts the documents of a part, ``head`` are its header ids.

    ``stream``: a pattern whose first group names the stream of a file; files of a stream are one run of ids in name order. Without it each file is one.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                raw = content.as_buffer()
                data = gzip.decompress(raw) if name.endswith(".gz") else raw
                ids = np.frombuffer(data, "<u2")
                for k, lo in enumerate(range(0, len(ids), block)):
                    part = ids[lo: lo + block]
                    before, after, length, heads, tail = scan_block(part, eod, header)
                    yield {"file": [name], "part": [k], "closes": [bool((part == eod).any())], "first": [part[: min(header, before)].tolist()], "before": [before],
                           "after": [after], "lengths": [length], "heads": [heads.tolist()], "tail": [tail.tolist()]}

    ddl = "file string, part int, closes boolean, first array<int>, before long, after long, lengths array<long>, heads array<array<int>>, tail array<int>"
    parts = map_arrow(files, scan, ddl)
    parts = parts.withColumn("stream", F.regexp_extract("file", stream, 1) if stream else F.col("file"))
    inner = parts.select("file", "part", F.posexplode(F.arrays_zip("lengths", "heads")).alias("position", "x")).select(
        "file", "part", "position", F.col("x.heads").alias("head"), (F.col("x.lengths") - header).alias("n_tokens"), F.lit(True).alias("closed"))
    # Prefix scan: what is open before a part is the tail since the last part with a separator. Narrow rows, one per part.
    edges = parts.select("stream", "file", "part", "closes", "first", "before", "after", "tail")
    order = Window.partitionBy("stream").orderBy("file", "part")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    runs = edges.withColumn("run", F.coalesce(F.sum(F.col("closes").cast("int")).over(past), F.lit(0)))  # parts of one open document
    grouped = runs.groupBy("stream", "run").agg(
        F.min_by(F.col("file"), F.struct("file", "part")).alias("file"), F.min("part").alias("part"), F.sum("before").alias("ids"), F.max("closes").alias("closed"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("file", "part", "first"))), lambda x: x.first)).alias("first"))
    opened = runs.filter("closes").select("stream", (F.col("run") + 1).alias("run"), F.col("after").alias("carried"), F.col("tail").alias("tail"), F.col("file").alias("of_file"), F.col("part").alias("of_part"))
    stitched = grouped.join(opened, ["stream", "run"], "full").select(
        F.coalesce("of_file", "file").alias("file"), F.coalesce("of_part", "part").alias("part"), F.lit(-1).alias("position"),
        F.slice(F.concat(F.coalesce("tail", F.array().cast("array<int>")), F.coalesce("first", F.array().cast("array<int>"))), 1, max(header, 1)).alias("head"),
        (F.coalesce("carried", F.lit(0)) + F.coalesce("ids", F.lit(0)) - header).alias("n_tokens"), F.coalesce("closed", F.lit(False)).alias("closed"))
    stitched = stitched.filter(F.col("closed") | (F.col("n_tokens") + header > 0))
    return inner.unionByName(stitched).select("file", "position", "head", "n_tokens", "closed")


def document_counts(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens: the documents are written as token files to the shared folder, and the files are scanned."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, vocabulary_path)
    digit = lambda k: F.shiftleft(F.element_at("head", k + 1).cast("long"), _DIGIT * k)
    number = digit(0)
    for k in range(1, _DIGITS):
        number = number.bitwiseOR(digit(k))
    found = count_tokens(spark, path, header=_DIGITS)
    null = F.element_at("head", _DIGITS) >= 1 << (64 - _DIGIT * (_DIGITS - 1))
    return found.select(F.when(~null, number).alias("doc_id"), F.col("n_tokens").cast("long").alias("n_tokens"))
