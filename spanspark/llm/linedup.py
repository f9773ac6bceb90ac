"""Line deduplication across documents, decided from hashes alone.

A line's key is the line stripped of ASCII white space with A-Z in lower case. Each document sends one row per distinct
long key: a 128-bit hash, its id and the line positions. The rows are range-partitioned by (hash, id) and sorted; a
stream over each partition sees the smallest id of a hash first and drops the positions of all later ids. A hash whose
rows fill several partitions is settled by the partitions' ends (one short row per partition), so a line that a third of
all documents share is split like any other. What comes back is a compressed keep bitmap per document that loses lines,
made from positions alone; texts meet it only where the caller wants them cut.

Defined results: null text is the empty text (one empty line); a null doc_id ranks after every id and all null ids count
as one document; rows that repeat a doc_id count as one document and each keeps its own lines; keys shorter than
``min_chars`` are never dropped; an empty table gives no rows; other columns of the input are ignored unless carried.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanspark.llm.common import BLANKS, bound_batches, checkpointed, quoted, text_of

MIN_CHARS = 10
LAST_ID = 2**63 - 1
STRIP = BLANKS.encode()


def line_hashes(text: str, min_chars: int) -> dict[bytes, list[int]]:
    """128-bit hash of each long key of the text: positions of its lines."""
    found: dict[bytes, list[int]] = {}
    for at, line in enumerate(text.encode().split(b"\n")):
        key = line.strip(STRIP).lower()
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
            found.setdefault(hashlib.blake2b(key, digest_size=16).digest(), []).append(at)
    return found


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, docs_, rows_, lines = [], [], [], []
            for doc, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for digest, at in line_hashes(text, min_chars).items():
                    digests.append(digest)
                    docs_.append(doc)
                    rows_.append(row)
                    lines.append(at)
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(docs_, pa.int64()), pa.array(rows_, pa.int64()), pa.array(lines, pa.list_(pa.int32()))], ["h1", "h2", "doc", "row", "lines"])

    return docs.mapInArrow(rows, "h1 bigint, h2 bigint, doc bigint, row bigint, lines array<int>")


def runs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hash halves, the ids, and for each row the position in the batch at which its hash begins."""
    h1, h2, doc = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    return h1, h2, doc, np.maximum.accumulate(np.where(new, np.arange(len(h1)), 0))


def partition_ends(ordered: DataFrame) -> dict[int, tuple[tuple[int, int], int]]:
    """For each partition that begins inside a hash of earlier ones: that hash and its smallest id."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc, start = runs(batch)
            first = first or (int(h1[0]), int(h2[0]))
            begun = (int(h1[-1]), int(h2[-1]))
            if last is None or last[:2] != begun:
                last = (*begun, int(doc[start[-1]]))
        if first:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "f1": first[0], "f2": first[1], "l1": last[0], "l2": last[1], "doc": last[2]}])

    found, before = {}, None
    for r in sorted(ordered.select("h1", "h2", "doc").mapInArrow(ends, "part bigint, f1 bigint, f2 bigint, l1 bigint, l2 bigint, doc bigint").collect(), key=lambda r: r.part):
        if before and before[0] == (r.f1, r.f2):
            found[r.part] = before
        if not (r.part in found and (r.l1, r.l2) == before[0]):
            before = ((r.l1, r.l2), r.doc)
    return found


def later_lines(ordered: DataFrame, carried_in: dict) -> DataFrame:
    """(doc, row, lines) that a document with a smaller id holds too."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = carried_in.get(TaskContext.get().partitionId())
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc, start = runs(batch)
            owner = doc[start]
            if held and held[0] == (int(h1[0]), int(h2[0])):
                owner = np.where(start == 0, held[1], owner)
            held = ((int(h1[-1]), int(h2[-1])), int(owner[-1]))
            if (drop := doc != owner).any():
                yield batch.select(["doc", "row", "lines"]).filter(pa.array(drop))

    return ordered.mapInArrow(stream, "doc bigint, row bigint, lines array<int>")


def dropped_bitmaps(base: DataFrame, min_chars: int) -> DataFrame:
    """(doc, row, n_dropped, keep) of each row of base(doc, row, whole) that loses lines.

    keep is a zlib-compressed bit per line, up to the byte of the last line that goes; what it doesn't reach is kept.
    """
    lines = checkpointed(hashed_lines(base.select("doc", "row", "whole"), min_chars))
    order = ["h1", "h2", "doc", "row"]
    ordered = checkpointed(lines.repartitionByRange(*order).sortWithinPartitions(*order))
    dropped = later_lines(ordered, partition_ends(ordered)).groupBy("doc", "row").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"))

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bits = [], []
            for lines in batch.column("lines").to_pylist():
                keep = np.ones((max(lines) // 8 + 1) * 8, bool)
                keep[lines] = False
                sizes.append(len(lines))
                bits.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("row"), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())], ["doc", "row", "n_dropped", "keep"])

    return dropped.mapInArrow(bitmaps, "doc bigint, row bigint, n_dropped bigint, keep binary")


def with_bitmaps(docs: DataFrame, min_chars: int, carry: Sequence[str]) -> DataFrame:
    """doc_id, the carried columns as carried_0 and so on, whole (the text), n_dropped and keep (null if no line goes)."""
    base = bound_batches(docs).select("doc_id", *[F.col(quoted(c)).alias(f"carried_{k}") for k, c in enumerate(carry)], F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("doc"), text_of().alias("whole"))
    base = base.withColumn("row", F.xxhash64("doc_id", "whole"))
    # The texts stream past the short rows of their partition; neither side is sorted.
    return base.join(dropped_bitmaps(base, min_chars).hint("shuffle_hash"), ["doc", "row"], "left").drop("doc", "row")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, the carried columns, n_lines, n_dropped and keep (zlib-compressed bits up to the last line that goes, null if none goes) of docs(doc_id, text)."""
    size = (F.length("whole") - F.length(F.replace(F.col("whole"), F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("n_lines")
    own = with_bitmaps(docs, min_chars, carry)
    return own.select("doc_id", *(F.col(f"carried_{k}").alias(c) for k, c in enumerate(carry)), size, F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"), "keep")


def kept_texts(docs: DataFrame, min_chars: int = MIN_CHARS, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, text cut to its kept lines (null text: empty), and the carried columns of docs(doc_id, text)."""
    own = with_bitmaps(docs, min_chars, carry).drop("n_dropped").withColumnRenamed("whole", "text")
    names = ["doc_id", "text", *(f"carried_{k}" for k in range(len(carry)))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = batch.column("keep")
            text = batch.column("text")
            if keep.null_count < len(keep):
                text = pa.array([t if k is None else kept_text(t, k) for t, k in zip(text.to_pylist(), keep.to_pylist(), strict=True)], text.type)
            yield pa.RecordBatch.from_arrays([text if c == "text" else batch.column(c) for c in names], names)

    kept = own.mapInArrow(cut, own.select(*names).schema)
    return kept.select("doc_id", "text", *(F.col(f"carried_{k}").alias(c) for k, c in enumerate(carry)))


def kept_text(text: str | None, keep: bytes | None) -> str:
    """The lines of text that a keep bitmap leaves, joined by line ends."""
    if keep is None:
        return text or ""
    lines = (text or "").split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(lines)].tolist()
    return "\n".join([x for x, b in zip(lines, bits, strict=False) if b] + lines[len(bits) :])
