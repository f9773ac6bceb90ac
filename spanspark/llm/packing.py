"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

A task tokenises its documents and sends on one short row per piece (never ids or text). Pieces are dealt evenly over
groups of about ``group_pieces`` rows, so no group grows with the input or with any key. The groups are shuffled over
the session's partitions, however many groups there are, and stream through a task one by one: a bin is filled greedily with the largest pieces that fit, then its smallest piece is replaced by the two
unpacked pieces that together fill the widened gap more tightly, until no such pair is tighter.

Defined results: null text is the empty text (one piece of one token, the end id); rows with the same or a null doc_id
are documents of their own; equal lengths are taken in the order they come; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanspark.llm.common import bound_batches, text_of
from spanspark.llm.tokens import LETTER, load, spelled

CAPACITY, END_ID, GROUP_PIECES = 4096, 1, 8192
CACHE_WORDS = 250_000
#: Texts of plain Latin characters without an apostrophe or control string; in them a mark after a letter is a part by itself.
PLAIN = re.compile("[\t\n -&(-;=-~\xa1-įı-ɏ]*")
MARKS = re.compile(f"(?<=[{LETTER}])([.,])(?=[ \n])")
ODD_MARKS = re.compile("[^a-z\xdf-\xf6\xf8-\xff][.,][ \n]")
LETTERS = re.compile(f"[{LETTER}]+")
PIECES = 4096, 1, 8192
CACHE_WORDS = 250_000
#: Texts of plain Latin characters without an apostrophe or control string; in them a mark after a letter is a part by itself.
PLAIN = re.compile("[\t\n -&(-;=-~\xa1-įı-ɏ]*")
MARKS = re.compile(f"(?<=[{LETTER}])([.,])(?=[ \n])")
ODD_MARKS = re.compile("[^a-z\xdf-\xf6\xf8-\xff][.,][ \n]")
LETTERS = re.compile(f"[{LETTER}]+")
#: The byte-level alphabet: bytes that are printable in Latin-1 stand for themselves, the others for characters from 256 on.
ALPHABET = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class WordIds(dict):
    """Word without white space to its ids as little-endian unsigned 32-bit bytes.

    A word not met before is encoded by the tokenizer, one of lower-case letters only (one part, nothing to normalise)
    by its model alone. The cache is of bounded size.
    """

    def __init__(self, tokenizer):
        super().__init__({"": b""})
        self.tokenizer, self.model = tokenizer, tokenizer.model

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isalpha() and word.islower():
            ids = [t.id for t in self.model.tokenize(word)]
        elif LETTERS.fullmatch(word) and word == word.lower():
            ids = [t.id for t in self.model.tokenize(spelled(word))]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        if len(self) >= CACHE_WORDS:
            self.clear()
            self[""] = b""
        self[word] = found = array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()
        return found

    def ids(self, text: str) -> bytes:
        """The tokenizer's ids of a whole text; it drops white space, so words between spaces and line ends are independent."""
        if PLAIN.fullmatch(text):
            text = text.lower()
            text = MARKS.sub(r" \1", text) if ODD_MARKS.search(text) else text.replace("\n", " ").replace(". ", " . ").replace(", ", " , ")
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of positions in lengths (each from 1 to capacity), by best-two-fit."""
    order = np.argsort(-lengths, kind="stable")
    stock: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in order[::-1].tolist():
        stock[int(lengths[i])].append(i)
    left = np.array([len(s) for s in stock])
    sizes = np.arange(capacity + 1)
    fits = np.maximum.accumulate(np.where(left > 0, sizes, 0))  # the largest length at hand up to each size; 0: none

    def take(size: int) -> int:
        left[size] -= 1
        if not left[size]:
            above = np.flatnonzero(left[size + 1 :])
            fits[size : size + 1 + above[0] if len(above) else capacity + 1] = fits[size - 1]
        return stock[size].pop()

    def put(size: int, i: int) -> None:
        stock[size].append(i)
        left[size] += 1
        if left[size] == 1:
            fits[size:] = np.maximum(fits[size:], size)

    bins = []
    while fits[capacity]:
        held, gap = [], capacity
        while size := int(fits[gap]):
            held.append((size, take(size)))
            gap -= size
        while gap and len(held) > 1:
            small, i = held[-1]
            room = gap + small
            first = sizes[1:room]
            second = fits[room - first]
            twins = (second == first) & (left[first] < 2)
            second = np.where(twins, fits[first - 1], second)
            sums = np.where((left[first] > 0) & (second > 0), first + second, 0)
            best = int(np.argmax(sums)) if len(sums) else -1
            if best < 0 or sums[best] <= small:
                break
            pair = sorted((int(first[best]), int(second[best])), reverse=True)
            held.pop()
            held += [(size, take(size)) for size in pair]
            put(small, i)
            held.sort(key=lambda x: -x[0])
            gap = room - sum(pair)
        bins.append([i for _, i in held])
    return bins


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    groups = max(1, -(-bound_batches(docs).count() // group_pieces))
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(load(tokenizer_path))
        task = TaskContext.get()
        dealt = zlib.crc32(str(task.partitionId() if task else 0).encode())
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = words.ids(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    dealt += 1
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), dealt % groups))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), *[pa.int64()] * 4), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "pack_group"])

    def packed(group: int, rows: pa.Table) -> list[pa.RecordBatch]:
        length = rows["length"].to_numpy()
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for k, members in enumerate(pack(length, capacity)):
            sequence[members] = (group << 32) + k
            offset[members] = np.cumsum(length[members]) - length[members]
        return rows.drop_columns(["pack_group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).combine_chunks().to_batches()

    def pack_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            group = batch.column("pack_group").to_numpy()
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else []
            for a, b in zip(starts, [*starts[1:], len(group)], strict=True):
                if held and now != group[a]:
                    yield from packed(now, pa.Table.from_batches(held))
                    held = []
                now = int(group[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from packed(now, pa.Table.from_batches(held))

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    pieces = texts.mapInArrow(cut, f"{PIECES}, pack_group bigint")
    return pieces.repartition("pack_group").sortWithinPartitions("pack_group").mapInArrow(pack_groups, f"{PIECES}, sequence_id bigint, offset bigint")
