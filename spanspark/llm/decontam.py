"""Benchmark decontamination: rare n-gram seeds lead to passages, local alignment scores them.

Texts are compared as lower-case runs of letters and digits. An item's seeds are triples of its words: three in a row,
or with one word left out between them, so that a foreign, missing or changed word doesn't part them; on the text's side
the same triples are looked up. Every triple of an item is a seed, however many documents hold it, so no copy loses its
seeds by being common; a triple is rare among the texts, and a bit table of all seeds passes over the others. Hits that
agree on the place form a passage, and a Smith-Waterman alignment of item and passage scores copies with changed, added
or missing words. A passage that lacks half of the item's words can't reach the score and isn't aligned.

What can be missed: an alignment without a seed consists of words one by one between foreign words, or of pairs with two
errors on each side, so its score is at most (L + 2) / 2L of the best possible for an item of L words: every copy that
scores more than 1 / L above the least score of 0.5 has a seed.

The seeds of at most SLICE_BYTES of benchmark text are broadcast; a larger benchmark is taken in slices, a pass each,
so that no worker holds more. No text is shuffled.

Defined results: null text is the empty text and never contaminated; items without words are never found; items shorter
than a seed are found as whole runs of words; of equal scores in a text the first place counts; repeated rows are judged
each on its own; very long texts are taken whole; an empty table or benchmark gives no rows; other columns are ignored,
and pass through ``uncontaminated``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanspark.llm.common import bound_batches, checkpointed, shared, text_of, unshared

LEAST_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Places of a seed's words; items of one or two words have whole runs instead.
TRIPLES, RUNS = ((0, 1, 2), (0, 1, 3), (0, 2, 3)), {1: ((0,),), 2: ((0, 1),)}
WIDEST = 4
#: Bytes of benchmark text whose seeds a worker holds at a time, and words of texts that are looked up at a time.
SLICE_BYTES, CHUNK_WORDS = 8 << 20, 100_000
#: Hits times the items of their seeds that are sorted at a time.
SORTED_HITS = 2_000_000
SPREAD = np.uint64(0x9E3779B97F4A7C15)  # fixed value: an odd multiplier
TERMS = re.compile(r"[^\W_]+")
MATCHES = "doc_id bigint, item_id bigint, score double, first_word bigint, last_word bigint, n_seeds bigint"


def terms(text: str) -> list[str]:
    return TERMS.findall(text.lower())


def coded(words: np.ndarray, places: tuple[int, ...], base: int) -> np.ndarray:
    """A number for the words at these places after each position (0: one of them is unknown)."""
    n = max(0, len(words) - places[-1])
    code, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in places:
        part = words[k : k + n]
        code = code * np.uint64(base) + part.astype(np.uint64)
        known &= part > 0
    return np.where(known, code * np.uint64(4) + np.uint64(len(places)), np.uint64(0))


def bit_of(codes: np.ndarray, bits: int) -> np.ndarray:
    return (codes * SPREAD) >> np.uint64(64 - bits)


@dataclass
class Seeds:
    """A slice of the benchmark: each item's words as numbers of a vocabulary, and where its seeds stand.

    Seed k, of the sorted codes, stands in items item[first[k] : first[k + 1]] at words at[...].
    """

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    patterns: tuple[tuple[int, ...], ...]
    codes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    at: np.ndarray
    bits: int
    table: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Seeds | None:
        """The seeds of (item_id, text) rows; None if no item has words."""
        texts = [(i, w) for i, t in rows if i is not None and (w := terms(t or ""))]
        if not texts:
            return None
        vocabulary: dict[str, int] = {}
        words = [np.array([vocabulary.setdefault(x, len(vocabulary) + 1) for x in w], np.int64) for _, w in texts]
        base = len(vocabulary) + 2
        parts = [(n, c) for n, w in enumerate(words) for places in RUNS.get(len(w), TRIPLES) if len(c := coded(w, places, base))]
        whole = np.concatenate([c for _, c in parts])
        item = np.repeat(np.array([n for n, _ in parts], np.int32), [len(c) for _, c in parts])
        at = np.concatenate([np.arange(len(c), dtype=np.int32) for _, c in parts])
        order = np.argsort(whole, kind="stable")
        codes, first = np.unique(whole[order], return_index=True)
        bits = min(25, max(16, int(len(codes)).bit_length() + 5))
        table = np.zeros(1 << bits, bool)
        table[bit_of(codes, bits)] = True
        patterns = tuple(p for n in sorted({len(w) for w in words} & {1, 2}) for p in RUNS[n]) + (TRIPLES if any(len(w) > 2 for w in words) else ())
        return cls([i for i, _ in texts], words, vocabulary, patterns, codes, np.append(first, len(whole)), item[order], at[order], bits, table)

    def numbered(self, text: str) -> np.ndarray:
        found = terms(text)
        get = self.vocabulary.get
        return np.fromiter((get(x, 0) for x in found), np.int64, len(found))

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in words at which a seed begins, and which."""
        at, which = [], []
        base = len(self.vocabulary) + 2
        for places in self.patterns:
            own = coded(words, places, base)
            place = np.flatnonzero(self.table[bit_of(own, self.bits)])
            k = np.minimum(np.searchsorted(self.codes, own[place]), len(self.codes) - 1)
            hit = self.codes[k] == own[place]
            at.append(place[hit])
            which.append(k[hit])
        return np.concatenate(at), np.concatenate(which)


def slices(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in parts of about SLICE_BYTES."""
    own = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), text_of().alias("text"))
    size = own.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // SLICE_BYTES))
    for k in range(n):
        yield [(r.item_id, r.text) for r in own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).sort("item_id", "text").collect()]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and the place after its end in the passage."""
    above = np.zeros(len(passage) + 1, np.int64)
    slope = GAP * np.arange(len(passage) + 1)
    best, end = 0, 0
    for word in item:
        step = np.zeros_like(above)
        step[1:] = np.maximum(above[:-1] + np.where(passage == word, MATCH, MISMATCH), above[1:] + GAP)
        above = np.maximum(np.maximum.accumulate(np.maximum(step, 0) - slope) + slope, 0)
        if (top := int(above.max())) > best:
            best, end = top, int(above.argmax())
    return best, end


@dataclass
class Passage:
    """Where the seeds of items[item] agree in text doc of a chunk; lo and hi bound its words there."""

    doc: int
    item: int
    lo: int
    hi: int
    n_seeds: int


def passages(words: list[np.ndarray], seeds: Seeds) -> Iterator[Passage]:
    """Passages of a chunk of texts, by text and item."""
    sizes = np.array([len(w) for w in words])
    starts = np.cumsum(sizes + WIDEST) - sizes - WIDEST
    whole = np.zeros(int(sizes.sum()) + WIDEST * len(words), np.int64)
    for s, w in zip(starts, words, strict=True):
        whole[s : s + len(w)] = w
    at, which = seeds.hits(whole)
    if not len(at):
        return
    uses = seeds.first[which + 1] - seeds.first[which]
    parts = max(1, -(-int(uses.sum()) // SORTED_HITS))
    for part in range(parts):
        yield from grouped(seeds, *placed_hits(seeds, starts, at, which, uses, part, parts))


def placed_hits(seeds: Seeds, starts: np.ndarray, at: np.ndarray, which: np.ndarray, uses: np.ndarray, part: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each use of a hit seed by an item of this part: the text, the item, and where in the text the item would begin."""
    found = []
    for k in np.array_split(np.arange(len(at)), parts):
        use = np.repeat(seeds.first[which[k]] - np.cumsum(uses[k]) + uses[k], uses[k]) + np.arange(int(uses[k].sum()))
        place = np.repeat(at[k], uses[k])
        if parts > 1:
            own = seeds.item[use] % parts == part
            use, place = use[own], place[own]
        doc = np.searchsorted(starts, place, side="right") - 1
        found.append((doc, seeds.item[use], place - starts[doc] - seeds.at[use]))
    doc, item, begin = (np.concatenate(x) for x in zip(*found, strict=True))
    return doc, item, begin


def grouped(seeds: Seeds, doc: np.ndarray, item: np.ndarray, begin: np.ndarray) -> Iterator[Passage]:
    """Hits of an item in a text that agree on its place, as passages."""
    if not len(doc):
        return
    order = np.lexsort((begin, item, doc))
    doc, item, begin = doc[order], item[order], begin[order]
    length = np.array([len(w) for w in seeds.words])[item]
    slack = 4 + length // 3
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > slack[1:])
    one = np.flatnonzero(new)
    end = np.append(one[1:], len(doc)) - 1
    lo, hi = np.maximum(0, begin[one] - slack[one]), np.maximum(0, begin[end]) + length[one] + slack[one]
    for row in zip(doc[one].tolist(), item[one].tolist(), lo.tolist(), hi.tolist(), (end - one + 1).tolist(), strict=True):
        yield Passage(*row)


def chunk_matches(texts: list[str], seeds: Seeds, least: float = LEAST_SCORE) -> Iterator[tuple[int, int, float, int, int, int]]:
    """(text, item_id, score, first word, last word, seeds) of each item found in a text, at its best place."""
    words = [seeds.numbered(t) for t in texts]
    counts: dict[int, Counter] = {}
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for p in passages(words, seeds):
        own = seeds.words[p.item]
        needed = least * MATCH * len(own)
        passage = words[p.doc][p.lo : p.hi]
        held = counts.get(p.item) or counts.setdefault(p.item, Counter(own.tolist()))
        inside = [w for w in passage.tolist() if w in held]
        if len(inside) * MATCH < needed or sum((Counter(inside) & held).values()) * MATCH < needed:
            continue
        score, end = align(own, passage)
        if score >= needed and ((p.doc, p.item) not in best or score > best[p.doc, p.item][0]):
            best[p.doc, p.item] = (score, p.lo, end, p.n_seeds)
    for (doc, item), (score, lo, end, n) in best.items():
        own = seeds.words[item]
        back = align(own[::-1], words[doc][lo : lo + end][::-1])[1]
        yield doc, seeds.ids[item], score / (MATCH * len(own)), lo + end - back, lo + end - 1, n


def chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Texts in chunks of about CHUNK_WORDS words, each with the place of its first text."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t) // 6 + 1
        if size >= CHUNK_WORDS:
            yield start, texts[start : k + 1]
            start, size = k + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def sent_seeds(docs: DataFrame, benchmark: DataFrame) -> Iterator:
    """Broadcast seeds of each slice of the benchmark."""
    sc = bound_batches(docs).sparkSession.sparkContext
    for rows in slices(benchmark):
        if seeds := Seeds.of(rows):
            yield shared(sc, seeds)


def find(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """doc_id, item_id, score (part of the best possible), first_word, last_word, n_seeds for each contamination."""
    names = [x.split()[0] for x in MATCHES.split(", ")]
    types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("whole"))

    def by_slice(sent):
        def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = unshared(sent)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[start + d], *m) for start, texts in chunks(batch.column(1).to_pylist()) for d, *m in chunk_matches(texts, seeds, least)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        return own.mapInArrow(matches, MATCHES)

    found = docs.sparkSession.createDataFrame([], MATCHES) if not (parts := [by_slice(b) for b in sent_seeds(docs, benchmark)]) else parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs, all columns as they are, whose text holds no benchmark item."""
    at, own = docs.columns.index(text), docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # any names pass

    def without(rows: DataFrame, sent) -> DataFrame:
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = unshared(sent)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for start, texts in chunks([t or "" for t in batch.column(at).to_pylist()]):
                    keep[[start + d for d, *_ in chunk_matches(texts, seeds, least)]] = False
                if keep.any():
                    yield batch.filter(pa.array(keep))

        return rows.mapInArrow(clean, own.schema)

    kept = None
    for sent in sent_seeds(docs, benchmark):
        kept = without(own if kept is None else checkpointed(kept), sent)
    return docs if kept is None else kept.toDF(*docs.columns)
