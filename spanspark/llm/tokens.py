"""Token counts: a broadcast table of frequent pre-tokens first, the tokenizer behind a worker's cache for the rest.

The table holds the pre-tokens that the tokenizer's vocabulary itself lists: a vocabulary of merges is the list of the
most frequent strings, so no pass over the texts, no sample and no shuffle of pre-tokens is needed, and its size is
bound by the tokenizer's file. The table never decides a result: a pre-token outside it is encoded by the tokenizer's
model and kept in the worker's cache of bounded size.

Defined results: null text is the empty text (0 tokens); a text with a special string or with characters for which the
splitting pattern could depend on a library's Unicode version is encoded whole by the tokenizer, as is every text under
a tokenizer that isn't of this byte-level kind; repeated rows and null ids give one row each; very long texts are taken
whole; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanspark.llm.common import bound_batches, text_of

#: Letters and digits up to U+024F, where every Unicode version agrees; texts with other characters take the slow way.
LETTER, DIGIT = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"
SPLIT = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^\s{LETTER}{DIGIT}]+|\s+(?!\S)|\s+")
SETTLED = re.compile("[\x00-\x1b\x20-\x84\x86-ɏ]*")
TABLE_SIZE, CACHE_ENTRIES, LONGEST_KEPT = 65_536, 200_000, 64
#: The byte-level alphabet: bytes that are printable in Latin-1 stand for themselves, the others for characters from 256 on.
ALPHABET = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
LETTERS_OF = str.maketrans({chr(v): chr(k) for k, v in ALPHABET.items()})


def spelled(piece: str) -> str:
    """A piece of text in the byte-level alphabet."""
    return piece.encode().decode("latin-1").translate(ALPHABET)


class Lengths(dict):
    """Pre-token to number of tokens; misses are encoded by the tokenizer's model and kept while there is room."""

    def __init__(self, tokenizer, known=()):
        super().__init__(known)
        self.tokenizer, self.model, self.room = tokenizer, tokenizer.model, len(self) + CACHE_ENTRIES
        self.known = dict(known)

    def __missing__(self, piece: str) -> int:
        n = len(self.model.tokenize(spelled(piece)))
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= self.room:
                self.clear()
                self.update(self.known)
            self[piece] = n
        return n


def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def specials_of(tokenizer) -> list[str]:
    return [str(t.content) for t in tokenizer.get_added_tokens_decoder().values()]


def splits_alike(tokenizer) -> bool:
    """Is this a byte-level tokenizer that changes no text, splits it by SPLIT's pattern, and adds nothing to it?"""
    made = json.loads(tokenizer.to_str())
    splitter = made.get("pre_tokenizer") or {}
    return made.get("normalizer") is None and splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space")


def count_text(text: str, lengths: Lengths, specials: list[str], alike: bool = True) -> int:
    """Tokens of one text, exactly as the tokenizer counts them."""
    if not alike or any(s in text for s in specials) or not SETTLED.fullmatch(text):
        return len(lengths.tokenizer.encode(text, add_special_tokens=False).ids)
    return sum(map(lengths.__getitem__, SPLIT.findall(text)))


def vocabulary_pretokens(tokenizer, table_size: int = TABLE_SIZE) -> list[str]:
    """Vocabulary entries that are pre-tokens as they stand, those merged first (the most frequent) first."""
    found = []
    for entry, _ in sorted(tokenizer.get_vocab(with_added_tokens=False).items(), key=lambda x: x[1]):
        piece = entry.translate(LETTERS_OF)
        try:
            piece = piece.encode("latin-1").decode()
        except UnicodeError:
            continue
        if len(piece) <= LONGEST_KEPT and SETTLED.fullmatch(piece) and SPLIT.fullmatch(piece):
            found.append(piece)
    return found[:table_size]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, table_size: int = TABLE_SIZE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs(doc_id, text)."""
    sc = bound_batches(docs).sparkSession.sparkContext
    tokenizer = load(tokenizer_path)
    alike = splits_alike(tokenizer)
    lengths = Lengths(tokenizer)
    table = sc.broadcast([(x, lengths[x]) for x in vocabulary_pretokens(tokenizer, table_size)] if alike else [])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(tokenizer_path)
        lengths, specials = Lengths(own, table.value), specials_of(own)
        for batch in batches:
            n = [count_text(t, lengths, specials, alike) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.octet_length(text_of()).cast("bigint").alias("n_bytes"), text_of().alias("text"))
    return texts.mapInArrow(counts, "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
