"""Token counts of whole texts under a public byte-level tokenizer.

A map over Arrow batches, without a shuffle; ids never leave Arrow, lengths alone come back. A byte-level BPE cuts a text
into words before it merges bytes, and no word of it spans a printable character and the blank after it. So a text may be
cut there and its pieces encoded apart: their counts add up to the whole text's. Long texts are first cut into segments of
bounded size at such boundaries, segments into pieces; pieces not yet counted by the worker go to the library in batches
of about equal bytes, the others are looked up.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
SEGMENT_CHARS = 1 << 20  # a longer text is cut into segments of about this size
BATCH_BYTES = 1 << 18  # what one call of the library encodes
KNOWN_CHARS = 1 << 24  # pieces whose counts a worker remembers, in characters

# The cut lies between the two characters: \w and ! to ~ are never white space, a blank or newline after them starts a word.
_SAFE = re.compile(r"(?<=[\w!-~])(?=[ \n])")
_UNSAFE = re.compile(r"[^\w!-~][ \n]")


def segments(text: str, size: int = SEGMENT_CHARS) -> Iterator[str]:
    """text in runs of at least size characters, each up to the next safe boundary (the last run may be shorter)."""
    at = 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def pieces(segment: str) -> list[str]:
    """The segment cut at every safe boundary; joined they are the segment."""
    if _UNSAFE.search(segment) or segment[:1] in (" ", "\n"):
        return _SAFE.split(segment)
    first, *rest = segment.replace("\n", " \n").split(" ")
    return [first, *(p if p[:1] == "\n" else " " + p for p in rest)]


def byte_batches(texts: list[str], size: int = BATCH_BYTES) -> Iterator[list[str]]:
    """texts, shortest first, in lists of at most size bytes each (a longer text is a list of its own)."""
    held, n = [], 0
    for b, t in sorted((len(t.encode()), t) for t in texts):
        if held and n + b > size:
            yield held
            held, n = [], 0
        held.append(t)
        n += b
    if held:
        yield held


@lru_cache(maxsize=4)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Counts(dict):
    """piece -> number of tokens, for the pieces met so far; emptied when their characters exceed the bound."""

    def __init__(self, path: str, bound: int = KNOWN_CHARS):
        super().__init__()
        library = _library(path)
        self.encode, self.bound, self.chars = getattr(library, "encode_batch_fast", library.encode_batch), bound, 0

    def learn(self, unseen: set[str]) -> None:
        for batch in byte_batches(list(unseen)):
            for piece, e in zip(batch, self.encode(batch, add_special_tokens=False)):
                self[piece] = len(e)
                self.chars += len(piece)

    def of(self, text: str) -> int:
        total = 0
        for segment in segments(text):
            cut = pieces(segment)
            if unseen := {p for p in set(cut) if p not in self}:
                if self.chars > self.bound:
                    self.clear()
                    self.chars, unseen = 0, set(cut)
                self.learn(unseen)
            total += sum(map(self.__getitem__, cut))
        return total


def token_counts(docs: DataFrame, tokenizer: str = VOCABULARY, limit: int = 512) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_bytes, n_tokens, over_limit: one row for each row of docs.

    tokenizer is the path of a byte-level BPE file that every executor can open; special strings in a text count as the
    library counts them by default, nothing is added, cut off or padded. A null or empty text has 0 bytes and 0 tokens.
    doc_id is passed on as it is, null and repeated ones too; other columns of docs are not looked at. An empty table gives
    an empty result. A stretch without any safe boundary is encoded as one piece, however long it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Counts(tokenizer)
        for b in batches:
            text = b.column(1)
            n = pa.array([known.of(t.as_py()) if t.is_valid else 0 for t in text], pa.int64())
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
