"""Cost-balanced packing of token streams into fixed sequences, in one pass without a shuffle.

A document is its token ids and one closing id. Documents longer than a sequence give
full sequences from their start; what is left of each (less than a sequence) is
packed. Within a block of ``block`` rows of a partition the sequences needed are
opened at once, and the remainders, in descending length, each go to the sequence of
lowest estimated cost (``linear`` * tokens + ``quadratic`` * tokens**2 per piece, as
attention is causal within a document) that has room left; a remainder that fits
nowhere whole is cut over the lowest-cost ones. The last, partly filled sequence is
carried into the next block; what is left when a partition ends is stored as sequences
whose lengths are powers of two, so no padding is needed anywhere.

Null text counts as empty: its document is the closing id alone. Repeated rows are
documents of their own. Texts may be of any length and kind, runs of millions of white-space
characters included. Descending order holds inside a block; a cut is made only where a block's last
pieces fit nowhere whole. Sequence ids are unique and depend only on the partition and
place of a document, so a task that runs again gives the same rows. Extra columns are
ignored.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    capacity: int = 2048
    vocabulary: str = "byte_bpe_50k.tiktoken"  #: same ids as byte_bpe_50k.json, several times faster to apply
    close: int = 1  #: the id after each document
    linear: float = 1.0
    quadratic: float = 1.0 / 2048
    block: int = 4096  #: remainders held and packed together


_ENCODERS: dict = {}


def encoder(vocabulary: str):  # noqa: ANN201
    """A worker's tokenizer, made once, with the special tokens of the JSON file of the same name."""
    if vocabulary not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(public_tokenizers.path(vocabulary.rsplit(".", 1)[0] + ".json"), encoding="utf-8") as file:
            special = {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}
        _ENCODERS[vocabulary] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[vocabulary]


#: White space as the tokenizer's pattern has it: Unicode's, which is not Python's own class.
WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_WHITE = re.compile(WHITE + "{100000,}")


def encode_text(encode, text: str) -> np.ndarray:  # noqa: ANN001
    """The ids of encode(text, add_special_tokens=False) of the JSON file: a special token's string in the text is its one id.

    The pattern engine keeps a place to go back to for each character of white space and gives
    up at about a million. Such runs are taken out first: the pattern makes one piece of a run (without its
    last character if a word follows), so the texts around it and the run itself, in one piece, give the same ids.
    """
    parts, at = [], 0
    for run in LONG_WHITE.finditer(text) if len(text) >= 100_000 else ():
        begin, end = run.span()
        if end < len(text) and not text.startswith(tuple(encode.special_tokens_set), end):
            end -= 1  # it goes with what follows
        parts += [encode.encode_to_numpy(text[at:begin], allowed_special="all", disallowed_special=()), np.array(encode._encode_single_piece(text[begin:end]), dtype=np.uint32)]
        at = end
    parts.append(encode.encode_to_numpy(text[at:], allowed_special="all", disallowed_special=()))
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


class Packer:
    """Packs remainders block by block; ``out`` gets (doc, start, length, crc, sequence, offset)."""

    def __init__(self, p: Params, first_id: int) -> None:
        self.p, self.next_id, self.out = p, first_id, []
        self.held: list[tuple[int, int, np.ndarray]] = []
        self.left: list[tuple[int, int, np.ndarray]] = []  # pieces of the partly filled sequence

    def emit(self, doc: int, start: int, ids: np.ndarray, sequence: int, offset: int) -> None:
        self.out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), sequence, offset))

    def sequence(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def add(self, doc: int, ids: np.ndarray) -> None:
        c = self.p.capacity
        full = len(ids) // c * c
        for start in range(0, full, c):
            self.emit(doc, start, ids[start : start + c], self.sequence(), 0)
        if full < len(ids):
            self.held.append((doc, full, ids[full:]))
            if len(self.held) >= self.p.block:
                self.pack()

    def cost(self, n: int) -> float:
        return self.p.linear * n + self.p.quadratic * n * n

    def pack(self) -> None:
        """All held pieces into whole sequences; what does not fill one is kept for the next block."""
        c = self.p.capacity
        pieces = sorted(self.left + self.held, key=lambda x: -len(x[2]))
        bins = sum(len(x[2]) for x in pieces) // c
        room, costs = np.full(bins, c), np.zeros(bins)
        filled: list[list] = [[] for _ in range(bins)]
        spare = []
        for piece in pieces:
            n = len(piece[2])
            goal = int(np.where(room >= n, costs, np.inf).argmin()) if bins else None
            if goal is None or room[goal] < n:
                spare.append(piece)
                continue
            filled[goal].append(piece)
            room[goal] -= n
            costs[goal] += self.cost(n)
        heap = [(costs[b], b) for b in range(bins) if room[b]]
        heapq.heapify(heap)
        self.left = []
        spare = spare[::-1]
        while spare:  # cut over the sequences with room left, lowest cost first
            doc, start, ids = spare.pop()
            while len(ids) and heap:
                _, goal = heapq.heappop(heap)
                take = min(int(room[goal]), len(ids))
                filled[goal].append((doc, start, ids[:take]))
                room[goal] -= take
                costs[goal] += self.cost(take)
                start, ids = start + take, ids[take:]
                if room[goal]:
                    heapq.heappush(heap, (costs[goal], goal))
            if len(ids):
                self.left.append((doc, start, ids))
        for b in range(bins):
            sequence, offset = self.sequence(), 0
            for doc, start, ids in filled[b]:
                self.emit(doc, start, ids, sequence, offset)
                offset += len(ids)
        self.held = []

    def close(self) -> None:
        """The rest, as sequences of power-of-two lengths."""
        self.pack()
        rest = sum(len(x[2]) for x in self.left)
        pieces = self.left[::-1]
        for bit in reversed(range(rest.bit_length())):
            size = 1 << bit
            if not rest & size:
                continue
            sequence, offset = self.sequence(), 0
            while offset < size:
                doc, start, ids = pieces.pop()
                take = min(size - offset, len(ids))
                self.emit(doc, start, ids[:take], sequence, offset)
                offset += take
                if take < len(ids):
                    pieces.append((doc, start + take, ids[take:]))
        self.left = []


def pack_documents(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Pieces of all rows of ``docs(doc_id, text)``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(p.vocabulary)
        part = TaskContext.get().partitionId()
        packer = Packer(p, part << 40)
        keys_at: dict[int, tuple] = {}  # (doc_id, tokens) of rows not yet wholly given out
        done = 0

        def given() -> pa.RecordBatch:
            rows, packer.out = packer.out, []
            doc, start, length, crc, sequence, offset = (list(x) for x in zip(*rows, strict=True)) if rows else [[]] * 6
            own = [keys_at[x] for x in doc]
            columns = [[x[0] for x in own], start, length, crc, [x[1] for x in own], sequence, offset]
            return pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                tokens = np.append(encode_text(encode, text), np.uint32(p.close)).astype("<u4", copy=False)
                keys_at[done] = (ids[i].as_py(), len(tokens))
                packer.add(done, tokens)
                done += 1
                if len(packer.out) >= 8 * p.block:
                    yield given()
                    open_ = {x[0] for x in packer.held} | {x[0] for x in packer.left}
                    keys_at = {k: keys_at[k] for k in open_}
        packer.close()
        yield given()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
