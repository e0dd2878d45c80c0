"""Cost-balanced packing of tokenised documents into fixed-length sequences.

Each document's ids (then one end id) are cut into pieces of at most ``seq_len``. The pieces of a buffer
of consecutive documents go, longest first, to the sequence of the lowest estimated attention cost
(``linear * n + quadratic * n**2`` summed over its pieces) that still has room. The number of sequences
is what the tokens need when every sequence is full; a piece that fits nowhere is cut to fill the gaps
that are left, so full sequences carry no padding. The tokens beyond the last full sequence are carried
to the next buffer; at the end of a partition they fill sequences whose lengths are powers of two, which
need no padding either.

Everything happens inside the task that reads the documents: no shuffle, memory bounded by
``buffer_tokens``, and a lost task is simply read again. Sequence numbers are unique: the task's
partition number in the high bits, a counter in the low ones.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SEQ_LEN = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k"
BUFFER_TOKENS = 1_000_000
LONG_SPACE = re.compile(r"\s{20000}")  # the pattern of the ranks file steps back through a run of white space, on a stack that ends at some 500,000
LINEAR, QUADRATIC = 1.0, 1.0 / 1024  # cost of a token itself and of a pair of tokens that attend to each other

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SCHEMA_IDS = SCHEMA + ", ids array<int>"


def encoder(name: str = VOCABULARY):
    """text -> ids as the JSON vocabulary gives them. The ranks file of the same vocabulary gives the same ids several times faster;
    texts that spell a special token, which that file doesn't know, or hold a very long run of white space, which it can't cut, go through the JSON one."""
    import base64

    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(P.path(f"{name}.json"))
    special = [t.content for t in exact.get_added_tokens_decoder().values()]
    with open(P.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special) or LONG_SPACE.search(text):
            return np.array(exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.array(fast.encode_ordinary(text), dtype=np.uint32)

    return encode


def place(sizes: np.ndarray, rooms: list[int], linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int]]:
    """(piece, its start, its length, sequence) that fill the sequences of ``rooms`` tokens with pieces of ``sizes`` tokens, whose sums agree.

    Longest first, each to the cheapest sequence with room for it; what fits nowhere is cut into the gaps, cheapest sequence first.
    """
    left = np.array(rooms, dtype=np.int64)
    cost = np.zeros(len(rooms))
    out: list[tuple[int, int, int, int]] = []
    rest: list[int] = []
    for i in np.argsort(-sizes, kind="stable"):
        n = int(sizes[i])
        s = int(np.argmin(np.where(left >= n, cost, np.inf)))
        if left[s] < n:
            rest.append(int(i))
            continue
        out.append((int(i), 0, n, s))
        left[s] -= n
        cost[s] += linear * n + quadratic * n * n
    gaps = [(cost[s], int(s)) for s in np.flatnonzero(left)]
    heapq.heapify(gaps)
    for i in rest:
        at, n = 0, int(sizes[i])
        while at < n:
            c, s = heapq.heappop(gaps)
            take = int(min(n - at, left[s]))
            out.append((i, at, take, s))
            left[s] -= take
            at += take
            if left[s]:
                heapq.heappush(gaps, (c + linear * take + quadratic * take * take, s))
    return out


def _powers_of_two(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class _Packer:
    """Buffers pieces (doc_id, start, doc_tokens, ids) and packs them when the buffer is full."""

    def __init__(self, seq_len: int, base: int):
        self.seq_len, self.next, self.pieces, self.tokens = seq_len, base, [], 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        for at in range(0, len(ids), self.seq_len):
            self.pieces.append((doc_id, at, len(ids), ids[at : at + self.seq_len]))
        self.tokens += len(ids)

    def pack(self, last: bool) -> list[tuple]:
        full = self.tokens // self.seq_len
        rest = self.tokens - full * self.seq_len
        carried: list[tuple] = []
        if rest and not last:  # the last documents wait for the next buffer
            while rest:
                doc_id, at, n, ids = self.pieces.pop()
                take = min(rest, len(ids))
                if take < len(ids):
                    self.pieces.append((doc_id, at, n, ids[: len(ids) - take]))
                carried.append((doc_id, at + len(ids) - take, n, ids[len(ids) - take :]))
                rest -= take
        rooms = [self.seq_len] * full + (_powers_of_two(rest) if last else [])
        rows = []
        sizes = np.array([len(p[3]) for p in self.pieces], dtype=np.int64)
        used = [0] * len(rooms)
        for i, at, n, s in place(sizes, rooms) if len(sizes) else []:
            doc_id, start, total, ids = self.pieces[i]
            part = ids[at : at + n]
            rows.append((doc_id, start + at, n, zlib.crc32(part.astype("<u4").tobytes()), total, self.next + s, used[s], part))
            used[s] += n
        self.next += len(rooms)
        self.pieces, self.tokens = carried[::-1], sum(len(p[3]) for p in carried)
        return rows


def _packed(batches: Iterator[pa.RecordBatch], seq_len: int, with_ids: bool, buffer_tokens: int) -> Iterator[pa.RecordBatch]:
    encode = encoder()
    packer = _Packer(seq_len, TaskContext.get().partitionId() << 32)

    def rows(last: bool) -> pa.RecordBatch:
        got = packer.pack(last)
        cols = [pa.array([r[k] for r in got], type=pa.int64()) for k in range(7)]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            cols.append(pa.array([r[7].astype(np.int32) for r in got], type=pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names)

    end = np.array([END_ID], dtype=np.uint32)
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            packer.add(doc_id, np.concatenate([encode(text.as_py() or ""), end]))
            if packer.tokens >= buffer_tokens:
                yield rows(False)
    yield rows(True)


def pack(docs: DataFrame, with_ids: bool = False, seq_len: int = SEQ_LEN, buffer_tokens: int = BUFFER_TOKENS) -> DataFrame:
    """A row for each piece of each document of ``docs`` (doc_id, text): where it starts in its document, its length, the CRC-32 of its
    ids, the document's tokens with the end id, its sequence and its offset there; ``with_ids`` adds the ids themselves.

    A null or empty text is the end id alone; a null doc_id stays null; repeated rows are packed as often as they occur; an empty table
    gives no rows; other columns are ignored. Texts of any length are cut, never shortened.
    """
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(
        lambda batches: _packed(batches, seq_len, with_ids, buffer_tokens), SCHEMA_IDS if with_ids else SCHEMA
    )
