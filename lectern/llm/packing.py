"""Order-preserving packing of documents into training sequences by dynamic programming.

A shard's documents, each followed by an end id, form one line of tokens. Cuts may fall anywhere, at a price: none at
the end of a document, some at the end of a sentence, more inside one. The best cuts minimise padding plus prices:

    cost[j] = price[j] + min over i within `size` of (cost[i] + size - (at[j] - at[i]))

The minimum slides over `size` tokens, so a monotone queue of cost[i] + at[i] gives every transition in constant time.
Long stretches without a sentence's end offer a cut every `stride` tokens. What is left at the end of a shard is cut
into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import partition_id, pieces, relax, table
from lectern.llm.tokens import WordBpe

SIZE, END_ID = 2048, 1
#: Prices of cuts, in tokens of padding: at a sentence's end, elsewhere; and how often "elsewhere" is offered.
SENTENCE, INSIDE, STRIDE = 4.0, 24.0, 64
#: Distinct pieces that a worker keeps in a job that does nothing else: fewer are met anew in every task.
KEPT = 1_500_000
#: Sequences that are laid out at a time.
ROUND = 128


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def cuts(at: np.ndarray, price: np.ndarray, size: int = SIZE) -> list[int]:
    """Best cut positions from 0 to at[-1], which is the last. at: ascending candidates, no two over size apart."""
    n = len(at) + 1
    line = [0, *at.tolist()]
    prices = [0.0, *price.tolist()]
    cost, back = [0.0] * n, [0] * n
    queue = deque([(0.0, 0)])  # cost + position, index: ascending, so the first is the least
    for j in range(1, n):
        here = line[j]
        while line[queue[0][1]] < here - size:
            queue.popleft()
        least, i = queue[0]
        cost[j] = now = least + prices[j] + size - here
        back[j] = i
        now += here
        while queue and queue[-1][0] >= now:
            queue.pop()
        queue.append((now, j))
    out, j = [], n - 1
    while j:
        out.append(line[j])
        j = back[j]
    return out[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, closes: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut may fall (after that many tokens), and their prices."""
    flag = np.full(len(ids) + 1, np.inf)
    flag[np.arange(stride, len(ids) + 1, stride)] = INSIDE
    flag[np.flatnonzero(closes[ids]) + 1] = SENTENCE
    flag[doc_ends] = 0.0
    at = np.flatnonzero(np.isfinite(flag[1:])) + 1
    return at, flag[at]


class Shard:
    """Lays out one shard's documents as they come; holds ROUND sequences' worth of tokens and one document."""

    def __init__(self, closes: np.ndarray, shard: int, size: int = SIZE) -> None:
        self.closes, self.size, self.sequence = closes, size, shard << 32
        self.docs: deque = deque()  # doc_id, ids with the end, ids already laid out
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append([doc_id, ids, 0])
        self.held += len(ids)
        if self.held >= ROUND * self.size:
            yield from self._lay(False)

    def close(self) -> Iterator[tuple]:
        if self.held:
            yield from self._lay(True)

    def _lay(self, last: bool) -> Iterator[tuple]:
        ids = np.concatenate([d[1][d[2] :] for d in self.docs])
        ends = np.cumsum([len(d[1]) - d[2] for d in self.docs])
        at, price = candidates(ids, ends, self.closes)
        found = cuts(at, price, self.size)
        tail = found.pop() if len(found) == 1 or not last or len(ids) - found[-2] < self.size else None
        if not last:
            if not found:  # one sequence may be all there is
                found = [tail]
        elif tail is not None:
            begin = found[-1] if found else 0
            for bit in reversed(range(self.size.bit_length())):
                if (len(ids) - begin) >> bit & 1:
                    found.append((found[-1] if found else 0) + (1 << bit))
        begin = 0
        for end in found:
            yield from self._sequence(begin, end)
            begin = end

    def _sequence(self, begin: int, end: int) -> Iterator[tuple]:
        offset, want = 0, end - begin
        while offset < want:
            doc = self.docs[0]
            n = min(len(doc[1]) - doc[2], want - offset)
            part = doc[1][doc[2] : doc[2] + n]
            yield doc[0], doc[2], n, zlib.crc32(part.astype("<u4").tobytes()), len(doc[1]), self.sequence, offset
            doc[2] += n
            offset += n
            if doc[2] == len(doc[1]):
                self.docs.popleft()
        self.held -= want
        self.sequence += 1


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, kept: int | None = None) -> DataFrame:
    """One row for each piece of a document in a sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. Needs doc_id and text; other columns, whatever their names, are left out.

    Each input partition is a shard; its documents keep their order and are laid out as a stream, so a worker holds
    about 128 sequences and one document, and the pieces of text it has met: as many as suit a job that does nothing
    else, or `kept` of them until the task's end. Null and empty texts are the end id alone; repeated rows and ids are packed
    each by itself; an empty table gives no rows. A text of any length is cut over as many sequences as it needs.
    """
    path = path or tokenizer_path()
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.at(path)
        bpe.most = kept or KEPT
        shard, last = Shard(bpe.sentence_ends(), partition_id(), size), np.array([END_ID], dtype="<u4")
        kind = None
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:]]], NAMES)

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for part in pieces(batch, 1 << 22 if kept is None else 1 << 21):
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), bpe.encode(texts), strict=True):
                    rows.extend(shard.add(doc_id, np.concatenate((ids, last))))
                if len(rows) > 10_000:
                    yield out()
        rows.extend(shard.close())
        if kept:
            bpe.forget()
            relax()
        if rows:
            yield out()

    kind = f"doc_id {id_type.simpleString()}, " + ", ".join(f"{n} long" for n in NAMES[1:])
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
