"""Benchmark decontamination by a generalised suffix automaton of the benchmark's words.

The automaton holds every substring of every item. A document's words stream through it; at each word it knows the
longest suffix that is part of an item, so a match of `window` words or more, or a whole shorter item, is a hit.

A match can only lie in a run of words whose neighbouring pairs all occur in the benchmark. These runs are found with
numpy over a batch of documents, and only they are walked, which gives the same lengths: at the first word of a run
the longest match is that word alone.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import cut, fresh, map_chunks, table, without, words

WINDOW = 10
#: A benchmark of more words than this is dealt into blocks, each with an automaton of its own.
BLOCK_WORDS = 400_000
#: Rows with hits that are sent to every task at most, after blocks; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Automaton:
    """Suffix automaton of several word lists; items are numbered as given."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window, self.ids = window, [name for name, _ in items]
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, set[int]] = defaultdict(set)
        self._whole: dict[int, list[tuple[int, int]]] = defaultdict(list)
        pairs: set[int] = set()
        self.least = window
        coded = [[self.vocab.setdefault(w, len(self.vocab)) for w in ws] for _, ws in items]
        self.base = len(self.vocab) + 1
        for k, seq in enumerate(coded):
            if not seq:
                continue
            state = 0
            for at, w in enumerate(seq):
                state = self._extend(state, w)
                if at + 1 >= window:
                    ends[state].add(k)
                if at:
                    pairs.add(seq[at - 1] * self.base + w)
            if len(seq) < window:
                self.least = min(self.least, len(seq))
        for k, seq in enumerate(coded):  # states are final now: a later clone may have taken an item's end
            state = 0
            for w in seq:
                state = self.next[state][w]
            if seq and len(seq) < window:
                self._whole[state].append((len(seq), k))
        self.ends: list[set[int] | None] = [None] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            got = ends.get(s)
            if got:
                self.ends[s] = got if self.ends[s] is None else self.ends[s] | got
            up = self.link[s]
            if self.ends[s] and up > 0 and self.length[up] >= window:
                self.ends[up] = self.ends[s] if self.ends[up] is None else self.ends[up] | self.ends[s]
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.seen = np.zeros(1 << 22, dtype=bool)
        self.seen[self.pairs & ((1 << 22) - 1)] = True
        self._short: dict[int, list[tuple[int, int]]] = {}

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = c
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def short(self, state: int) -> list[tuple[int, int]]:
        """(length, item) of the whole short items that end where this state's strings end."""
        found = self._short.get(state)
        if found is None:
            found = list(self._whole.get(state, ()))
            if self.link[state] > 0:
                found += self.short(self.link[state])
            self._short[state] = found
        return found

    def walk(self, seq: list[int], hit: np.ndarray, at: int) -> set[int]:
        """Marks in hit[at:] what lies in windows; the items found."""
        nxt, link, length, least, window = self.next, self.link, self.length, self.least, self.window
        state = size = 0
        items: set[int] = set()
        for i, w in enumerate(seq):
            while state and w not in nxt[state]:
                state = link[state]
                size = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                size += 1
            else:
                state = size = 0
            if size >= window:
                hit[at + i + 1 - size : at + i + 1] = True
                s = state
                while length[link[s]] >= window:
                    s = link[s]
                items |= self.ends[s]
            if least < window and size >= least:
                for n, k in self.short(state):
                    if n <= size:
                        hit[at + i + 1 - n : at + i + 1] = True
                        items.add(k)
        return items

    def scan(self, docs: list[list[bytes]]) -> tuple[list[np.ndarray], list[set[str]]]:
        """For each document: a flag for each word, and the ids of the items that were found."""
        sizes = [len(d) for d in docs]
        n = sum(sizes) + len(docs)
        ids = np.empty(n, dtype=np.int64)
        starts, at = [], 0
        for d, size in zip(docs, sizes, strict=True):
            starts.append(at)
            ids[at : at + size] = np.fromiter(map(self.vocab.get, d, repeat(-1)), np.int64, size)
            ids[at + size] = -1  # no run goes on into the next document
            at += size + 1
        hit = np.zeros(n, dtype=bool)
        found: dict[int, set[int]] = defaultdict(set)
        if n and self.vocab:
            known = ids >= 0
            if self.least > 1:
                code = ids[:-1] * self.base + ids[1:]
                good = known[:-1] & known[1:]
                good &= self.seen[code & ((1 << 22) - 1)]
                where = np.flatnonzero(good)
                if len(where):
                    k = np.searchsorted(self.pairs, code[where])
                    k[k == len(self.pairs)] = 0
                    good[where] = self.pairs[k] == code[where]
                gain = 1
            else:
                good, gain = known, 0
            edge = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
            first, last = edge[::2], edge[1::2] + gain  # words of a run: first..last, end exclusive
            keep = last - first >= self.least
            owner = np.searchsorted(np.array(starts), first[keep], "right") - 1
            for a, b, doc in zip(first[keep].tolist(), last[keep].tolist(), owner.tolist(), strict=True):
                got = self.walk(ids[a:b].tolist(), hit, a)
                if got:
                    found[doc] |= got
        return (
            [hit[s : s + size] for s, size in zip(starts, sizes, strict=True)],
            [{self.ids[k] for k in found.get(i, ())} for i in range(len(docs))],
        )


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


_ADDED = "n_words long, hits array<struct<first:long,last:long>>, items array<string>"


def find(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, hits (word ranges inside benchmark windows, end exclusive) and items (ids found, sorted).

    docs needs `text`; its columns named n_words, hits or items are replaced, all others stay. items needs item_id and
    text. A null or empty text has no words, hence no hits; items without words are passed over; items with equal ids
    count once; repeated documents are judged each by itself; with no items nothing is hit.

    The benchmark is the query set. Its size is measured first; one of over block_words words is dealt by a hash of
    item_id into blocks, and the documents are read once for each, so a worker never holds more than one block's
    automaton; what is written for a block is the rows that it hits, without their texts. These are joined with the
    documents at the end. With one block documents are not shuffled.
    """
    docs = without(docs, ["n_words", "hits", "items"])
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(_ADDED).fields])
    return _passes(docs, items, window, block_words, schema, _found(docs.columns))


def _passes(docs: DataFrame, items: DataFrame, window: int, block_words: int, schema: T.StructType, last) -> DataFrame:
    """The documents past all blocks of the benchmark; `last` makes the rows of the result."""
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text"))
    size = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // (6 * block_words)))

    def shared(own: DataFrame):
        automaton = Automaton([(str(r.item_id), words(r.text)) for r in own.toLocalIterator()], window)
        return docs.sparkSession.sparkContext.broadcast(automaton)

    if blocks == 1:
        return map_chunks(docs, _scanned(shared(items), last), schema)
    row, hits, ids = fresh(docs, "_row"), fresh(docs, "_hits"), fresh(docs, "_items")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    texts = rows.select(F.col(row).alias("row"), "text")
    kind = "row long, hits array<struct<first:long,last:long>>, items array<string>"
    parts = []
    for block in range(blocks):
        own = shared(items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block))
        parts.append(cut(map_chunks(texts, _scanned(own, _hit_rows), kind), "hits"))
    every = reduce(DataFrame.unionByName, parts)
    merge = lambda c: F.flatten(F.collect_list(c))
    every = cut(every.groupBy("row").agg(merge("hits").alias(hits), F.array_sort(merge("items")).alias(ids)).withColumnRenamed("row", row), "hits")
    few = every.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(every) if few else every, row, "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = [len(words(t)) for t in batch.column("text").to_pylist()]
        spans = []
        for n, found in zip(sizes, batch.column(hits).to_pylist(), strict=True):
            hit = np.zeros(n if found else 0, dtype=bool)
            for x in found or ():
                hit[x["first"] : x["last"]] = True
            spans.append(_spans(hit))
        return last(batch, sizes, spans, [x or [] for x in batch.column(ids).to_pylist()])

    return map_chunks(joined, run, schema)


def _scanned(shared, make):
    """A function of batches: finds hits and items and hands them on."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs = [words(t) for t in batch.column("text").to_pylist()]
        hits, items = shared.value.scan(docs)
        return make(batch, [len(d) for d in docs], [_spans(h) if h.any() else [] for h in hits], [sorted(i) for i in items])

    return run


def _named(spans: list) -> pa.Array:
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    return pa.array([[{"first": a, "last": b} for a, b in s] for s in spans], kind)


def _hit_rows(batch: pa.RecordBatch, sizes: list[int], spans: list, ids: list) -> pa.RecordBatch:
    found = [batch.column("row"), _named(spans), pa.array(ids, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(found, ["row", "hits", "items"]).filter(pa.array([bool(s) for s in spans], pa.bool_()))


def _found(kept: list[str]):
    def make(batch: pa.RecordBatch, sizes: list[int], spans: list, ids: list) -> pa.RecordBatch:
        added = [pa.array(sizes, pa.int64()), _named(spans), pa.array(ids, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *added], [*kept, "n_words", "hits", "items"])

    return make


def _cleaned(text: str, spans: list[tuple[int, int]], least: int) -> str:
    spans = [s for s in spans if s[1] - s[0] >= least]
    if not spans:
        return text
    at = [m.span() for m in _WORD.finditer(text)]
    out, begin = [], 0
    for first, last in spans:
        out.append(text[begin : at[first][0]])
        begin = at[last - 1][1]
    return "".join([*out, text[begin:]])


def remove(
    docs: DataFrame,
    items: DataFrame,
    *,
    window: int = WINDOW,
    least: int = 1,
    coverage: float = 0.5,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """docs without benchmark spans: a document of which `coverage` or more of its words is hit goes; from the others
    each hit span of `least` words or more is cut out of text, and n_chars (if there) follows. Others stay as they are:
    null and empty texts, and all where there are no items. Repeated rows are judged each by itself and stay repeated;
    a text of any length is read whole; an empty table gives none; columns of any other name stay as they are.
    """
    names = docs.columns

    def make(batch: pa.RecordBatch, sizes: list[int], spans: list, ids: list) -> pa.RecordBatch:
        hit = [sum(b - a for a, b in s) for s in spans]
        stay = [h == 0 or h < n * coverage for h, n in zip(hit, sizes, strict=True)]
        out = {c: batch.column(c) for c in names}
        texts = out["text"].to_pylist()
        new = [_cleaned(t, s, least) if s else t for t, s in zip(texts, spans, strict=True)]
        out["text"] = pa.array(new, pa.string())
        if "n_chars" in out:
            old = out["n_chars"].to_pylist()
            n = [len(t) if s else o for t, s, o in zip(new, spans, old, strict=True)]
            out["n_chars"] = pa.array(n, out["n_chars"].type)
        return pa.RecordBatch.from_arrays(list(out.values()), list(out)).filter(pa.array(stay, pa.bool_()))

    return _passes(docs, items, window, block_words, docs.schema, make)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item; the contract's digest of `find`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def brute(text: str | None, items: dict[str, str | None], window: int = WINDOW) -> tuple[int, int, list[str]]:
    """n_words, n_hit and items by comparing every window with every place; for tests."""
    ws = words(text)
    hit, found = set(), set()
    for name, other in items.items():
        it = words(other)
        wins = [it] if 0 < len(it) < window else [it[i : i + window] for i in range(len(it) - window + 1)]
        for win in wins:
            for i in range(len(ws) - len(win) + 1):
                if ws[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add(name)
    return len(ws), len(hit), sorted(chain(found))
