"""LM scoring with a gated recurrent network in numpy.

Words of the training documents are counted in full. The LEARNT commonest (and the end of a text) are the network's
vocabulary, any other is its unknown word; a gated recurrent unit reads them, and a softmax over classes of words and
one within the class give the next. Training is truncated backpropagation over windows of STEPS words, in lanes of
documents one after another; the state is carried from window to window and starts anew at a document. Every task
trains on its documents from common weights, and the weights are averaged by words seen, in rounds. Scoring carries
the state through the whole document, so its log-likelihood is complete.

An unknown word's own probability is its share among the words outside the vocabulary with one added to each count and
one for the unseen, so the model spreads probability over the same words as the counts' add-one model does.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import cut, lower_ascii, partition_id, pieces, table

END = b"\n"
UNKNOWN = 0
#: The network: words it learns, classes, units; words in a window, lanes.
LEARNT, CLASSES, UNITS, STEPS, LANES = 4096, 64, 24, 32, 256
#: Commonest words whose counts go to every task (of at most LONGEST bytes); others are joined.
SENT, LONGEST = 200_000, 64
RATE, ROUNDS = 0.15, 2
#: Input partitions whose documents one task trains on.
SPLITS = 4
#: Words that a task lays out in lanes at a time: enough for long documents to run beside others.
HELD = 6_000_000
#: Values in a block of weights on their way to the average.
BLOCK = 8192


def tokens(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z in lower case, then one end."""
    return [*lower_ascii(text or "").split(), END]


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def _key(word: bytes) -> int:
    x = xxhash.xxh3_64_intdigest(word)
    return x - (1 << 64) if x >> 63 else x


def counts(docs: DataFrame) -> DataFrame:
    """h (hash of the word), word (null if over LONGEST bytes), c. Every task adds up before anything is dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter = Counter()

        def out() -> pa.RecordBatch:
            ws = list(own)
            cols = [
                pa.array(np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws)).view(np.int64)),
                pa.array([w if len(w) <= LONGEST else None for w in ws], pa.binary()).cast(pa.string()),
                pa.array(list(own.values()), pa.int64()),
            ]
            own.clear()
            return pa.RecordBatch.from_arrays(cols, ["h", "word", "c"])

        for batch in batches:
            for part in pieces(batch):
                for text in part.column("text").to_pylist():
                    own.update(tokens(text))
                if len(own) > 400_000:
                    yield out()
        if own:
            yield out()

    each = docs.select("text").mapInArrow(run, "h long, word string, c long")
    return each.groupBy("h", "word").agg(F.sum("c").alias("c"))


def _small(n: int) -> type:
    """The type of numbers under n: stable sorts of 16 bits are by radix."""
    return np.uint16 if n <= 1 << 16 else np.int64


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def _sums(x: np.ndarray) -> np.ndarray:
    """Of rows, as a product: several times as fast as sum over short rows."""
    return x @ np.ones(x.shape[1], dtype=x.dtype)


def _plus(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In place."""
    x += y
    return x


def _softmax(x: np.ndarray) -> np.ndarray:
    """Rows' shares, in place. Scores are far from where exp would overflow: Adagrad's steps shrink."""
    np.exp(x, out=x)
    x *= np.reciprocal(_sums(x))[:, None]
    return x


def _log_share(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logarithm of one share of each row; x is used up."""
    own = x[np.arange(len(at)), at]
    np.exp(x, out=x)
    return own - np.log(_sums(x))


@dataclass
class Vocabulary:
    """Ids: 0 unknown, then the learnt words by count. Classes are runs of ids with about as much sqrt of count each."""

    words: dict[bytes, int]
    mass: np.ndarray  # by id, the training share of the word; of all unlearnt ones at 0
    bounds: np.ndarray  # class k has ids bounds[k]..bounds[k+1]

    @classmethod
    def of(cls, common: list[tuple[bytes, int]], total: int, learnt: int = LEARNT, classes: int = CLASSES) -> "Vocabulary":
        own = common[:learnt]
        if END not in (w for w, _ in own):
            own = [*own[: learnt - 1], (END, 1)]
        rest = max(1, total - sum(c for _, c in own))
        mass = np.array([rest, *[c for _, c in own]], dtype=np.float64)
        part = np.cumsum(np.sqrt(mass))
        k = np.minimum((part / part[-1] * classes).astype(int), classes - 1)
        bounds = np.concatenate(([0], np.flatnonzero(np.diff(k)) + 1, [len(mass)]))
        return cls({w: i + 1 for i, (w, _) in enumerate(own)}, mass / mass.sum(), bounds)


class Network:
    """x: input weights of words to gates; u: state to gates; wc, bc: classes; ww, bw: words."""

    NAMES = ("x", "u", "wc", "bc", "ww", "bw")

    def __init__(self, vocab: Vocabulary, units: int = UNITS, seed: int = 5) -> None:
        r = np.random.RandomState(seed)
        n, k = len(vocab.mass), len(vocab.bounds) - 1
        self.vocab, self.units = vocab, units
        self.x = (r.randn(n, 3 * units) * 0.1).astype(np.float32)
        self.x[:, :units] += 1.0  # the state is kept at first
        self.u = (r.randn(units, 3 * units) / math.sqrt(units)).astype(np.float32)
        self.wc = np.zeros((units, k), dtype=np.float32)
        self.ww = np.zeros((n, units), dtype=np.float32)
        by_class = np.add.reduceat(vocab.mass, vocab.bounds[:-1])
        self.bc = np.log(by_class).astype(np.float32)
        self.owner = np.repeat(np.arange(k, dtype=_small(k)), np.diff(vocab.bounds))
        self.bw = (np.log(vocab.mass) - np.log(by_class)[self.owner]).astype(np.float32)
        self.end = vocab.words[END]

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> "Network":
        at = 0
        for n in self.NAMES:
            a = getattr(self, n)
            setattr(self, n, flat[at : at + a.size].astype(np.float32).reshape(a.shape))
            at += a.size
        return self

    def read(self, h: np.ndarray, seen: np.ndarray, kept: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States after each word of a window (steps, lanes), and the last; a text's end starts a new state."""
        n, size = self.units, seen.shape
        keep = (seen != self.end).astype(np.float32)[:, :, None]
        u_zr, u_n = np.ascontiguousarray(self.u[:, : 2 * n]), np.ascontiguousarray(self.u[:, 2 * n :])
        states = np.empty((*size, n), dtype=np.float32)
        # what backpropagation needs of every step, and otherwise of one at a time
        held = size if kept is not None else (1, size[1])
        before, zr, g, new = (np.empty((*held, k * n), dtype=np.float32) for k in (1, 2, 1, 1))
        for t in range(len(seen)):
            i = t % len(before)
            word = self.x.take(seen[t], axis=0)
            b, own, c, m = before[i], zr[i], g[i], new[i]
            np.multiply(h, keep[t], out=b)
            np.matmul(b, u_zr, out=own)
            own += word[:, : 2 * n]
            _sigmoid(own)
            np.matmul(b, u_n, out=c)
            np.multiply(own[:, n:], c, out=m)
            m += word[:, 2 * n :]
            np.tanh(m, out=m)
            h = states[t]
            np.subtract(b, m, out=h)
            h *= own[:, :n]
            h += m
        if kept is not None:
            kept |= {"keep": keep, "before": before, "zr": zr, "g": g, "new": new}
        return states, h

    def groups(self, target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
        """An order of targets by class, and for each class of over one word: its words a..b, its targets i..j there."""
        own = self.owner[target]
        order = np.argsort(own, kind="stable")
        own = own[order]
        edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)] if len(own) else [0]
        bounds = self.vocab.bounds.tolist()
        at = [(bounds[own[i]], bounds[own[i] + 1], i, j) for i, j in zip(edges, edges[1:])]
        return order, [x for x in at if x[1] - x[0] > 1]

    def log_p(self, states: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probabilities of words after these states."""
        order, groups = self.groups(target)
        s, want = states[order], target[order]
        found = _log_share(_plus(s @ self.wc, self.bc), self.owner[want]).astype(np.float64)
        for a, b, i, j in groups:
            found[i:j] += _log_share(_plus(s[i:j] @ self.ww[a:b].T, self.bw[a:b]), want[i:j] - a)
        out = np.empty(len(order))
        out[order] = found
        return out

    def step(self, h: np.ndarray, seen: np.ndarray, target: np.ndarray, old: dict[str, np.ndarray], rate: float = RATE) -> np.ndarray:
        """One window of truncated backpropagation and an Adagrad step. target is -1 where a lane has ended."""
        n, kept = self.units, {}
        states, last = self.read(h, seen, kept)
        where = np.flatnonzero(target.ravel() >= 0)
        order, groups = self.groups(target.ravel()[where])
        where = where[order]
        want, s = target.ravel()[where], states.reshape(-1, n)[where]
        grad = {}
        d = _softmax(_plus(s @ self.wc, self.bc))
        d[np.arange(len(want)), self.owner[want]] -= 1
        grad["wc"], grad["bc"] = s.T @ d, np.ones(len(d), dtype=d.dtype) @ d
        ds = d @ self.wc.T
        grad["ww"], grad["bw"] = np.zeros_like(self.ww), np.zeros_like(self.bw)
        for a, b, i, j in groups:
            e = _softmax(_plus(s[i:j] @ self.ww[a:b].T, self.bw[a:b]))
            e[np.arange(j - i), want[i:j] - a] -= 1
            grad["ww"][a:b] = e.T @ s[i:j]
            grad["bw"][a:b] = np.ones(len(e), dtype=e.dtype) @ e
            ds[i:j] += e @ self.ww[a:b]
        out = np.zeros((seen.size, n), dtype=np.float32)
        out[where] = ds
        out = out.reshape(*seen.shape, n)
        # what a change of the state does to the gates, for all words at once
        before, new = kept["before"], kept["new"]
        z, r = np.ascontiguousarray(kept["zr"][:, :, :n]), np.ascontiguousarray(kept["zr"][:, :, n:])
        to_n = (1 - z) * (1 - new * new)
        to = np.empty((*seen.shape, 3, n), dtype=np.float32)
        to[:, :, 0] = (before - new) * z * (1 - z)
        to[:, :, 2] = to_n * r
        to[:, :, 1] = to[:, :, 2] * kept["g"] * (1 - r)
        gates, dn = np.empty_like(to), np.empty_like(new)
        dh, back = np.zeros_like(h), np.ascontiguousarray(self.u.T)
        for t in reversed(range(len(seen))):
            dh += out[t]
            np.multiply(dh, to_n[t], out=dn[t])
            np.multiply(to[t], dh[:, None], out=gates[t])
            dh *= z[t]
            dh += gates[t].reshape(-1, 3 * n) @ back
            dh *= kept["keep"][t]
        flat = gates.reshape(-1, 3 * n)
        grad["u"] = before.reshape(-1, n).T @ flat
        gates[:, :, 2] = dn
        ids = seen.ravel().astype(_small(len(self.x)))
        order = np.argsort(ids, kind="stable")
        at = np.concatenate(([0], np.flatnonzero(np.diff(ids[order])) + 1))
        rows = ids[order][at]
        gx = np.add.reduceat(flat[order], at, axis=0)
        old["x"][rows] += gx * gx
        self.x[rows] -= rate * gx / np.sqrt(old["x"][rows])
        for name, g in grad.items():
            old[name] += g * g
            g *= rate
            g /= np.sqrt(old[name])
            own = getattr(self, name)
            own -= g
        return last


@dataclass
class Lanes:
    """Documents put one after another into lanes of about equal length. The words of lane k are `target[at[k] : at[k] +
    size[k]]` and `seen` has the word before each; nothing is padded, so a long text takes no more than its words."""

    seen: np.ndarray
    target: np.ndarray
    at: np.ndarray
    size: np.ndarray
    place: list[int]  # of each document: its first word in target

    @classmethod
    def of(cls, docs: list[np.ndarray], end: int, most: int = LANES) -> "Lanes":
        total = sum(map(len, docs))
        width = max(1, min(most, len(docs), total // (2 * STEPS) + 1))
        heap = [(0, k) for k in range(width)]
        own: list[list[int]] = [[] for _ in range(width)]
        for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
            n, k = heapq.heappop(heap)
            own[k].append(i)
            heapq.heappush(heap, (n + len(docs[i]), k))
        size = np.zeros(width, dtype=np.int64)
        for n, k in heap:
            size[k] = n
        at = np.cumsum(size) - size
        place = [0] * len(docs)
        for k, line in enumerate(own):
            n = int(at[k])
            for i in line:
                place[i] = n
                n += len(docs[i])
        target = np.concatenate([docs[i] for line in own for i in line]) if docs else np.zeros(0, dtype=np.int32)
        seen = np.empty_like(target)
        seen[1:] = target[:-1]
        seen[at[size > 0]] = end
        return cls(seen, target, at, size, place)

    def windows(self, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For every `steps` words of the lanes that have not ended: their numbers, where their words are in target
        (steps, lanes), and which of these places are in the lane; others have some word of it."""
        for begin in range(0, int(self.size.max(initial=0)), steps):
            live = np.flatnonzero(self.size > begin)
            left = self.size[live] - begin
            step = np.arange(min(steps, int(left.max())))[:, None]
            inside = step < left
            yield live, self.at[live] + begin + np.where(inside, step, 0), inside


def train(net: Network, docs: Iterator[list[np.ndarray]]) -> int:
    """Trains on lists of documents; the words seen."""
    old = {n: np.full_like(getattr(net, n), 1.0) for n in net.NAMES}
    n = 0
    for some in docs:
        lanes = Lanes.of(some, net.end)
        h = np.zeros((len(lanes.size), net.units), dtype=np.float32)
        for live, at, inside in lanes.windows(STEPS):
            h[live] = net.step(h[live], np.where(inside, lanes.seen[at], net.end), np.where(inside, lanes.target[at], -1), old)
        n += sum(map(len, some))
    return n


def log_likelihoods(net: Network, docs: list[np.ndarray], window: int = STEPS) -> np.ndarray:
    """Natural log probability of each whole document."""
    if not docs:
        return np.zeros(0)
    lanes = Lanes.of(docs, net.end)
    lp = np.empty(len(lanes.target))
    h = np.zeros((len(lanes.size), net.units), dtype=np.float32)
    for live, at, inside in lanes.windows(window):
        states, h[live] = net.read(h[live], lanes.seen[at])
        at = at[inside]
        lp[at] = net.log_p(states[inside], lanes.target[at])
    return np.array([lp[at : at + len(d)].sum() for d, at in zip(docs, lanes.place, strict=True)])


def _trained(net: Network, docs: DataFrame) -> Network:
    """One round: every task trains from the same weights, and blocks of weights meet to be averaged, first those of
    about as many tasks as there are groups of tasks, then theirs."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    tasks = max(4, docs.rdd.getNumPartitions() // SPLITS)
    groups = math.isqrt(tasks) if tasks > 64 else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(shared.value.vocab, shared.value.units).load(shared.value.flat())
        get = own.vocab.words.get

        def some() -> Iterator[list[np.ndarray]]:
            held, n = [], 0
            for batch in batches:
                for part in pieces(batch):
                    for text in part.column("text").to_pylist():
                        ws = tokens(text)
                        held.append(np.fromiter(map(get, ws, repeat(UNKNOWN)), np.int32, len(ws)))
                        n += len(held[-1])
                        if n > HELD:
                            yield held
                            held, n = [], 0
            if held:
                yield held

        n = train(own, some())
        if n:
            flat = own.flat()
            blocks = range(0, len(flat), BLOCK)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b // BLOCK for b in blocks], pa.int32()), pa.array([partition_id() % groups] * len(blocks), pa.int32()), pa.array([float(n)] * len(blocks)), pa.array([flat[b : b + BLOCK] for b in blocks], pa.list_(pa.float32()))],
                ["block", "part", "n", "weights"],
            )

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list] = {}
        for batch in batches:
            cols = [batch.column(c) for c in ("block", "part", "n", "weights")]
            for i in range(batch.num_rows):
                key, n, w = (cols[0][i].as_py(), cols[1][i].as_py()), cols[2][i].as_py(), cols[3][i].values.to_numpy().astype(np.float64)
                was = total.get(key)
                total[key] = [n, n * w] if was is None else [was[0] + n, was[1] + n * w]
        if total:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b for b, _ in total], pa.int32()),
                    pa.array([0] * len(total), pa.int32()),
                    pa.array([n for n, _ in total.values()]),
                    pa.array([(w / n).astype(np.float32) for n, w in total.values()], pa.list_(pa.float32())),
                ],
                ["block", "part", "n", "weights"],
            )

    kind = "block int, part int, n double, weights array<float>"
    each = docs.select("text").coalesce(tasks).mapInArrow(run, kind)
    if groups > 1:
        each = each.repartition("block", "part").mapInArrow(mean, kind)
    found = each.repartition("block").mapInArrow(mean, kind).collect()  # one network's weights
    if not found:
        return net
    flat = np.concatenate([np.array(r.weights, dtype=np.float32) for r in sorted(found, key=lambda r: r.block)])
    return Network(net.vocab, net.units).load(flat)


@dataclass
class Model:
    net: Network
    sent: dict[bytes, int]  # counts of the commonest words
    n: int
    v: int
    n_other: int  # training words outside the network's vocabulary, and how many different ones
    v_other: int


def commonest(known: DataFrame, most: int = SENT) -> list[tuple[bytes, int]]:
    """Words and counts from the most frequent on, `most` at most. A histogram of counts in steps of a sixteenth of a
    doubling, of bounded size, says from which step on that many remain; only these words come to the driver."""
    step = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")
    words = known.where("word IS NOT NULL").withColumn("step", step)
    left, least = most, None
    for r in sorted(words.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["step"]):
        left -= r["n"]
        if left < 0:
            break
        least = r["step"]
    if least is None:
        return []
    rows = words.where(F.col("step") >= least).select("word", "c").collect()
    return sorted(((r.word.encode(), r.c) for r in rows), key=lambda x: (-x[1], x[0]))


def fit(train_docs: DataFrame, known: DataFrame, rounds: int = ROUNDS) -> Model:
    """known: counts(train_docs), written. Each round trains on its own share of the documents, by a hash of the text."""
    total = known.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    common = commonest(known)
    vocab = Vocabulary.of(common, n)
    net = Network(vocab)
    for k in range(rounds if n else 0):
        net = _trained(net, train_docs.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k))
    sent = dict(common)
    inside = sum(sent.get(w, 0) for w in vocab.words)
    return Model(net, sent, n, v, n - inside, v - sum(w in sent for w in vocab.words))


_ROW = "row_id long, h long, times long, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, model: Model, known: DataFrame) -> DataFrame:
    """row_id, doc_id, n_tokens, n_known, base_score, score (log10) of every row of docs.

    Common words' counts are in every task; of the others each document sends one row a word to be joined with known
    counts. The rows that carry the documents' own figures have keys of their own in that join, all different.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), *T._parse_datatype_string(_ROW).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        row = partition_id() << 40
        bottom, other = math.log10(m.n + m.v + 1), math.log10(m.n_other + m.v_other + 1)
        place = {w: i for i, w in enumerate(m.sent)}
        # by place in m.sent, and last, where a word that is not there finds it: log10(c + 1), and the network's id
        log_c = np.append(np.log10(np.array(list(m.sent.values()), dtype=np.float64) + 1), 0.0)
        known_id = np.array([*(m.net.vocab.words.get(w, UNKNOWN) for w in m.sent), UNKNOWN], dtype=np.int32)
        for batch in batches:
            for part in pieces(batch, 1 << 25):
                ids: list[np.ndarray] = []
                own: list[tuple] = []  # of each document: words, those known here, and the sums of their logarithms
                tails: list[bytes] = []
                times: list[int] = []
                sizes: list[int] = []
                for text in part.column("text").to_pylist():
                    ws = tokens(text)
                    at = np.fromiter(map(place.get, ws, repeat(-1)), np.int64, len(ws))
                    ids.append(known_id[at])
                    far = np.flatnonzero(at < 0)
                    tail = Counter([ws[i] for i in far.tolist()])
                    near = len(ws) - len(far)
                    unlearnt = (ids[-1] == UNKNOWN) & (at >= 0)
                    base = float(log_c[at].sum()) - near * bottom
                    own.append((len(ws), near, base, float(log_c[at[unlearnt]].sum()) - int(unlearnt.sum()) * other))
                    tails += tail
                    times += tail.values()
                    sizes.append(len(tail))
                rows = np.arange(row, row + len(ids))
                row += len(ids)
                words_, near, base, score = (np.array(c) for c in zip(*own, strict=True))
                score = score + log_likelihoods(m.net, ids) / math.log(10)
                keys = [_key(b"\n%d" % k) for k in rows.tolist()]
                figures = [rows, np.array(keys), np.zeros(len(rows), dtype=np.int64), words_, near, base, score]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, figures)], schema.names)
                if tails:
                    n = len(tails)
                    far_keys = np.fromiter(map(xxhash.xxh3_64_intdigest, tails), np.uint64, n).view(np.int64)
                    figures = [np.repeat(rows, sizes), far_keys, np.array(times, dtype=np.int64)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(n, part.column("doc_id").type), *map(pa.array, figures), *[pa.nulls(n, pa.int64())] * 2, *[pa.nulls(n, pa.float64())] * 2], schema.names
                    )

    rows = docs.select("doc_id", "text").mapInArrow(run, schema)
    joined = rows.join(known.select("h", "c"), "h", "left")
    c = F.coalesce("c", F.lit(0))
    tail = F.col("times") > 0
    bottom, other = model.n + model.v + 1, model.n_other + model.v_other + 1
    joined = joined.select(
        "row_id", "doc_id", "n_tokens",
        F.when(tail, F.when(c > 0, F.col("times")).otherwise(0)).otherwise(F.col("n_known")).alias("n_known"),
        F.when(tail, F.col("times") * F.log10((c + 1) / F.lit(float(bottom)))).otherwise(F.col("base_score")).alias("base_score"),
        F.when(tail, F.col("times") * F.log10((c + 1) / F.lit(float(other)))).otherwise(F.col("score")).alias("score"),
    )
    return joined.groupBy("row_id").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score")
    )


def scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32(doc_id as text) mod 7 is 2 are held out of counts and training. Null texts are an end alone;
    a null doc_id counts as the empty text, which is not held out; repeated rows are trained on and scored each by
    itself; without training documents every count is 0; a text of any length is read whole, its state carried from
    window to window, and takes memory for its words alone. Other columns are left out. Sums of logarithms may differ
    in the last digits with the order of rows.
    """
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    out = F.pmod(crc, F.lit(7)) == 2
    train_docs = docs.where(~out).select("text")
    known = cut(counts(train_docs), "counts")
    model = fit(train_docs, known, rounds)
    scored = score(docs.select("doc_id", "text"), model, known)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document."""
    return scores(table(spark, sf_dir, "documents"))
