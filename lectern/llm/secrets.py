"""Secret scans: fixed patterns, and a randomness test battery over every other long unbroken string.

A candidate is a whole run of [A-Za-z0-9+/_=-] of 16 characters or more. Its encoding (hex, base 32, base 62, ...) is
inferred from the characters in it. Three tests look at it:

* chi-squared uniformity over the encoding's alphabet,
* runs: how often neighbours change between lower case, upper case, digits and signs,
* serial correlation of neighbouring alphabet positions.

A candidate is refused if a test rejects randomness. For the others the first two statistics are also set against what
written words and names give at that length (a non-central chi-squared with the words' unevenness, a binomial with the
words' rate of changes); the Bonferroni minimum of both is a p-value of "only words". Within a document these p-values
pass a Benjamini-Hochberg step weighted by the candidates' lengths, so that many short identifiers cannot make a find.
"""

from __future__ import annotations

import hashlib
import math
import re
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lectern.llm.common import map_chunks, table, without

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: Encodings from the narrowest: name, alphabet in order, and the words' excess sum(p*p)*size-1 over a uniform choice.
ENCODINGS = (
    ("decimal", "0123456789", 0.1),
    ("hex", "0123456789abcdef", 1.0),
    ("hex_upper", "0123456789ABCDEF", 1.0),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.1),
    ("lower", "abcdefghijklmnopqrstuvwxyz", 0.7),
    ("lower36", "0123456789abcdefghijklmnopqrstuvwxyz", 1.3),
    ("upper36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1.3),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 3.0),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 3.1),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 3.1),
    ("mixed", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_=", 3.3),
)
#: Changes between kinds of characters a step in words, names, paths and camel case.
WORD_CHANGES = 0.15
#: A test that finds randomness this unlikely refuses the candidate; the rate of false finds to hold.
REFUSE, FALSE_RATE = 1e-3, 0.01

_FITS = np.zeros(256, dtype=np.int32)  # bit e of _FITS[c]: byte c is in encoding e
_RANK = np.zeros((len(ENCODINGS), 256), dtype=np.int64)
for _e, (_, _alphabet, _) in enumerate(ENCODINGS):
    for _i, _c in enumerate(_alphabet.encode()):
        _FITS[_c] |= 1 << _e
        _RANK[_e, _c] = _i
_SIZE = np.array([len(a) for _, a, _ in ENCODINGS])
_EXCESS = np.array([x for _, _, x in ENCODINGS])
_CLASS = np.zeros(256, dtype=np.int8)
for _i, _part in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789")):
    _CLASS[list(_part)] = _i + 1


def _normal(z: np.ndarray) -> np.ndarray:
    """P(Z <= z)."""
    return 0.5 * np.array([math.erfc(-x / math.sqrt(2)) for x in z])


def _chi2(x: np.ndarray, df: np.ndarray, away: np.ndarray) -> np.ndarray:
    """P(X <= x) of a non-central chi-squared: Patnaik's scaling, then Wilson and Hilferty's cube root."""
    scale, own = (df + 2 * away) / (df + away), (df + away) ** 2 / (df + 2 * away)
    v = 2 / (9 * own)
    return _normal((np.cbrt(x / scale / own) - (1 - v)) / np.sqrt(v))


def battery(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each candidate: its encoding's number, whether no test refuses randomness, and the p-value of only words."""
    k = len(found)
    size = np.array([len(x) for x in found])
    flat = np.frombuffer(b"".join(found), dtype=np.uint8)
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    own = np.repeat(np.arange(k), size)
    fits = np.bitwise_and.reduceat(_FITS[np.where(flat == 61, 43, flat)], start)
    ends_padded = flat[start + size - 1] == 61  # '=' ends base 64; elsewhere only the mixed alphabet has it
    inner = np.add.reduceat((flat == 61).astype(np.int64), start) > 2
    fits = np.where(ends_padded & ~inner, fits | (1 << 8), fits) | (1 << (len(ENCODINGS) - 1))
    fits = np.where(inner, 1 << (len(ENCODINGS) - 1), fits)
    low = fits & -fits
    code = np.round(np.log2(low)).astype(np.int64)
    rank = _RANK[code[own], flat]
    cells = 68
    counts = np.bincount(own * cells + rank, minlength=k * cells).reshape(k, cells).astype(float)
    a, n = _SIZE[code].astype(float), size.astype(float)
    stat = (counts**2).sum(1) * a / n - n
    away = n * _EXCESS[code]
    kinds = _CLASS[flat]
    inside = np.ones(len(flat), dtype=bool)
    inside[start] = False
    change = np.zeros(len(flat))
    change[1:] = kinds[1:] != kinds[:-1]
    change[~inside] = 0
    changes = np.add.reduceat(change, start)
    mix = np.zeros((k, 4))
    np.add.at(mix, (own, kinds), 1)
    apart = 1 - ((mix / n[:, None]) ** 2).sum(1)  # chance that two characters of this candidate differ in kind
    steps = n - 1
    sd = np.sqrt(np.maximum(steps * apart * (1 - apart), 0.25))
    z_runs = np.where(apart > 0, (changes - steps * apart) / sd, 0.0)
    x = rank - np.repeat(np.add.reduceat(rank, start) / n, size)
    near = np.zeros(len(flat))
    near[1:] = x[1:] * x[:-1]
    near[~inside] = 0
    var = np.add.reduceat(x * x, start)
    serial = np.add.reduceat(near, start) / np.where(var > 0, var, 1) * np.sqrt(n)
    random = (1 - _chi2(np.maximum(stat, 1e-9), a - 1, np.zeros(k)) >= REFUSE) & (var > 0)
    limit = 3.29  # two-sided 0.001
    random &= (np.abs(z_runs) <= limit) & (np.abs(serial + 1 / np.sqrt(n)) <= limit)
    p_even = _chi2(np.maximum(stat, 1e-9), a - 1, away)
    p_runs = 1 - _normal((changes - 0.5 - steps * WORD_CHANGES) / np.sqrt(steps * WORD_CHANGES * (1 - WORD_CHANGES)))
    return code, random, np.minimum(1.0, 2 * np.minimum(p_even, p_runs))


def discoveries(p: np.ndarray, size: np.ndarray, rate: float = FALSE_RATE) -> np.ndarray:
    """Benjamini and Hochberg's step over p / weight, weights by length and one on average."""
    if not len(p):
        return np.zeros(0, dtype=bool)
    own = p / (size / size.mean())
    order = np.argsort(own, kind="stable")
    good = np.flatnonzero(own[order] <= rate * np.arange(1, len(p) + 1) / len(p))
    out = np.zeros(len(p), dtype=bool)
    if len(good):
        out[order[: good[-1] + 1]] = True
    return out


_SIGNS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[re.Match]]:
    """(start, kind, end) of the fixed patterns, in order; and all candidate runs."""
    spans = []
    low = text.lower()
    if any(s in low for s in _SIGNS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    runs = list(RUN.finditer(text))
    for m in runs:  # a hex string lies in a candidate run
        if m.end() - m.start() >= 32:
            spans += [(h.start(), 2, h.end()) for h in HEX.finditer(text, m.start(), m.end()) if len(h[0]) >= 32]
    return sorted(spans), runs


def scan_texts(texts: list[str | None]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, str]]]]:
    """For each text: base spans (start, kind, end), and the battery's spans (start, end, encoding) apart from these."""
    base, found, owner = [], [], []
    for k, text in enumerate(texts):
        spans, runs = base_spans(text or "")
        base.append(spans)
        taken = [(s, e) for s, _, e in spans]
        for m in runs:
            if not any(s < m.end() and m.start() < e for s, e in taken):
                found.append(m)
                owner.append(k)
    more: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if found:
        code, random, p = battery([m[0].encode() for m in found])
        size = np.array([m.end() - m.start() for m in found], dtype=float)
        for k, group in groupby(range(len(found)), owner.__getitem__):
            own = np.array(list(group))
            good = discoveries(p[own], size[own]) & random[own]
            more[k] = [(found[i].start(), found[i].end(), ENCODINGS[code[i]][0]) for i in own[good].tolist()]
    return list(zip(base, more, strict=True))


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame) -> DataFrame:
    """docs with base_secrets and secrets: array of (kind, start, end), in code points, end exclusive, by start.

    base_secrets has the fixed patterns' matches, each kind by itself; secrets has these and what the battery finds
    outside them, its kind "random_" and the encoding. Columns of these names are replaced, all others stay. Null and
    empty texts have none. Each row is judged by itself, so copies, ties and order do not matter.
    """
    docs = without(docs, ["base_secrets", "secrets"])
    kept = docs.columns
    kind = "array<struct<kind:string,start:long,end:long>>"
    added = T._parse_datatype_string(f"base_secrets {kind}, secrets {kind}")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, every = [], []
        for spans, more in scan_texts(batch.column("text").to_pylist()):
            own = [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]
            rest = [{"kind": f"random_{c}", "start": s, "end": e} for s, e, c in more]
            base.append(own)
            every.append(sorted(own + rest, key=lambda x: x["start"]) if rest else own)
        return pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in kept], pa.array(base, _SPAN), pa.array(every, _SPAN)],
            [*kept, "base_secrets", "secrets"],
        )

    return map_chunks(docs, run, T.StructType([*docs.schema.fields, *added.fields]))


def redacted(text: str, spans: list[dict], mark: str) -> str:
    out, at = [], 0
    for s in sorted(spans, key=lambda x: (x["start"], -x["end"])):
        if s["end"] <= at:
            continue
        if s["start"] >= at:
            out += [text[at : s["start"]], mark]
        at = s["end"]
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span that scan finds replaced by the mark; n_chars, if there, follows. No row goes."""
    names, schema = docs.columns, docs.schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        new = []
        for text, (base, more) in zip(texts, scan_texts(texts), strict=True):
            spans = [{"start": s, "end": e} for s, _, e in base] + [{"start": s, "end": e} for s, e, _ in more]
            new.append(redacted(text, spans, mark) if spans else text)
        out = {c: batch.column(c) for c in names}
        out["text"] = pa.array(new, pa.string())
        if "n_chars" in out:
            old = out["n_chars"].to_pylist()
            out["n_chars"] = pa.array(
                [o if n is t else len(n) for n, t, o in zip(new, texts, old, strict=True)], out["n_chars"].type
            )
        return pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return map_chunks(docs, run, schema)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; the contract's digest of `scan`."""
    docs = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, every = batch.column("base_secrets").to_pylist(), batch.column("secrets").to_pylist()
        line = lambda spans: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)
        count = lambda k: pa.array([sum(s["kind"] == k for s in b) for b in base], pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                *[count(k) for k in KINDS],
                pa.array([hashlib.sha256(line(b).encode()).hexdigest() for b in base]),
                pa.array([line(s) for s in every], pa.string()),
            ],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_chunks(
        docs.select("doc_id", "base_secrets", "secrets"),
        run,
        f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
    )
