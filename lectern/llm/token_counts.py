"""Token counts by field or section through offset-mapped attribution.

A document is encoded once, as a whole. Its tokens are an unbroken line of byte spans; sections are another. An
interval join of the two, by binary search on the bounds, gives each token's section. A token that crosses a bound is
allocated by a rule:

* "most": to the section that holds most of its bytes, the earlier one of equals,
* "start" or "end": to the section of its first or last byte.

So the sections' counts always add up to the document's, which separate encodings of the sections do not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import map_chunks, table
from lectern.llm.tokens import ByteBpe

RULES = ("most", "start", "end")


def _files() -> tuple[str, str]:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def allocate(sizes: np.ndarray, bounds: np.ndarray, rule: str = "most") -> np.ndarray:
    """Tokens in each section. sizes: bytes of the tokens in order; bounds: the sections' ends in bytes, ascending, the
    last one the whole. A section without bytes gets nothing."""
    k = len(bounds)
    if not len(sizes):
        return np.zeros(k, dtype=np.int64)
    end = np.cumsum(sizes, dtype=np.int64)
    start = end - sizes
    first = np.searchsorted(bounds, start, "right")
    last = np.searchsorted(bounds, end - 1, "right")
    if rule == "start":
        own = first
    elif rule == "end":
        own = last
    else:
        own = first.copy()
        for i in np.flatnonzero(first != last).tolist():
            inner = bounds[first[i] : last[i]]
            share = np.diff(np.concatenate(([start[i]], inner, [end[i]])))
            own[i] = first[i] + int(np.argmax(share))
    return np.bincount(own, minlength=k).astype(np.int64)


def sections(text: str) -> list[tuple[int, int]]:
    """Lines with their line ends, as (start, end) in code points; one empty section for an empty text."""
    if not text:
        return [(0, 0)]
    out, at = [], 0
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop + 1
        out.append((at, stop))
        at = stop
    return out


def count_fields(bpe: ByteBpe, parts: list[str], rule: str = "most") -> tuple[int, np.ndarray]:
    """Tokens of the parts put together, and of each part."""
    bounds = np.cumsum([len(p.encode("utf-8", "replace")) for p in parts], dtype=np.int64)
    sizes = bpe.sizes_of("".join(parts)).astype(np.int64)
    return len(sizes), allocate(sizes, bounds, rule)


def counts(docs: DataFrame, fields: tuple[str, ...] = ("source", "lang"), *, rule: str = "most", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """For each row of docs one row for each field and line: doc_id, part ("field:<name>" or "line"), section (its
    number in the document, from 0), start, end (code points in the document), n_tokens, doc_tokens.

    The document is the named fields, each followed by a line end, and then the text. Null fields and texts are empty;
    fields that docs does not have are passed over; an empty text is one empty line of no tokens. Repeated rows are
    counted each by itself, an empty table gives no rows, other columns are left out. A document is counted in its
    own row, so nothing is shuffled and a text's size bounds the memory.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if path is None or pattern is None:
        path, pattern = _files()
    fields = tuple(f for f in fields if f in docs.columns)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = ByteBpe.at(path, pattern)
        names = ["part", "section", "start", "end", "n_tokens", "doc_tokens"]
        out: dict[str, list] = {n: [] for n in names}
        rows = []
        heads = [batch.column(f).to_pylist() for f in fields]
        for k, text in enumerate(batch.column("text").to_pylist()):
            text = text or ""
            lines = sections(text)
            parts = [f"{'' if h[k] is None else h[k]}\n" for h in heads] + [text[a:b] for a, b in lines]
            total, own = count_fields(bpe, parts, rule)
            ends = np.cumsum([len(p) for p in parts]).tolist()
            rows += [k] * len(parts)
            out["part"] += [*[f"field:{f}" for f in fields], *["line"] * len(lines)]
            out["section"] += range(len(parts))
            out["start"] += [0, *ends[:-1]]
            out["end"] += ends
            out["n_tokens"] += own.tolist()
            out["doc_tokens"] += [total] * len(parts)
        ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
        kinds = [pa.string(), *[pa.int64()] * 5]
        return pa.RecordBatch.from_arrays([ids, *[pa.array(out[n], t) for n, t in zip(names, kinds, strict=True)]], ["doc_id", *names])

    return map_chunks(
        docs.select("doc_id", "text", *fields),
        run,
        f"doc_id {id_type}, part string, section long, start long, end long, n_tokens long, doc_tokens long",
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fields and lines."""
    return counts(table(spark, sf_dir, "documents"))
