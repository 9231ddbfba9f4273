"""Text normalisation with a reversible map, and distances that never make a changed amount cheap.

All positions are Unicode code points, ends are exclusive. Null texts stay null.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters with the Unicode property White_Space.
WHITE_SPACE = frozenset(
    map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)
_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
_SPACE = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_OTHER = _SPACE.replace("[", "[^", 1)
#: Runs of white space that are not one space already.
_CHANGED = rf"{_SPACE.replace(chr(92) + 'x20', '')}{_SPACE}*|\x20{_SPACE}+"
_IS_WHITE = np.isin(np.arange(max(map(ord, WHITE_SPACE)) + 2), list(map(ord, WHITE_SPACE)))
#: Categories of characters whose change matters by itself: digits, currency, mathematical signs, dashes.
MATERIAL_CATEGORIES = ("Nd", "Sc", "Sm", "Pd")
_MATERIAL = r"[\p{Nd}\p{Sc}\p{Sm}\p{Pd}]"
#: A token with one of these says an amount or a sign.
MATERIAL_TOKEN = r"[$€£¥₹\d+-]"

MAP = T.ArrayType(
    T.StructType(
        [
            *[T.StructField(n, T.IntegerType()) for n in ("raw_start", "raw_end", "normalized_start", "normalized_end")],
            T.StructField("operation", T.StringType()),
        ]
    )
)


def normalize(text: Column) -> Column:
    """Every run of white space as one space, at the ends too."""
    return F.regexp_replace(text, _CHANGED, " ")


def runs(text: Column) -> Column:
    """The runs of white space and of other characters, in order."""
    return F.regexp_extract_all(text, F.lit(f"({_SPACE}+|{_OTHER}+)"), F.lit(1))


class Maps:
    """The maps of many texts at once, run by run in flat arrays; text k has the runs offsets[k] to offsets[k + 1].

    A null text has no runs."""

    def __init__(self, texts: pa.Array) -> None:
        self.null = texts.is_null()
        texts = texts.fill_null("").cast(pa.large_string())
        n = len(texts)
        at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
        data = texts.buffers()[2]
        raw = memoryview(data)[at[0] : at[-1]] if data is not None else memoryview(b"")
        lead = (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80
        starts = np.concatenate(([0], np.cumsum(lead)))[at - at[0]]  # in code points
        white = _IS_WHITE[np.minimum(np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), dtype="<u4"), len(_IS_WHITE) - 1)]
        first = np.ones(len(white), dtype=bool)
        first[1:] = white[1:] != white[:-1]
        first[starts[:-1][starts[:-1] < starts[1:]]] = True
        begin = np.flatnonzero(first)
        end = np.append(begin[1:], len(white))[: len(begin)]
        self.offsets = np.searchsorted(begin, starts)
        own = np.repeat(np.arange(n), np.diff(self.offsets))
        self.white = white[begin]
        self.line = np.concatenate(([0], np.cumsum(np.where(self.white, 1, end - begin))))  # normalised starts, texts after texts
        base = self.line[self.offsets[:-1]]
        self.raw_start, self.raw_end = begin - starts[own], end - starts[own]
        self.new_start, self.new_end = self.line[:-1] - base[own], self.line[1:] - base[own]

    def arrow(self) -> pa.Array:
        """The maps as MAP."""
        columns = [pa.array(c, pa.int32()) for c in (self.raw_start, self.raw_end, self.new_start, self.new_end)]
        columns.append(pa.array(["identity", "whitespace"]).take(pa.array(self.white.astype(np.int8))))
        runs = pa.StructArray.from_arrays(columns, [f.name for f in MAP.elementType.fields])
        return pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), runs, mask=self.null)

    def contiguous(self, raw: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Whether each map covers texts of these lengths without gaps, in order."""
        a, b = self.offsets[:-1], self.offsets[1:]
        some = a < b
        broken = np.zeros(len(self.white) + 1, dtype=np.int64)
        broken[2:] = (self.raw_start[1:] != self.raw_end[:-1]) | (self.new_start[1:] != self.new_end[:-1])
        broken[a[some] + 1] = 0  # the first run of a text follows none
        broken = np.cumsum(broken)
        out = (raw == 0) & (new == 0)
        first, last = a[some], b[some] - 1
        ends = (self.raw_start[first] == 0) & (self.new_start[first] == 0) & (self.raw_end[last] == raw[some]) & (self.new_end[last] == new[some])
        out[some] = ends & (broken[b[some]] == broken[a[some]])
        return out

    def to_raw(self, at: np.ndarray, end: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """to_raw of one position in each text; and whether it is in the text."""
        base, most = self.line[self.offsets[:-1]], self.line[self.offsets[1:]]
        inside = (at > 0) & (base + at <= most) if end else (at >= 0) & (base + at < most)
        out = np.zeros(len(at), dtype=np.int64)
        k = np.searchsorted(self.line, (base + at)[inside], side="left" if end else "right") - 1
        shifted = self.raw_start[k] + at[inside] - self.new_start[k]
        out[inside] = np.where(self.white[k], self.raw_end[k] if end else self.raw_start[k], shifted)
        return out, inside | (at == 0) if end else inside


def _slices(texts: pa.Array, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Bounds of parts of about `most` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


@F.arrow_udf(MAP)
def _map_udf(text: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([(f.name, pa.string() if f.name == "operation" else pa.int32()) for f in MAP.elementType.fields]))
    parts = [Maps(text[a:b]).arrow() for a, b in _slices(text)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def normalization_map(text: Column) -> Column:
    """One entry for each run: where it is in the raw and in the normalised text, and whether it changed. Positions are
    running sums within a text, which no array function gives without copying, so batches of texts go through Python."""
    return _map_udf(text)


_CHECKED = T.StructType([T.StructField("contiguous", T.BooleanType()), T.StructField("raw_start", T.IntegerType()), T.StructField("raw_end", T.IntegerType())])


@F.arrow_udf(_CHECKED)
def _check_udf(text: pa.Array, raw: pa.Array, new: pa.Array, start: pa.Array, end: pa.Array) -> pa.Array:
    raw, new, start, end = (pc.fill_null(c, 0).to_numpy(zero_copy_only=False) for c in (raw, new, start, end))
    names, parts = [f.name for f in _CHECKED.fields], []
    for a, b in _slices(text):
        maps = Maps(text[a:b])
        null = maps.null.to_numpy(zero_copy_only=False)
        columns = [pa.array(maps.contiguous(raw[a:b], new[a:b]), mask=null)]
        for at, is_end in ((start, False), (end, True)):
            found, inside = maps.to_raw(at[a:b].astype(np.int64), is_end)
            columns.append(pa.array(found, pa.int32(), mask=null | ~inside))
        parts.append(pa.StructArray.from_arrays(columns, names))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct(list(zip(names, (pa.bool_(), pa.int32(), pa.int32()), strict=True))))


def check_map(raw: Column, normalized: Column, start: Column, end: Column) -> Column:
    """contiguous: map_is_contiguous of a raw text's normalization_map; raw_start, raw_end: what to_raw gives with it for
    the range start to end of the normalised text. The map, larger than its text, stays with the worker that made it."""
    return _check_udf(raw, F.char_length(raw), F.char_length(normalized), start, end)


def map_is_contiguous(entries: Column, raw: Column, normalized: Column) -> Column:
    """Whether a map covers both texts without gaps, in order."""
    n = F.size(entries)
    joined = F.forall(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: (i >= n)
        | (
            (F.get(entries, i)["raw_start"] == F.get(entries, i - 1)["raw_end"])
            & (F.get(entries, i)["normalized_start"] == F.get(entries, i - 1)["normalized_end"])
        ),
    )
    first, last = F.get(entries, F.lit(0)), F.get(entries, n - 1)
    ends = (first["raw_start"] == 0) & (first["normalized_start"] == 0) & (last["raw_end"] == F.char_length(raw)) & (last["normalized_end"] == F.char_length(normalized))
    return F.when(n == 0, (F.char_length(raw) == 0) & (F.char_length(normalized) == 0)).otherwise(joined & ends)


def _entry(entries: Column, at: Column, side: str, end: bool) -> Column:
    a, b = f"{side}_start", f"{side}_end"
    inside = (lambda e: (e[a] < at) & (at <= e[b])) if end else (lambda e: (e[a] <= at) & (at < e[b]))
    return F.get(F.filter(entries, inside), F.lit(0))


def to_raw(entries: Column, at: Column, end: bool = False) -> Column:
    """Raw position of a normalised one; as a range's end if `end`. Inside a run of white space: the run's own bound.
    Null outside the text, 0 for an end at 0."""
    e = _entry(entries, at, "normalized", end)
    shifted = e["raw_start"] + (at - e["normalized_start"])
    bound = e["raw_end"] if end else e["raw_start"]
    found = F.when(e["operation"] == "whitespace", bound).otherwise(shifted)
    return F.when((at == 0) & F.lit(end), 0).otherwise(found)


def to_normalized(entries: Column, at: Column, end: bool = False) -> Column:
    """Normalised position of a raw one, as to_raw's reverse."""
    e = _entry(entries, at, "raw", end)
    shifted = e["normalized_start"] + (at - e["raw_start"])
    bound = e["normalized_end"] if end else e["normalized_start"]
    return F.when((at == 0) & F.lit(end), 0).otherwise(F.when(e["operation"] == "whitespace", bound).otherwise(shifted))


def raw_slice(raw: Column, entries: Column, start: Column, end: Column) -> Column:
    """The raw text that a range of the normalised text stands for."""
    a, b = to_raw(entries, start), to_raw(entries, end, end=True)
    return F.substring(raw, a + 1, b - a)


def has_material(text: Column) -> Column:
    return text.rlike(_MATERIAL)


def is_material(char: str) -> bool:
    return unicodedata.category(char) in MATERIAL_CATEGORIES


def _shared(a: str, b: str, i: int, j: int) -> int:
    """How many characters a from i and b from j begin with alike."""
    most, n, step = min(len(a) - i, len(b) - j), 0, 8
    while n < most:  # steps double while they agree, then halve
        step = min(step, most - n)
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
            step *= 2
        elif step == 1:
            break
        else:
            step //= 2
            most = min(most, n + 2 * step)
    return n


def _few_edits(a: str, b: str, most: int) -> int | None:
    """weighted_levenshtein if that is `most` at most: for each cost, how far it reaches on each diagonal. A change of
    cost 2 is a deletion and an insertion, so only changes of cost 1 are steps of their own."""
    goal = len(b) - len(a)
    reach = {0: _shared(a, b, 0, 0)}
    cost = 0
    while reach.get(goal, -1) < len(a):
        cost += 1
        if cost > most:
            return None
        new = {}
        for k in range(-cost, cost + 1):  # b's position less a's
            i = max(reach.get(k - 1, -1), reach.get(k + 1, -2) + 1)
            at = reach.get(k, -1)
            if at >= 0:
                i = max(i, at)
                if at < len(a) and at + k < len(b) and not (is_material(a[at]) or is_material(b[at + k])):
                    i = max(i, at + 1)
            i = min(i, len(a), len(b) - k)
            if i >= 0 and i + k >= 0:
                new[k] = i + _shared(a, b, i, i + k)
        reach = new
    return cost


def weighted_levenshtein(a: str, b: str) -> int:
    """Edit distance in code points; putting one character for another costs 2 where either is material."""
    if a == b:
        return 0
    if not a or not b:
        return len(a) + len(b)
    few = _few_edits(a, b, 4 + math.isqrt(2 * min(len(a), len(b))))
    if few is not None:
        return few
    heavy = np.array([1 + is_material(c) for c in b])
    codes = np.array([ord(c) for c in b])
    line = np.arange(len(b) + 1)
    steps = np.arange(len(b) + 1)
    for c in a:
        change = np.where(codes == ord(c), 0, 2 if is_material(c) else heavy)
        best = np.minimum(line[1:] + 1, line[:-1] + change)
        best = np.concatenate(([line[0] + 1], best))
        line = np.minimum.accumulate(best - steps) + steps  # insertions run along the row
    return int(line[-1])


def text_distance(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    return min(1.0, weighted_levenshtein(a, b) / longest) if longest else 0.0


@F.pandas_udf(T.DoubleType())
def _distance_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else text_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def plain_distance(a: Column, b: Column) -> Column:
    """text_distance of texts without material characters, by the built-in edit distance."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 0.0).otherwise(F.least(F.lit(1.0), F.levenshtein(a, b) / longest))


def distance(a: Column, b: Column) -> Column:
    """text_distance of any texts. Rows are handed to Python in batches; use plain_distance where has_material is false
    of both sides and it stays in the JVM."""
    return _distance_udf(a, b)


def material_token_difference(a: Column, b: Column) -> Column:
    """Whether a token that only one of the texts has says an amount or a sign."""
    ta, tb = F.split(a, r"\s+"), F.split(b, r"\s+")
    one = F.concat(F.array_except(ta, tb), F.array_except(tb, ta))
    return (a != b) & F.exists(one, lambda t: t.rlike(MATERIAL_TOKEN))


def group_text(rows: Column) -> Column:
    """Texts of an array of (ordinal, text) by ordinal, with spaces between and none around."""
    ordered = F.transform(F.array_sort(rows), lambda r: r["text"])
    return F.regexp_replace(F.array_join(ordered, " "), f"^{_SPACE}+|{_SPACE}+$", "")


def safe_name(name: Column) -> Column:
    """A file name of letters, digits, dots, dashes and underscores; never empty, hidden or over 80 characters."""
    bare = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+", "")
    return F.when(F.char_length(bare) > 0, F.substring(bare, 1, 80)).otherwise("document")


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
