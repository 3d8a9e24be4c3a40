"""Token counts by section with offset-mapped attribution.

A text is encoded once, whole. The lengths of its tokens add up to byte offsets, and the intervals of
tokens are joined with the intervals of the sections inside the task by binary search, so no table of
tokens ever exists. A token that crosses a boundary is allocated by an explicit rule:

* ``first``: to the section that holds its first byte,
* ``last``: to the section that holds its last byte,
* ``largest``: to the section that holds most of its bytes, the earlier one on a tie.

Sections are the lines of a text, each with the line break that ends it, or the array of intervals
in a given column (half-open, in characters, not overlapping); tokens outside all of them are
reported under section -1, so the counts of a text always add up to the tokens of the whole text.

Defined results: a null or empty text has one empty section 0 without tokens; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored or carried.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, sliced

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("first", "last", "largest")
_encoders: dict[tuple[int, str], tuple[object, np.ndarray]] = {}


def encoder(ranks: bytes, pattern: str = PATTERN):
    """The tokenizer and the byte length of each of its ids, built once in a worker."""
    key = (hash(ranks), pattern)
    if key not in _encoders:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        lengths = np.zeros(max(table.values()) + 1, np.int64)
        lengths[list(table.values())] = [len(x) for x in table]
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}), lengths
    return _encoders[key]


def attribute(ends: np.ndarray, begins: np.ndarray, stops: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses a boundary); -1 is outside. ``ends`` are token end offsets.

    Sections are half-open, sorted and disjoint.
    """
    starts = np.concatenate([[0], ends[:-1]])[: len(ends)].astype(np.int64)

    def holder(at: np.ndarray) -> np.ndarray:
        k = np.searchsorted(begins, at, side="right") - 1
        return np.where((k >= 0) & (at < stops[np.maximum(k, 0)]), k, -1) if len(begins) else np.full(len(at), -1)

    first, last = holder(starts), holder(ends - 1)
    if rule == "first":
        return first, first != last
    if rule == "last":
        return last, first != last
    out = first.copy()
    for t in np.flatnonzero(first != last):  # a token of a few bytes spans a few sections at most
        a, b = starts[t], ends[t]
        lo, hi = np.searchsorted(stops, a, side="right"), np.searchsorted(begins, b, side="left")
        shares = np.minimum(stops[lo:hi], b) - np.maximum(begins[lo:hi], a)
        rest = (b - a) - shares.sum()
        out[t] = lo + int(np.argmax(shares)) if len(shares) and shares.max() >= rest else -1
    return out, first != last


def _count(ranks: bytes, pattern: str, rule: str, given: bool):
    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tokenizer, lengths = encoder(ranks, pattern)
        data, offsets = bytes_of(batch.column("text"))
        texts = batch.column("text").to_pylist()
        sections = batch.column("sections").to_pylist() if given else None
        owner, number, chars, n_tokens, n_crossing = [], [], [], [], []
        for d, text in enumerate(texts):
            raw = data[offsets[d] : offsets[d + 1]]
            ends = np.cumsum(lengths[np.asarray(tokenizer.encode_ordinary(text), np.int64)]) if text else np.zeros(0, np.int64)
            at_char = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
            if given:
                wanted = sorted((s["begin"], s["end"]) for s in sections[d] or [] if s["begin"] is not None and s["end"] is not None)
                clip = lambda x: at_char[np.clip(np.array(x, np.int64), 0, len(at_char) - 1)]  # noqa: B023, E731
                begins, stops = clip([b for b, _ in wanted]), clip([e for _, e in wanted])
            else:
                breaks = np.flatnonzero(raw == 10) + 1
                begins = np.concatenate([[0], breaks[breaks < len(raw)]])
                stops = np.append(begins[1:], len(raw))
            section, crossing = attribute(ends, begins, stops, rule)
            k = len(begins)
            counts = np.bincount(section + 1, minlength=k + 1)
            crossed = np.bincount(section + 1, weights=crossing, minlength=k + 1).astype(np.int64)
            skip = 0 if counts[0] else 1  # the part outside only where it has tokens
            sizes = np.concatenate([[0], np.searchsorted(at_char, stops) - np.searchsorted(at_char, begins)])
            owner.append(np.full(k + 1 - skip, d))
            number.append(np.arange(-1 + skip, k))
            chars.append(sizes[skip:])
            n_tokens.append(counts[skip:])
            n_crossing.append(crossed[skip:])
        join = lambda parts: pa.array(np.concatenate(parts).astype(np.int64))
        yield pa.record_batch(
            {"row": batch.column("row").take(join(owner)), "section": join(number), "n_chars": join(chars), "n_tokens": join(n_tokens), "n_crossing": join(n_crossing)}
        )

    return fn


def count_tokens(
    docs: DataFrame, sections: str | None = None, rule: str = "first", ranks: str = RANKS, pattern: str = PATTERN, carry: list[str] | None = None
) -> DataFrame:
    """doc_id (or ``carry``), section, n_chars, n_tokens, n_crossing: one row for each section of each text.

    ``sections`` names a column array<struct<begin, end>>; without it the lines are the sections.
    The rank file, a megabyte, is read by the driver and goes to the tasks with the function.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(ranks, "rb") as file:
        content = file.read()
    columns = ["text", F.struct(*(carry or ["doc_id"])).alias("row"), *([F.col(sections).alias("sections")] if sections else [])]
    inner = docs.select(*columns)
    zero = F.lit(0).cast("long")
    shape = inner.select("row", *(zero.alias(c) for c in ("section", "n_chars", "n_tokens", "n_crossing"))).schema
    return inner.mapInArrow(sliced(_count(content, pattern, rule, bool(sections))), shape).select("row.*", *shape.names[1:])
