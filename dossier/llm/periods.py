"""Periodic runs of words by an online sparse diagonal count.

A diagonal is a lag with the words that equal the one so far before them; where its matches end after sufficient length, it is a run. Of the
earlier occurrences of a word only those are looked at that a run can start from: a run of period q matches over at least
max(LEAST - q, (TIMES - 1) * q) words, so for g = GRAM, 2 * GRAM, 4 * GRAM ... the g words from there on must occur earlier in the same text, and for
a period in (g / 2, g] (up to g for the first g) the lag is that of the nearest such occurrence: a nearer one would be inside the run and a smaller period of it.
So each word has one lag for each g at the most, and a text of n words takes O(n log^2 n), however often its words repeat. Words that go on with the
lag of the word before lengthen its diagonal; where the lag changes, the diagonal ends and is a run or none.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, map_batches, raw_texts

#: Least length of a run in words, and in periods.
LEAST, TIMES = 24, 3
#: Words that any run matches over.
GRAM = min(max(LEAST - q, (TIMES - 1) * q) for q in range(1, LEAST))
#: Bytes of a text whose words are apart in memory at once.
PIECE = 1 << 20
_SPACE = b" \t\n\x0b\x0c\r"


def pieces(raw: bytes, size: int):
    """The text in parts that end between words."""
    at = 0
    while at < len(raw):
        end = min(at + size, len(raw))
        while end < len(raw) and raw[end] not in _SPACE:
            end += 1
        yield raw[at:end]
        at = end


def numbered(raw: bytes, size: int = PIECE) -> tuple[np.ndarray, list[bytes]]:
    """Each word's number, and the distinct words in order of number."""
    seen: dict[bytes, int] = defaultdict(count().__next__)
    parts = [np.fromiter(map(seen.__getitem__, words := piece.split()), np.int64, len(words)) for piece in pieces(raw, size)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), list(seen)


def _repeated(at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ascending places with keys, those whose key others have too: places, numbers by key, and the distance to the place before with the same key (0: none)."""
    order = np.argsort(keys, kind="stable")
    ordered, places = keys[order], at[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    last = np.ones(len(keys), bool)
    last[:-1] = new[1:]
    several = ~(new & last)
    lag = np.zeros(len(keys), np.int64)
    lag[1:] = np.where(new[1:], 0, places[1:] - places[:-1])
    order, number, lag = order[several], np.cumsum(new)[several], lag[several]
    back = np.argsort(order)
    return at[order[back]], number[back], lag[back]


def runs(words: np.ndarray) -> np.ndarray:
    """start, length and period of each run, by start and period. Texts may follow each other if they have no number in common."""
    found = [np.zeros((0, 3), np.int64)]
    at, number, lag = _repeated(np.arange(len(words)), words)
    size = 1
    while len(at):
        if size >= GRAM:
            found.append(_ended(words, at, lag, size))
        # two of these that follow each other are one of twice the words; at first up to GRAM
        step = size if size * 2 <= GRAM or size >= GRAM else GRAM - size
        follows = np.searchsorted(at, at + step)
        both = follows < len(at)
        both[both] = at[follows[both]] == at[both] + step
        at, number, lag = _repeated(at[both], number[both] << 32 | number[follows[both]])
        size += step
    out = np.concatenate(found)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _ended(words: np.ndarray, at: np.ndarray, lag: np.ndarray, size: int) -> np.ndarray:
    """The runs among the diagonals of places whose `size` words occurred before, at periods up to size."""
    near = (lag > (size // 2 if size > GRAM else 0)) & (lag <= size)
    at, lag = at[near], lag[near]
    if not len(at):
        return np.zeros((0, 3), np.int64)
    new = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(lag) != 0)])
    first, last, q = at[new], at[np.r_[new[1:], len(at)] - 1], lag[new]
    start, end = first - q, last + size
    long = end - start >= np.maximum(LEAST, TIMES * q)
    start, end, q = start[long], end[long], q[long]
    # one that goes on at either side is part of a run of smaller period
    whole = ((start == 0) | (words[start - 1] != words[start - 1 + q])) & ((end == len(words)) | (words[np.minimum(end, len(words) - 1)] != words[end - q]))
    return np.stack([start, end - start, q], axis=1)[whole]


def kept(n: int, found: np.ndarray) -> np.ndarray:
    """Whether each of n words stays: it is in no run, or among the first period of all it is in."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def periodic_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, runs (start, length, period; by start, then period) and collapsed, the kept words joined by one space.

    Words are runs without white space, numbered from 0. A run is a stretch of the smallest period q, of at least max(24, 3 q) words, that neither neighbour
    extends; its words after the first q are not kept. Exact. Null, empty and blank texts have no words and no runs; null and repeated ids keep their rows; texts of any
    length are read whole (a few integers a word); other columns are not read. Rows do not move.
    """

    def each(batch: pa.RecordBatch):
        texts = [numbered(raw) for raw in raw_texts(batch.column("text"))]
        # the texts of a batch are searched at once, their words numbered apart
        sizes, bases = [len(ids) for ids, _ in texts], np.cumsum([0] + [len(names) for _, names in texts])
        starts = np.cumsum([0, *sizes])
        words = np.concatenate([ids + base for (ids, _), base in zip(texts, bases, strict=False)])
        found = runs(words)
        cut = np.searchsorted(found[:, 0], starts)
        spans, collapsed = [], []
        for i, (ids, names) in enumerate(texts):
            own = found[cut[i] : cut[i + 1]] - [starts[i], 0, 0]
            left = ids[kept(len(ids), own)] if len(own) else ids
            spans.append([{"start": s, "length": n, "period": q} for s, n, q in own.tolist()])
            collapsed.append(b" ".join(map(names.__getitem__, left.tolist())))
        yield {"doc_id": batch.column("doc_id"), "n_words": sizes, "runs": spans, "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string())}

    kind = f"doc_id {id_type(docs, doc_id)}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return map_batches(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), lambda: each, kind)


def digests(found: DataFrame) -> DataFrame:
    """Of the rows of periodic_runs: n_runs, the run of the greatest length / period (the first of equals) and hashes of all runs and of the kept text."""
    # by start and then period, so that only a greater one replaces the first
    best = F.aggregate("runs", F.element_at("runs", 1), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    out = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return out.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
