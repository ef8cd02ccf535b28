"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, held against every window of the training texts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_type, keep_rows, map_batches, raw_texts, written

WINDOW = 10
#: Windows in one broadcast, about 100 MB in a worker; a larger benchmark is held against the texts block by block.
BLOCK_WINDOWS = 400_000
#: Bytes that are part of a word stay (A-Z in lower case), all others become blanks.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[^ ]+")


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


class Block:
    """Windows of some items: words by number, and by window length the number of the window's set of items."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}
        self.windows: dict[int, dict[bytes, int]] = {}
        #: Sets of items, each once.
        self.items: list[frozenset[str]] = []
        self.numbers: dict[frozenset[str], int] = {}
        self.size = 0

    def _number(self, items: frozenset[str]) -> int:
        if (n := self.numbers.setdefault(items, len(self.items))) == len(self.items):
            self.items.append(items)
        return n

    def add(self, item: str, words: list[bytes], window: int) -> None:
        if not words:
            return
        ids = np.fromiter((self.words.setdefault(w, len(self.words)) for w in words), np.int32, len(words))
        n = min(window, len(ids))
        at, own = self.windows.setdefault(n, {}), self._number(frozenset([item]))
        for i in range(len(ids) - n + 1):
            key = ids[i : i + n].tobytes()
            if (there := at.setdefault(key, own)) != own:
                at[key] = self._number(self.items[there] | {item})
            self.size += 1

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans of the windows that occur, and their items."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        get = self.words.get
        ids = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        known = np.concatenate(([0], np.cumsum(ids >= 0)))
        for n, windows in self.windows.items():
            if len(ids) < n:
                continue
            # only windows made of known words alone are looked up
            for i in np.flatnonzero(known[n:] - known[:-n] == n).tolist():
                if (found := windows.get(ids[i : i + n].tobytes())) is not None:
                    spans.append((i, i + n))
                    items |= self.items[found]
        return spans, items


def blocks_of(benchmark: DataFrame, item: str, text: str, window: int, most: int) -> Iterator[Block]:
    """Reads the benchmark partition by partition; no block holds more than `most` windows and one item."""
    block = Block()
    for row in benchmark.select(item, text).toLocalIterator():
        if row[0] is not None:
            block.add(str(row[0]), words_of((row[1] or "").encode()), window)
        if block.size >= most:
            yield block
            block = Block()
    yield block


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in WORD.finditer(raw.translate(FOLD))]
    keep, at = [], 0
    for a, b in spans:
        keep.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*keep, raw[at:]])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, cleaned: bool = False,
) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, items (sorted as strings), n_items, contaminated, and with `cleaned` the text without the hit spans.

    A window is `window` consecutive words of an item; an item of fewer, but not none, is one window. Windows are compared
    word by word, so there are no false hits. The windows go to the executors as one broadcast of at most `block_windows` and one item;
    a larger benchmark goes block by block: the texts are scanned and written once for each, and no task or driver holds more than the next one beside it. No shuffle.

    Null or empty texts have no words and hit nothing; null item ids are left out; items that repeat count once;
    empty benchmarks leave all documents clean; other columns of docs are not read.
    """
    spark = docs.sparkSession
    key = id_type(docs, doc_id)
    state = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    first = True
    for block, last in _in_turn(blocks_of(benchmark, item_id, item_text, window, block_windows)):
        state = _scanned(state, spark.sparkContext.broadcast(block), first, last, key, cleaned)
        state, first = state if last else written(state, "block"), False
    return state


def _in_turn(blocks: Iterator[Block]) -> Iterator[tuple[Block, bool]]:
    """Each block, and whether it is the last."""
    block = next(blocks)
    for following in blocks:
        yield block, False
        block = following
    yield block, True


def _scanned(state: DataFrame, shared, first: bool, last: bool, key: str, cleaned: bool) -> DataFrame:
    schema = f"doc_id {key}, n_words bigint, n_hit bigint, items array<string>, n_items bigint, items_sha256 string, contaminated boolean" + ", text string" * cleaned if last else f"doc_id {key}, text string, spans array<int>, items array<string>"

    def make():
        block = shared.value

        def each(batch: pa.RecordBatch):
            raws = raw_texts(batch.column("text"))
            before = [([], [])] * len(raws) if first else list(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True))
            out: dict[str, list] = {k: [] for k in ("n_words", "n_hit", "items", "n_items", "items_sha256", "contaminated", "text", "spans")}
            for raw, (old, names) in zip(raws, before, strict=True):
                words = words_of(raw)
                spans, items = block.scan(words)
                spans = merged([*spans, *zip(old[::2], old[1::2], strict=True)])
                found = sorted(items.union(names))
                out["spans"].append([x for s in spans for x in s])
                out["items"].append(found)
                out["n_words"].append(len(words))
                out["n_hit"].append(n := sum(b - a for a, b in spans))
                out["n_items"].append(len(found))
                out["items_sha256"].append(hashlib.sha256(",".join(found).encode()).hexdigest())
                out["contaminated"].append(n > 0)
                if cleaned or not last:
                    out["text"].append((without(raw, spans) if last and n else raw).decode())
            yield out | {"doc_id": batch.column("doc_id")}

        return each

    return map_batches(state, make, schema)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS
) -> DataFrame:
    """The rows of docs, all columns as they are, in which no window of the benchmark occurs. Nulls and empty tables as in decontaminate()."""
    for block, last in _in_turn(blocks_of(benchmark, item_id, item_text, window, block_windows)):
        docs = _clean_rows(docs, docs.sparkSession.sparkContext.broadcast(block), text)
        docs = docs if last else written(docs, "block")
    return docs


def _clean_rows(docs: DataFrame, shared, text: str) -> DataFrame:
    def make():
        block = shared.value
        return lambda batch: [not block.scan(words_of(raw))[0] for raw in raw_texts(batch.column(text))]

    return keep_rows(docs, make)
