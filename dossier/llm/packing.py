"""Packing documents into sequences of tokens: harmonic classes, and best fit decreasing with a segment tree."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_type, map_batches, texts_of, written
from .tokens import WordIds, remembered

CAPACITY, END = 2048, 1
#: Tokens that a piece may fall short of its class's share of a sequence; beyond, it is cut.
SLACK = 4
#: Ranks are counted apart in shares of the pieces: at least and at most so many, and between these one for SHARE_PIECES.
SHARES, SHARE_PIECES = (64, 4096), 20_000
#: Bytes of the pieces that a worker remembers for best fit decreasing, which keeps nothing else but a window.
BEST_FIT_BYTES = 96 << 20
#: Best fit decreasing looks at so many tokens at once.
WINDOW_TOKENS = 4_000_000


def cuts(length: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[int]:
    """Lengths of the pieces of a document: each fills 1/k of a sequence for some k, short of it by `slack` tokens at most.

    What is left after the largest share that fits is cut in turn; as 1/k - 1/(k+1) shrinks with the square of k, few pieces arise.
    """
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if capacity // k - rest <= slack:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= capacity // (k + 1)
    return out


def pieces_of(docs: DataFrame, path: str, doc_id: str, text: str, capacity: int, slack: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and a hash of the text for each piece."""

    def make():
        words = remembered(WordIds, path)

        def each(batch: pa.RecordBatch):
            out: dict[str, list] = {k: [] for k in ("row", "start", "length", "ids_crc32", "doc_tokens", "own")}
            for row, raw in enumerate(words.bytes_of(texts_of(batch.column("text")))):
                raw += END.to_bytes(4, "little")
                view, at, n, own = memoryview(raw), 0, len(raw) // 4, zlib.crc32(raw)
                for size in cuts(n, capacity, slack):
                    for name, x in (("row", row), ("start", at), ("length", size), ("ids_crc32", zlib.crc32(view[4 * at : 4 * (at + size)])), ("doc_tokens", n), ("own", own)):
                        out[name].append(x)
                    at += size
            yield {"doc_id": batch.column("doc_id").take(pa.array(out.pop("row"), pa.int64())), **out}

        return each

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return map_batches(rows, make, f"doc_id {id_type(docs, doc_id)}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, own bigint")


def first_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """Sequence and offset of each length, longest first; for the few pieces that fill no sequence of their class."""
    used: list[int] = []
    out: dict[int, tuple[int, int]] = {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        bin_ = next((b for b, n in enumerate(used) if n + lengths[i] <= capacity), len(used))
        if bin_ == len(used):
            used.append(0)
        out[i] = (bin_, used[bin_])
        used[bin_] += lengths[i]
    return [out[i] for i in range(len(lengths))]


def harmonic_pack(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, slack: int = SLACK, shares: tuple[int, int] = SHARES) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids, its end id last, are cut into pieces that each fill almost exactly 1/k of a sequence; class k's sequences take
    k pieces each, whatever they are. Ranks within a class are counted apart in shares of the pieces and added up from a
    table of shares x classes counts, so no class meets in one task. The last pieces of each class, fewer than k and so a
    number that the capacity alone bounds, fill common sequences by first fit. Only pieces' numbers are shuffled, never ids.

    Null and empty texts are the end id alone. Ids may be null or repeat: each row of docs is packed. An empty table gives no rows.
    """
    found = pieces_of(docs, path, doc_id, text, capacity, slack)
    # a rank must not depend on where a row was read, or a lost executor's repeated work would deal pieces twice
    dealt = written(found.withColumn("k", F.expr(f"int({capacity} div length)")), "pieces")
    n = min(max(dealt.count() // SHARE_PIECES, shares[0]), shares[1])
    dealt = dealt.withColumn("share", F.pmod(F.xxhash64("doc_id", "start", "own"), F.lit(n)).cast("int"))
    by = Window.partitionBy("k", "share").orderBy("doc_id", "start", "own", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(by) - 1)
    counts = dealt.groupBy("k", "share").agg(F.count("*").alias("n"))
    before = counts.select("k", "share", (F.sum("n").over(Window.partitionBy("k").orderBy("share")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("k")).alias("all"))
    # at most shares x classes rows
    placed = written(ranked.join(F.broadcast(before), ["k", "share"]).withColumn("rank", F.col("rank") + F.col("before")).withColumn("bin", F.expr("rank div k")).withColumn("whole", F.expr("(bin + 1) * k <= all")), "ranks")
    within = Window.partitionBy("k", "bin").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    full = placed.where("whole").withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)))
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    # sequence ids: bin and class for full sequences, negative for the common ones
    full = full.select(*columns, (F.col("bin") * (capacity + 1) + F.col("k")).alias("sequence_id"), "offset")

    def fit_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if read := list(batches):
            table = pa.Table.from_batches(read)
            places = first_fit(table.column("length").to_pylist(), capacity)
            table = table.append_column("sequence_id", pa.array([-1 - b for b, _ in places], pa.int64())).append_column("offset", pa.array([o for _, o in places], pa.int64()))
            yield from table.combine_chunks().to_batches()

    rest = placed.where("NOT whole").select(*columns).repartition(1).sortWithinPartitions(*columns)
    rest = rest.mapInArrow(fit_rest, full.schema)
    return full.unionByName(rest)


class FreeSpace:
    """Segment tree over capacities: how many open sequences have so much space left, and which."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, space: int, bin_: int) -> None:
        self.open[space].append(bin_)
        self._count(space, 1)

    def _count(self, space: int, n: int) -> None:
        i = space + self.size
        while i:
            self.tree[i] += n
            i >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out the sequence with the least space that is at least `need`, and that space."""
        i = need + self.size
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        space = i - self.size
        self._count(space, -1)
        return self.open[space].pop(), space


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices of the lengths by sequence, longest first; ties by index."""
    free, bins = FreeSpace(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        if (found := free.tightest(lengths[i])) is None:
            found = (len(bins), capacity)
            bins.append([])
        bin_, space = found
        bins[bin_].append(i)
        if space > lengths[i]:
            free.add(space - lengths[i], bin_)
    return bins


def best_fit_pack(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, pad: int = 0, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """Packed id matrix: a row for each sequence with sequence_id (a hash of what is in it), input_ids (capacity unsigned 32-bit little-endian ids, padded with `pad`),
    n_tokens, doc_ids, starts (each segment's place in its document), cu_seqlens (0 and the ends of the segments) and position_ids
    (unsigned 32-bit, from 0 in each segment; padding too).

    Each document ends in the end id; one longer than `capacity` is cut into full sequences and a rest, without loss.
    Each task packs what it reads, `window_tokens` at a time, by best fit decreasing: a segment tree over the free spaces finds the
    fullest sequence that still takes a segment. No shuffle, bounded memory; a lost task packs the same again.

    Null and empty texts are the end id alone. Ids may be null or repeat. An empty table gives no rows.
    """
    key = id_type(docs, doc_id)
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))

    def make():
        words = remembered(WordIds, path, BEST_FIT_BYTES)
        held: list[tuple[object, int, bytes]] = []
        size = 0

        def flush():
            nonlocal held, size
            out: dict[str, list] = {k: [] for k in ("sequence_id", "input_ids", "n_tokens", "doc_ids", "starts", "cu_seqlens", "position_ids")}
            for members in best_fit([len(raw) // 4 for _, _, raw in held], capacity):
                raw = b"".join(held[i][2] for i in members)
                sizes = [len(held[i][2]) // 4 for i in members]
                names = repr([held[i][:2] for i in members]).encode()
                out["sequence_id"].append(xxhash.xxh64_intdigest(names + raw) >> 1)
                out["input_ids"].append(raw + np.full(capacity - len(raw) // 4, pad, "<u4").tobytes())
                out["n_tokens"].append(len(raw) // 4)
                out["doc_ids"].append([held[i][0] for i in members])
                out["starts"].append([held[i][1] for i in members])
                out["cu_seqlens"].append([0, *np.cumsum(sizes).tolist()])
                out["position_ids"].append(np.concatenate([np.arange(n, dtype="<u4") for n in [*sizes, capacity - len(raw) // 4]]).tobytes())
            held, size = [], 0
            return out

        def each(batch: pa.RecordBatch | None):
            nonlocal size
            if batch is None:
                if held:
                    yield flush()
                return
            for who, raw in zip(batch.column("doc_id").to_pylist(), words.bytes_of(texts_of(batch.column("text"))), strict=True):
                raw += END.to_bytes(4, "little")
                for at in range(0, len(raw), 4 * capacity):
                    held.append((who, at // 4, raw[at : at + 4 * capacity]))
                size += len(raw) // 4
                if size >= window_tokens:
                    yield flush()

        return each

    return map_batches(rows, make, f"sequence_id bigint, input_ids binary, n_tokens bigint, doc_ids array<{key}>, starts array<bigint>, cu_seqlens array<bigint>, position_ids binary", tail=True)
