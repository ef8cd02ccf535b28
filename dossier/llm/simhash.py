"""SimHash near-duplicates by pivot distance tables.

Of each distinct fingerprint the Hamming distances to PIVOTS reference fingerprints are computed once. Two fingerprints that differ in at most `most` bits
differ by no more than that in each of these distances, so pairs are discarded by their greatest coordinate difference, and only
survivors are verified bit by bit. Rows are sorted by one coordinate, so that each meets only those within `most` of it there.

So that not all fingerprints meet, they meet in buckets: the bits are cut into most + 2 blocks, of which two at least are equal in a pair that links, and each pair
of blocks is a key. A bucket of more than BUCKET fingerprints is dealt over parts of that size, each pair of which is a group of its own.
As components are asked for, a group compares nothing that it has connected already, and gives at most one link for each of its rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, map_batches, raw_texts, small_enough, written
from .jaccard import LOWER, SENT_IDS, components

#: Reference fingerprints.
PIVOTS = 32
#: Fingerprints of a bucket that are compared in one group; of a larger one twice as many at most meet.
BUCKET = 16_384
#: Shingles whose bits are counted at once.
COUNTED = 1 << 15


def pivots(n: int = PIVOTS) -> np.ndarray:
    """The references: multiples of the golden ratio, mixed, so that they are the same wherever they are computed."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def fingerprint(raw: bytes, size: int = 3, seed: int = 42) -> int:
    """Bits that are set in over half of the XXH64 of the text's runs of `size` words, repeats included; of all words where there are fewer; 0 without any."""
    words = raw.translate(LOWER).split()
    if not words:
        return 0
    text, m = b" ".join(words), max(len(words) - size + 1, 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, ends = np.r_[0, ends[: m - 1]].tolist(), (ends[min(size, len(words)) - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, m, COUNTED):
        hashes = np.fromiter((xxhash.xxh64_intdigest(text[s:e], seed) for s, e in zip(starts[i : i + COUNTED], ends[i : i + COUNTED], strict=True)), np.uint64)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > m, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (64 bits) and its distances to the pivots, one byte each, of each row of docs. Rows do not move."""

    def make():
        references = pivots()

        def each(batch: pa.RecordBatch):
            found = np.array([fingerprint(raw, size, seed) for raw in raw_texts(batch.column("text"))], np.uint64)
            yield {"doc_id": batch.column("doc_id"), "fp": found.view(np.int64), "distances": [row.tobytes() for row in np.bitwise_count(found[:, None] ^ references)]}

        return each

    return map_batches(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), make, f"doc_id {id_type(docs, doc_id)}, fp bigint, distances binary")


def keys(most: int) -> list[int]:
    """Masks of each pair of the most + 2 blocks of the 64 bits."""
    cuts = [64 * i // (most + 2) for i in range(most + 3)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [a | b for a, b in combinations(blocks, 2)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def linked(fp: np.ndarray, distances: np.ndarray, part: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that connect the rows as all pairs of at most `most` differing bits do; where there are two parts, as all such pairs across them do, or better."""
    across = bool(len(part)) and part.min() != part.max()
    lead = int(np.argmax(distances.max(axis=0) - distances.min(axis=0)))
    order = np.argsort(distances[:, lead], kind="stable")
    table, fps, parts = distances[order].astype(np.int16), fp[order], part[order]
    until = np.searchsorted(table[:, lead], table[:, lead] + most, side="right")
    label, out = np.arange(len(fps)), []
    for i in range(len(fps) - 1):
        near = slice(i + 1, until[i])
        apart = label[near] != label[i]
        if across:
            apart &= parts[near] != parts[i]
        left = np.flatnonzero(apart) + i + 1
        for p in range(table.shape[1]):
            if not len(left):
                break
            left = left[np.abs(table[left, p] - table[i, p]) <= most]
        left = left[np.bitwise_count(fps[left] ^ fps[i]) <= most]
        if len(left):
            met, first = np.unique(label[left], return_index=True)
            out += [(int(order[i]), int(order[j])) for j in left[first]]
            label[np.isin(label, met)] = label[i]
    return out


def _links(rows: DataFrame, kind: str, most: int) -> DataFrame:
    """a and b of the links within each group of rows (k, i, j), which come one group after another."""

    def make():
        held: list[tuple] = []
        last = None

        def out(pairs):
            return {"a": [a for a, _ in pairs], "b": [b for _, b in pairs]}

        def group():
            fp, reps, distances, part = (list(x) for x in zip(*held, strict=True))
            table = np.frombuffer(b"".join(distances), np.uint8).reshape(len(fp), -1)
            return [(reps[a], reps[b]) for a, b in linked(np.array(fp, np.int64).view(np.uint64), table, np.array(part), most)]

        def each(batch: pa.RecordBatch | None):
            nonlocal last
            pairs = []
            if batch is None:
                yield out(group() if len(held) > 1 else [])
                return
            of = list(zip(*(batch.column(c).to_pylist() for c in "kij"), strict=True))
            for key, row in zip(of, zip(*(batch.column(c).to_pylist() for c in ("fp", "rep", "distances", "part")), strict=True), strict=True):
                if key != last:
                    pairs += group() if len(held) > 1 else []
                    held.clear()
                    last = key
                held.append(row)
            yield out(pairs)

        return each

    return map_batches(rows.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j").select("k", "i", "j", "part", "fp", "rep", "distances"), make, f"a {kind}, b {kind}", tail=True)


def near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 3, seed: int = 42, most: int = 3) -> DataFrame:
    """One row for each row of docs: doc_id, fp, component_id (smallest id that links reach) and class_id (smallest id of the same fingerprint).

    Two documents link when their fingerprints differ in at most `most` bits. Exact. Null, empty and blank texts have the fingerprint 0 and link like any other;
    rows that share an id are one document for the links; null ids are left out; other columns are not read.
    """
    kind = id_type(docs, doc_id)
    found = written(fingerprints(docs.where(docs[doc_id].isNotNull()), doc_id=doc_id, text=text, size=size, seed=seed), "fingerprints")
    classes = written(found.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("distances").alias("distances")), "classes")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(mask))).alias("bits")) for n, mask in enumerate(keys(most)))))
    rows = classes.select("fp", "rep", "distances", each.alias("k"))
    large = written(rows.groupBy("k").agg(F.count("*").alias("c")).where(F.col("c") > BUCKET).select("k", F.ceil(F.col("c") / BUCKET).cast("int").alias("parts")), "large")
    rows = rows.join(F.broadcast(large) if small_enough(large, SENT_IDS) else large, "k", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    links = _links(rows.select("k", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "fp", "rep", "distances"), kind, most)
    # an id of several fingerprints holds their classes together
    several = found.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("doc_id")
    held = found.join(several, "doc_id").join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    comp = components(links.unionByName(held))
    parts = written(classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.col("rep").alias("class_id"), F.coalesce("comp", "rep").alias("component_id")), "parts")
    return found.join(F.broadcast(parts) if small_enough(parts, SENT_IDS) else parts, "fp").select("doc_id", "fp", "component_id", "class_id")
