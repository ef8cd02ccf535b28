"""N-gram Jaccard join by a grouped prefix join.

Order: shingles whose rarest word is rare come first, so that a document's prefix holds what it shares with few others. Documents of equal
sets are one class; classes of equal prefix and size are one group. Groups that share a prefix shingle are candidates.
Beside its prefix a document carries a parity bitmap of its set: two bitmaps differ in no more bits than the sets in shingles, so that
the join itself leaves out what differs in too many. Within what is already connected nothing more is compared, as only components are asked for:

1. members of a group against its leader; those that do not link become groups of their own;
2. groups of a shingle against a few of them, its centres;
3. all pairs of groups of a shingle that are still in different components, in blocks; leaders first, and members only of those
   pairs of groups whose leaders differ by no more than a link may and their groups' radii together. Where a shingle has many groups
   outside of its largest component (copies that nearly link), rows carry a wider bitmap, and the shingles before theirs, so that a pair is listed at its first few common ones only.

Every pair that links shares a prefix shingle, so step 3 finds whatever the first two left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_type, map_batches, raw_texts, small_enough, written

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Word counts are kept in 2**SLOT_BITS slots, whatever the corpus.
SLOT_BITS = 17
#: Centres of a shingle in step 2, and groups of a shingle that are compared in one block of step 3.
CENTRES, BLOCK = 3, 256
#: Prefixes are so much longer than one common shingle takes that documents which link share so many in them.
SHARED = 4
#: Ids that are sent to all tasks at most; more are joined.
SENT_IDS = 500_000
#: Words of 64 bits in a bitmap.
BITMAP = 4
BITS = [f"b{i}" for i in range(BITMAP)]
#: Groups of a shingle outside of its largest component from which on its rows carry the wider bitmap and as many earlier shingles.
MANY, WIDE, EARLIER = 8, 16, 12
WIDE_BITS = [f"w{i}" for i in range(WIDE)]
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(raw: bytes) -> np.ndarray:
    words = raw.translate(LOWER).split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words, or of all words where there are fewer; in order of the text."""
    if not len(h):
        return h
    m = min(size, len(h))
    out = np.full(len(h) - m + 1, m, np.uint64)
    for i in range(m):
        out = (out ^ h[i : len(h) - m + 1 + i]) * _MIX
        out ^= out >> np.uint64(29)
    out *= _MIX2
    return out ^ out >> np.uint64(32)


def rarest(levels: np.ndarray, h: np.ndarray, size: int) -> np.ndarray:
    """For each shingle the level of its rarest word."""
    m = min(size, len(h))
    each = levels[h >> np.uint64(64 - SLOT_BITS)]
    out = each[: len(h) - m + 1]
    for i in range(1, m):
        out = np.minimum(out, each[i : len(h) - m + 1 + i])
    return out


def bitmap(s: np.ndarray, words: int = BITMAP) -> np.ndarray:
    """For each of 64 * words bits whether an odd number of the set's shingles fall on it."""
    odd = np.bincount((s % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def differing(a: str, b: str, bits: list[str] = BITS) -> Column:
    """Bits in which the bitmaps of rows a and b differ: a lower bound of the shingles that one of their sets has alone."""
    return sum((F.bit_count(F.col(f"{a}.{x}").bitwiseXOR(F.col(f"{b}.{x}"))) for x in bits), F.lit(0))


def components(edges: DataFrame) -> DataFrame:
    """node and comp, the smallest node it reaches, for all nodes of edges (a, b): large and small stars in turn, until nothing changes."""
    state = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = lambda: state.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
    seen = mark()
    while True:
        both = state.select("a", "b").unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        state = written(small, "edges")
        last, seen = seen, mark()
        if seen == last:
            break
    return state.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def needed(n: int, num: int, den: int) -> int:
    """Shingles that the prefixes of two documents which link share at least, if the smaller has n."""
    return min(SHARED, -(-num * n // den))


class Join:
    def __init__(self, docs: DataFrame, doc_id: str, text: str, size: int, num: int, den: int) -> None:
        self.spark = docs.sparkSession
        self.key = id_type(docs, doc_id)
        self.docs = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
        self.size, self.num, self.den = size, num, den

    def read(self) -> None:
        """Of each document its number of shingles and its set's hash, and the word counts of the corpus by slot."""
        size = self.size

        def make():
            slots = np.zeros(1 << SLOT_BITS, np.int64)

            def each(batch: pa.RecordBatch | None):
                if batch is None:
                    used = np.flatnonzero(slots)
                    none = pa.nulls(len(used))
                    yield {"doc_id": none, "n": none, "own": none, "slot": pa.array(used), "hits": pa.array(slots[used])}
                    return
                n, own, words = [], [], []
                for raw in raw_texts(batch.column("text")):
                    words.append(h := word_hashes(raw))
                    s = np.unique(shingles(h, size))
                    n.append(len(s))
                    own.append(xxhash.xxh3_128_hexdigest(s.tobytes()))
                used = (np.concatenate(words) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
                np.add(slots, np.bincount(used, minlength=len(slots)), out=slots)
                none = pa.nulls(len(n))
                yield {"doc_id": batch.column("doc_id"), "n": n, "own": own, "slot": none, "hits": none}

            return each

        found = written(map_batches(self.docs, make, f"doc_id {self.key}, n bigint, own string, slot bigint, hits bigint", tail=True), "shingles")
        self.rows = found.where("slot IS NULL").select("doc_id", "n", "own")
        counts = found.where("slot IS NOT NULL").groupBy("slot").agg(F.sum("hits").alias("hits")).toPandas()  # 2**SLOT_BITS rows at most
        slots = np.ones(1 << SLOT_BITS)
        slots[counts["slot"].to_numpy(np.int64)] = counts["hits"].to_numpy(np.float64)
        # in quarters of a doubling, so that a passage of a few hundred documents stands out among rare words
        self.levels = np.clip(4 * np.log2(np.maximum(slots, 1) / max(np.median(slots) / 8, 1)), 0, 127).astype(np.int8)
        # documents of equal sets are one class, known by its smallest id
        self.classes = written(self.rows.where("n > 0").groupBy("own", "n").agg(F.min("doc_id").alias("rep")), "classes")

    def prefixes(self) -> DataFrame:
        """Of each class its number of shingles and its prefix, rarest first: so long that two which link share needed() shingles in it."""
        levels, size, num, den = self.spark.sparkContext.broadcast(self.levels), self.size, self.num, self.den

        def make():
            def each(batch: pa.RecordBatch):
                out: dict[str, list] = {k: [] for k in ("row", "own", "n", "prefix", "gid", *BITS)}
                for row, raw in enumerate(raw_texts(batch.column("text"))):
                    if not len(h := word_hashes(raw)):
                        continue
                    s, at = np.unique(shingles(h, size), return_index=True)
                    level = rarest(levels.value, h, size)[at]
                    prefix = s[np.lexsort((s, level))[: len(s) - (num * len(s) + den - 1) // den + needed(len(s), num, den)]]
                    out["row"].append(row)
                    out["own"].append(xxhash.xxh3_128_hexdigest(s.tobytes()))
                    out["n"].append(len(s))
                    out["prefix"].append(prefix.view(np.int64))
                    for name, word in zip(BITS, bitmap(s).tolist(), strict=True):
                        out[name].append(word)
                    out["gid"].append(xxhash.xxh3_128_hexdigest(len(s).to_bytes(8, "little") + prefix.tobytes()))
                yield {"doc_id": batch.column("doc_id").take(pa.array(out.pop("row"), pa.int64())), **out}

            return each

        found = map_batches(self.docs, make, f"doc_id {self.key}, own string, n bigint, prefix array<bigint>, gid string, " + ", ".join(f"{x} bigint" for x in BITS))
        # documents that another stands for; few, so that the prefixes need not move
        others = written(self.rows.join(self.classes, ["own", "n"]).where("doc_id <> rep").select("doc_id", "own").distinct(), "others")
        return found.join(F.broadcast(others) if small_enough(others, SENT_IDS) else others, ["doc_id", "own"], "left_anti").select("doc_id", "n", "gid", "prefix", *BITS)

    def sets_of(self, pairs: DataFrame, name: str) -> DataFrame:
        """The sets of the documents of the pairs."""
        ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"{name}-ids")
        chosen = self.docs.join(F.broadcast(ids) if small_enough(ids, SENT_IDS) else ids, "doc_id", "left_semi")
        size = self.size

        def each(batch: pa.RecordBatch):
            yield {"doc_id": batch.column("doc_id"), "shingles": [np.unique(shingles(word_hashes(raw), size)).tobytes() for raw in raw_texts(batch.column("text"))]}

        return written(map_batches(chosen, lambda: each, f"doc_id {self.key}, shingles binary"), f"{name}-sets")

    def compared(self, pairs: DataFrame, name: str) -> DataFrame:
        """a, b, inter and whole (sizes of intersection and union) of each pair."""
        pairs = written(pairs.select("a", "b").distinct(), f"{name}-pairs")
        sets = self.sets_of(pairs, name)
        left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
        right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))

        def each(batch: pa.RecordBatch):
            inter, whole = [], []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                inter.append(both)
                whole.append((len(x) + len(y)) // 8 - both)
            yield {"a": batch.column("a"), "b": batch.column("b"), "inter": inter, "whole": whole}

        joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
        return written(map_batches(joined, lambda: each, f"a {self.key}, b {self.key}, inter bigint, whole bigint"), name)

    def links(self, compared: DataFrame) -> DataFrame:
        return compared.where(F.col("inter") * self.den >= F.col("whole") * self.num).select("a", "b")

    def may_link(self, a: str, b: str) -> Column:
        """Of rows of one shingle: whether sizes leave room for a link, and whether it may be among the first SHARED common shingles of one.

        If two sets of n and m link they have o = ceil(t (n + m) / (1 + t)) shingles in common, so that in each at most n - o others precede the first SHARED of them.
        """
        na, nb, pa_, pb = (F.col(x) for x in (f"{a}.n", f"{b}.n", f"{a}.pos", f"{b}.pos"))
        return (F.least(na, nb) * self.den >= F.greatest(na, nb) * self.num) & (pa_ < na - self.common(a, b) + SHARED) & (pb < nb - self.common(a, b) + SHARED)

    def common(self, a: str, b: str) -> Column:
        return F.ceil((F.col(f"{a}.n") + F.col(f"{b}.n")) * self.num / (self.num + self.den))

    def apart(self, a: str, b: str) -> Column:
        """Shingles that one of two sets which link has alone, at most."""
        return F.col(f"{a}.n") + F.col(f"{b}.n") - 2 * self.common(a, b)

    def paired(self, rows: DataFrame) -> DataFrame:
        """a, b of the pairs of groups (columns l and r of the same shingle) that share SHARED such shingles, or as many as a link of small sets takes."""
        pairs = rows.select(F.least("l.g", "r.g").alias("a"), F.greatest("l.g", "r.g").alias("b"), (F.col("l.n") + F.col("r.n")).alias("n"))
        counted = pairs.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("n").alias("n"))
        return counted.where(F.col("c") >= F.least(F.lit(SHARED), F.ceil(F.col("n") * self.num / (self.num + self.den)))).select("a", "b")

    def run(self) -> DataFrame:
        """One row for each document: doc_id, n_shingles, component_id, class_id."""
        self.read()
        # ids whose rows differ
        if not self.rows.groupBy("doc_id").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high").isEmpty():
            return self._by_class()
        prefixes = self.indexed = written(self.prefixes(), "prefixes")
        groups = prefixes.groupBy("gid").agg(F.min("doc_id").alias("lead"), F.count("*").alias("members")).where("members > 1")
        members = written(prefixes.join(groups, "gid").select("doc_id", "n", "lead", *BITS), "groups")
        # 1. members against their leaders; those that do not link are groups of their own
        strays = members.where("doc_id <> lead")
        compared = self.compared(strays.select(F.col("lead").alias("a"), F.col("doc_id").alias("b")), "inside")
        edges = self.links(compared)
        within = written(strays.join(edges.select(F.col("a").alias("lead"), F.col("b").alias("doc_id")), ["lead", "doc_id"], "left_semi"), "within")
        radii = written(compared.join(edges, ["a", "b"], "left_semi").groupBy("a").agg(F.max(F.col("whole") - F.col("inter")).alias("radius")).withColumnRenamed("a", "doc_id"), "radii")
        sent = lambda df: F.broadcast(df) if small_enough(df, SENT_IDS) else df
        leaders = prefixes.join(sent(within.select("doc_id")), "doc_id", "left_anti").join(sent(radii), "doc_id", "left")
        shared = self._shared(leaders.select(F.posexplode("prefix").alias("pos", "token"), F.col("doc_id").alias("g"), "n", F.coalesce("radius", F.lit(0)).alias("radius"), *BITS))
        # 2. centres; step 3 has what this leaves
        rows = shared.withColumn("comp", F.col("g"))
        centre = lambda salt: F.min_by(F.struct("g", "n", "pos", *BITS), F.struct(F.xxhash64("g", F.lit(salt), "token") if salt else F.lit(0), F.col("g")))
        centres = rows.groupBy("token").agg(F.array_distinct(F.array(*map(centre, range(CENTRES)))).alias("cs")).select("token", F.explode("cs").alias("c")).select("token", "c.*")
        near = (F.col("l.g") != F.col("r.g")) & self.may_link("l", "r") & (differing("l", "r") <= self.apart("l", "r"))
        edges = edges.unionByName(self.links(self.compared(self.paired(centres.alias("l").join(rows.alias("r"), "token").where(near)), "centres")))
        comp = components(edges)
        # 3. what is left
        pairs = written(self.paired(self._left_over(self._with_comp(shared, comp))), "left-over")
        if not pairs.isEmpty():
            compared = self.compared(pairs, "leaders")
            edges = edges.unionByName(self.links(compared))
            edges = edges.unionByName(self.links(self.compared(self._room(compared, members, within, radii), "members")))
            comp = components(edges)
        out = self.rows.join(self.classes, ["own", "n"], "left").join(comp.select(F.col("node").alias("rep"), "comp"), "rep", "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep", "doc_id").alias("component_id"), F.coalesce("rep", "doc_id").alias("class_id"))

    def _by_class(self) -> DataFrame:
        """As run(), where an id has rows of several sets: classes are joined, by their sets' hashes in place of ids; then an id holds its classes together."""
        size = self.size

        def each(batch: pa.RecordBatch):
            sets = [np.unique(shingles(word_hashes(raw), size)) for raw in raw_texts(batch.column("text"))]
            some = [i for i, s in enumerate(sets) if len(s)]
            yield {"own": [xxhash.xxh3_128_hexdigest(sets[i].tobytes()) for i in some], "text": batch.column("text").take(pa.array(some, pa.int64()))}

        texts = written(map_batches(self.docs, lambda: each, "own string, text string").dropDuplicates(["own"]), "class-texts")
        parts = Join(texts, "own", "text", size, self.num, self.den).run().select(F.col("doc_id").alias("own"), F.col("component_id").alias("part"))
        held = written(self.rows.where("n > 0").join(parts, "own").select("doc_id", "part").distinct(), "held")
        comp = components(held.join(held.groupBy("doc_id").agg(F.min("part").alias("a")), "doc_id").select("a", F.col("part").alias("b")))
        held = held.join(comp.withColumnRenamed("node", "part"), "part", "left").select("doc_id", F.coalesce("comp", "part").alias("comp")).distinct()
        ids = held.join(held.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "comp").select("doc_id", "component_id")
        out = self.rows.join(self.classes, ["own", "n"], "left").join(ids, "doc_id", "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("rep", "doc_id").alias("class_id"))

    def _shared(self, index: DataFrame) -> DataFrame:
        """Rows of the index whose shingle several groups have. Rows are counted before they meet, and the join may be split where a shingle has many."""
        several = index.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
        return written(index.join(several.hint("merge"), "token").select("token", "g", "n", "pos", "radius", *BITS), "shared")

    def _with_comp(self, shared: DataFrame, comp: DataFrame) -> DataFrame:
        return shared.join(comp.select(F.col("node").alias("g"), "comp"), "g", "left").withColumn("comp", F.coalesce("comp", "g"))

    def _left_over(self, rows: DataFrame) -> DataFrame:
        """Rows l and r of one shingle in different components, whose sets or groups may link. The shingle's largest component meets the others only.

        A shingle of many rows is split into blocks: each row is in one, and only those outside of the largest component are sent to all of them.
        With at most MANY of these a row meets so many others at most; the rest, whose pairs grow with the square of a shingle's groups, are looked at more closely.
        """
        sizes = rows.groupBy("token", "comp").agg(F.count("*").alias("c"))
        tokens = sizes.groupBy("token").agg(F.sum("c").alias("c"), F.count("*").alias("comps"), F.max(F.struct("c", "comp")).alias("main")).where("comps > 1")
        tokens = tokens.select("token", "main.comp", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"), (F.col("c") - F.col("main.c") > MANY).alias("many"))
        left = rows.join(tokens.withColumnRenamed("comp", "main"), "token")
        left = left.withColumn("block", F.pmod(F.xxhash64("g"), F.col("blocks")).cast("int")).withColumn("rest", F.col("comp") != F.col("main"))
        left = written(left.select("token", "g", "n", "pos", "radius", "comp", "blocks", "block", "rest", "many", *BITS), "apart")
        # two rows of the rest would meet twice
        once = ~F.col("l.rest") | (F.col("l.g") < F.col("r.g"))
        room = self.apart("l", "r") + F.col("l.radius") + F.col("r.radius")
        near = (F.col("l.comp") != F.col("r.comp")) & once & self.may_link("l", "r") & (differing("l", "r") <= room)
        closer = (differing("l", "r", WIDE_BITS) <= room) & (F.size(F.array_intersect("l.earlier", "r.earlier")) < SHARED)

        def met(left: DataFrame, near: Column) -> DataFrame:
            right = left.where("rest").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            return left.alias("l").join(right.alias("r"), ["token", "block"]).where(near).select("l.token", *(F.struct(f"{x}.g", f"{x}.n").alias(x) for x in "lr"))

        return met(left.where("NOT many"), near).unionByName(met(self._closer(left.where("many")), near & closer))

    def _closer(self, rows: DataFrame) -> DataFrame:
        """rows with their groups' wider bitmaps, and with the row's last few shingles before its own, of those in rows.

        Two rows that have SHARED of these in common belong to groups that have met at SHARED shingles before, so often as paired() asks for.
        """
        ids = written(rows.select(F.col("g").alias("doc_id")).distinct(), "many-ids")
        chosen = self.docs.join(F.broadcast(ids) if small_enough(ids, SENT_IDS) else ids, "doc_id", "left_semi")
        size = self.size

        def each(batch: pa.RecordBatch):
            maps = np.array([bitmap(np.unique(shingles(word_hashes(raw), size)), WIDE) for raw in raw_texts(batch.column("text"))], np.int64).reshape(-1, WIDE)
            yield {"g": batch.column("doc_id"), **{x: maps[:, i] for i, x in enumerate(WIDE_BITS)}}

        wide = map_batches(chosen, lambda: each, f"g {self.key}, " + ", ".join(f"{x} bigint" for x in WIDE_BITS)).dropDuplicates(["g"])
        before = Window.partitionBy("g").orderBy("pos").rowsBetween(-EARLIER, -1)
        return written(rows.withColumn("earlier", F.collect_list("token").over(before)).join(wide, "g"), "many")

    def _room(self, compared: DataFrame, members: DataFrame, within: DataFrame, radii: DataFrame) -> DataFrame:
        """Pairs of members of those groups whose leaders do not link, but differ by no more than the groups' radii leave room for."""
        reach = members.where("doc_id = lead").unionByName(within).withColumnRenamed("doc_id", "m")
        near = compared.where(F.col("inter") * self.den < F.col("whole") * self.num)
        for side in ("a", "b"):
            near = near.join(radii.select(F.col("doc_id").alias(side), F.col("radius").alias(f"r{side}")), side, "left")
        # whole + inter is the sum of the two sizes, and whole - inter what differs
        link = F.col("whole") + F.col("inter") - 2 * F.ceil((F.col("whole") + F.col("inter")) * self.num / (self.num + self.den))
        near = near.where(F.coalesce("ra", "rb").isNotNull() & (F.col("whole") - F.col("inter") <= link + F.coalesce("ra", F.lit(0)) + F.coalesce("rb", F.lit(0)))).select("a", "b")
        alone = written(near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().join(radii, "doc_id", "left_anti").join(self.indexed, "doc_id").select("doc_id", "n", F.col("doc_id").alias("lead"), *BITS).withColumnRenamed("doc_id", "m"), "alone")
        reach = reach.unionByName(alone)
        pairs = near.join(reach.withColumnRenamed("lead", "a").alias("l"), "a").join(reach.withColumnRenamed("lead", "b").alias("r"), "b").where(differing("l", "r") <= self.apart("l", "r"))
        return pairs.select(F.least("l.m", "r.m").alias("a"), F.greatest("l.m", "r.m").alias("b"))


def jaccard_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, class_id (smallest id with the same set).

    Words are runs without white space, A-Z in lower case; a document's set is its distinct runs of `size` words, or all its words where there are
    fewer. Two documents link when den * intersection >= num * union; component_id is the smallest id that links reach. Exact but for
    collisions of 64-bit hashes. Links of equal sets and within components are implied, not listed.

    Null, empty and blank texts have empty sets and link with nothing; rows that share an id are one document for the links, and
    null ids are left out; other columns are not read.
    """
    return Join(docs.where(docs[doc_id].isNotNull()), doc_id, text, size, num, den).run()


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs, all columns, without those rows whose component has a smaller id. Rows of one id stay or go together; null ids stay."""
    found = jaccard_components(docs, doc_id=doc_id, text=text, size=size, num=num, den=den)
    gone = written(found.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    return docs.join(F.broadcast(gone) if small_enough(gone, SENT_IDS) else gone, docs[doc_id] == gone["doc_id"], "left_anti")
