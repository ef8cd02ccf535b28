"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memory, id_type, keep_rows, map_batches, raw_texts, tidy
from .decontaminate import words_of

#: Terms are hashed to 2**TERM_BITS slots.
TERM_BITS = 22
#: Labelled rows that the machine is fitted on at most: those whose hashed id is lowest.
TRAIN_ROWS = 20_000
#: Terms of these rows together at most; beyond, fewer rows are taken.
TRAIN_TERMS = 32_000_000
#: A term has a say if it is in so many of those rows, and its share of label 1 lies so many standard deviations off the mean, or does so beside another term (see `partners`).
LEAST_ROWS, LEAST_Z = 6, 5.0
#: Of the rows that it is fitted on, those that pairs of terms are counted in at most.
PAIR_ROWS = 6_000
#: Terms of at most this share of the rows tell near-copies by the least of their hashes; near-copies together weigh as one row.
RARE_SHARE = 0.005
#: Rows of the same least hash are near-copies if so much of all their terms is common.
COPY_SHARE = 0.5
FACTORS, EPOCHS, BATCH, RATE, DECAY = 4, 40, 256, 0.15, 1e-4
#: Beside whole words, stems of so many code points, for insults whose endings vary.
STEMS = (4, 5)
NOTHING: tuple = ()


def terms_of(word: bytes) -> list[int]:
    """Slots of a word's terms: itself, its stems, and last itself as a word that a text repeats."""
    letters = word.decode().lower()
    full = letters.encode()
    keys = [b"w" + full, *(b"s%d" % n + (letters[:n].encode()) for n in STEMS if len(letters) >= n), b"r" + full]
    return [xxhash.xxh64_intdigest(k) >> (64 - TERM_BITS) for k in keys]


def features_of(raw: bytes, memory: Memory) -> np.ndarray:
    """The slots that a text has, in order."""
    out: list[bytes] = []
    memory.room()
    for word, n in Counter(words_of(raw)).items():
        if (terms := memory.get(word)) is None:
            terms = np.array(terms_of(word), np.int32).tobytes()
            memory.note(word, terms, len(word) + len(terms))
        out.append(terms if n > 1 else terms[:-4])
    return np.unique(np.frombuffer(b"".join(out), np.int32))


@dataclass
class Machine:
    """score = sigmoid(bias + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2)) over the terms i that a text has."""

    keys: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    #: Whether it was fitted on any rows.
    labelled: bool = True

    def scorer(self):
        at = {int(k): i for i, k in enumerate(self.keys)}
        memory = Memory()

        def score(raw: bytes) -> float:
            memory.room()
            rows: set[int] = set()
            for word, n in Counter(words_of(raw)).items():
                if (own := memory.get(word)) is None:
                    *single, repeated = map(at.get, terms_of(word))
                    own = (tuple(i for i in single if i is not None), repeated)
                    memory.note(word, own := NOTHING if own == ((), None) else own, len(word) + 40 * len(own))
                if own is not NOTHING:
                    rows.update(own[0])
                    if own[1] is not None and n > 1:
                        rows.add(own[1])
            return self.of(np.sort(np.fromiter(rows, np.int64, len(rows))))

        return score

    def of(self, rows: np.ndarray) -> float:
        v = self.factors[rows]
        z = self.bias + self.weights[rows].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def counted(terms: np.ndarray, n: int, weight: np.ndarray | None = None, row: np.ndarray | None = None, at_once: int = 1 << 20) -> np.ndarray:
    """Rows of each of n terms, or the sum of these rows' weights; a part of the terms at a time, as numpy widens what it counts."""
    out = np.zeros(n, np.int32 if weight is None else np.float64)
    for i in range(0, len(terms), at_once):
        out += np.bincount(terms[i : i + at_once], None if weight is None else weight[row[i : i + at_once]], n).astype(out.dtype)
    return out


def weighed(start: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A weight for each row (its terms lie from start to the next start): rows that share the least slot of their rarer terms, and most of all their terms, weigh one together."""
    m = len(start) - 1
    rare = max(RARE_SHARE * m, 40)
    weight = np.ones(m)
    same: dict[int, list[int]] = {}
    for i in range(m):
        own = terms[start[i] : start[i + 1]]
        few = own[counts[own] <= rare]
        if len(few):
            same.setdefault(int(few[0]), []).append(i)  # a row's terms are in order
    for rows in same.values():
        copies: list[tuple[np.ndarray, list[int]]] = []
        for i in rows:
            own = terms[start[i] : start[i + 1]]
            for first, those in copies:
                both = len(np.intersect1d(first, own, assume_unique=True))
                if both >= COPY_SHARE * (len(first) + len(own) - both):
                    those.append(i)
                    break
            else:
                copies.append((own, [i]))
        for _, those in copies:
            weight[those] = 1 / len(those)
    return weight


def divergence(hit: np.ndarray, seen: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Nats by which `hit` of `seen` speak against the share."""
    rate, share = np.clip(hit / seen, 1e-12, 1 - 1e-12), np.clip(share, 1e-12, 1 - 1e-12)
    return seen * (rate * np.log(rate / share) + (1 - rate) * np.log((1 - rate) / (1 - share)))


def partners(labels: np.ndarray, weight: np.ndarray, row: np.ndarray, index: np.ndarray, seen: np.ndarray, hit: np.ndarray, least: int, least_z: float) -> np.ndarray:
    """Which terms have a partner: rows with both have another share of label 1 than the rows of either have.

    Shares differ by a Chernoff bound of `least_z` standard deviations, and of as many nats more as there are pairs of terms.
    All pairs of these rows are counted but those of terms whose rows, whatever they share, cannot reach that bound.
    """
    share = np.clip(hit / seen, 1e-12, 1 - 1e-12)
    nats = least_z**2 / 2 + 2 * np.log(max(len(seen), 1))
    can = np.maximum(-hit * np.log(share), -(seen - hit) * np.log(1 - share)) >= nats
    n, share, mask = int(can.sum()), share[can], can[index]
    index, row = (np.cumsum(can, dtype=np.int32) - 1)[index[mask]], row[mask]
    # each pair is met once: with a term, those after it in its rows
    end = np.searchsorted(row, np.arange(len(labels)), side="right").astype(np.int32)[row]
    each, ones = weight.astype(np.float32)[row], (weight * labels).astype(np.float32)[row]
    by_term = np.argsort(index, kind="stable")
    bounds = np.concatenate(([0], np.cumsum(np.bincount(index, minlength=n))))
    found = np.zeros(n, bool)
    for j in range(n):
        spans = [slice(a + 1, b) for a, b in zip(by_term[bounds[j] : bounds[j + 1]], end[by_term[bounds[j] : bounds[j + 1]]], strict=True)]
        beside = np.concatenate([index[s] for s in spans])
        both = np.bincount(beside, np.concatenate([each[s] for s in spans]), n)
        some = np.flatnonzero(both >= least)
        positive = [s for s in spans if s.start < s.stop and ones[s.start] > 0]
        toxic = np.bincount(np.concatenate([index[s] for s in positive]), np.concatenate([ones[s] for s in positive]), n) if positive else np.zeros(n)
        both, toxic = both[some], toxic[some]
        high, low = np.maximum(share[some], share[j]), np.minimum(share[some], share[j])
        rate = toxic / both
        off = np.where(rate > high, divergence(toxic, both, high), np.where(rate < low, divergence(toxic, both, low), 0.0)) >= nats
        found[some[off]] = True
        found[j] |= off.any()
    out = np.zeros(len(can), bool)
    out[can] = found
    return out


def paired(labels: np.ndarray, weight: np.ndarray, row: np.ndarray, index: np.ndarray, often: np.ndarray, least: int, least_z: float, most: int = PAIR_ROWS) -> np.ndarray:
    """Which terms have a partner, told from the first `most` rows and the terms that are often enough in these."""
    end = int(np.searchsorted(row, most))
    row, index = row[:end], index[:end]
    seen = counted(index, len(often), weight, row)
    some = often & (seen >= least)
    mask = some[index]
    row, index = row[mask], (np.cumsum(some, dtype=np.int32) - 1)[index[mask]]
    out = np.zeros(len(often), bool)
    out[some] = partners(labels, weight, row, index, seen[some], counted(index, int(some.sum()), weight * labels, row), least, least_z)
    return out


def fit(labels: np.ndarray, sizes: np.ndarray, terms: np.ndarray, least: int = LEAST_ROWS, least_z: float = LEAST_Z) -> Machine:
    """AdaGrad on the logistic loss, in an order that a fixed seed gives. Each row is its label and its number of terms; the terms (slots, in order) follow each other."""
    m = len(labels)
    start = np.concatenate(([0], np.cumsum(sizes)))
    counts = counted(terms, 1 << TERM_BITS)
    weight = weighed(start, terms, counts)
    mean = float((labels * weight).sum() / max(weight.sum(), 1e-9))
    # rare terms are of no more use: only the others get a number
    often = counts >= least
    keys, number = np.flatnonzero(often), (np.cumsum(often) - 1).astype(np.int32)
    mask = often[terms]
    index, row = number[terms[mask]], np.repeat(np.arange(m, dtype=np.int32), sizes)[mask]
    seen, hit = counted(index, len(keys), weight, row), counted(index, len(keys), weight * labels, row)
    often = seen >= least
    kept = often & (np.abs(hit - seen * mean) >= least_z * np.sqrt(seen * mean * (1 - mean)) + 1e-9)
    kept |= paired(labels, weight, row, index, often, least, least_z)
    mask = kept[index]
    index, row = (np.cumsum(kept, dtype=np.int32) - 1)[index[mask]], row[mask]
    n = int(kept.sum())
    start = np.searchsorted(row, np.arange(m + 1))
    random = np.random.default_rng(7)
    w, v = np.zeros(n), random.normal(0, 0.01, (n, FACTORS))
    bias = float(np.log((mean + 1e-3) / (1 - mean + 1e-3))) if m else 0.0
    gw, gv = np.full(n, 1e-6), np.full((n, FACTORS), 1e-4)
    for _ in range(EPOCHS if m and n else 0):
        order = random.permutation(m)
        for some in (order[i : i + BATCH] for i in range(0, m, BATCH)):
            sizes_ = start[some + 1] - start[some]
            which = np.repeat(np.arange(len(some)), sizes_)
            flat = index[np.repeat(start[some] - np.concatenate(([0], np.cumsum(sizes_)[:-1])), sizes_) + np.arange(sizes_.sum())]
            vf = v[flat]
            total = np.stack([np.bincount(which, vf[:, f], len(some)) for f in range(FACTORS)], 1)
            z = bias + np.bincount(which, w[flat], len(some)) + 0.5 * ((total**2).sum(1) - np.bincount(which, (vf**2).sum(1), len(some)))
            error = 1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels[some]
            error *= weight[some]
            bias -= 0.5 * error.mean()
            used, place = np.unique(flat, return_inverse=True)
            each = error[which]
            g = np.bincount(place, each, len(used)) / len(some) + DECAY * w[used]
            gw[used] += g * g
            w[used] -= RATE * g / np.sqrt(gw[used])
            pair = each[:, None] * (total[which] - vf)
            for f in range(FACTORS):
                g = np.bincount(place, pair[:, f], len(used)) / len(some) + DECAY * v[used, f]
                gv[used, f] += g * g
                v[used, f] -= 0.3 * RATE * g / np.sqrt(gv[used, f])
    return Machine(keys[kept], bias, w, v, m > 0)


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = TRAIN_ROWS, most_terms: int = TRAIN_TERMS) -> Machine:
    """Fits on at most `most` labelled rows, those whose hashed id is lowest, and on fewer once these have `most_terms` terms. Only their ids are sent out; their terms are gathered in one task.

    Null labels and null ids are left out; an id that labels hold twice counts with its highest label; without
    labelled rows all scores are 0.5. Null texts have no terms.
    """
    chosen = (
        labels.select(labels[doc_id].alias("doc_id"), labels[label].cast("int").alias("label")).dropna()
        .groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).join(F.broadcast(chosen), "doc_id")

    def terms():
        memory = Memory()

        def each(batch: pa.RecordBatch):
            yield {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "terms": [features_of(raw, memory).tobytes() for raw in raw_texts(batch.column("text"))]}

        return each

    fitted = map_batches(rows, terms, f"doc_id {id_type(docs, doc_id)}, label int, terms binary").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "label", "terms")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, sizes, found, total = [], [], [], 0
        for batch in batches:
            for label_, x in zip(batch.column("label").to_pylist(), batch.column("terms"), strict=True):
                if (total := total + len(x.as_buffer()) // 4) <= most_terms:
                    found.append(x.as_py())
                    sizes.append(len(found[-1]) // 4)
                    y.append(label_)
        terms, found = np.frombuffer(b"".join(found), np.int32), []
        machine = fit(np.array(y, float), np.array(sizes, np.int64), terms)
        del terms
        tidy()
        yield pa.RecordBatch.from_arrays(
            [pa.array([machine.bias]), pa.array([machine.keys.tobytes()], pa.binary()), pa.array([machine.weights.tobytes()], pa.binary()), pa.array([machine.factors.tobytes()], pa.binary()), pa.array([machine.labelled])],
            names=["bias", "keys", "weights", "factors", "labelled"],
        )

    row = fitted.select("label", "terms").mapInArrow(learn, "bias double, keys binary, weights binary, factors binary, labelled boolean").first()
    if row is None:
        return Machine(np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, FACTORS)), False)
    return Machine(np.frombuffer(row.keys, np.int64), row.bias, np.frombuffer(row.weights), np.frombuffer(row.factors).reshape(-1, FACTORS), row.labelled)


def score(docs: DataFrame, machine: Machine, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of each row of docs. Null and empty texts have the score of no terms. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        of = shared.value.scorer()
        return lambda batch: iter([{"doc_id": batch.column("doc_id"), "score": [of(raw) for raw in raw_texts(batch.column("text"))]}])

    return map_batches(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), make, f"doc_id {id_type(docs, doc_id)}, score double")


def drop_toxic(docs: DataFrame, machine: Machine, *, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, that score below `limit`; all rows where the machine had no labelled ones."""
    if not machine.labelled:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        of = shared.value.scorer()
        return lambda batch: [of(raw) < limit for raw in raw_texts(batch.column(text))]

    return keep_rows(docs, make)
