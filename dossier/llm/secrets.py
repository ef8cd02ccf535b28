"""Secret scans: fixed patterns, and probabilistic automata inferred from the credentials that these label."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, id_type, map_batches, sliced, texts_of, written

KINDS = ("assign", "access", "hex")
#: Fixed patterns, and the lengths from which a match counts.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Candidates, all of which each automaton scores: runs of all characters, and of the least length, that a labelled credential may have; marks that may follow a credential.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % ASSIGN_LEAST)
MARKS = ".=-/"
#: Distinct labelled credentials of a kind that an automaton is inferred from at most: those whose hash is lowest.
SAMPLE = 400
#: Hoeffding confidence of the merges; nats a character that a candidate may lie below the labelled credentials' low tail.
ALPHA, MARGIN = 0.05, 0.15
#: Characters by class, with the number that share it.
CLASSES = {**{c: "a" for c in "abcdef"}, **{c: "g" for c in "ghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEF"}, **{c: "G" for c in "GHIJKLMNOPQRSTUVWXYZ"}, **{c: "0" for c in "0123456789"}}
SIZE = {"a": 6, "g": 20, "A": 6, "G": 20, "0": 10}
STOP = ""


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind's number, value) of the fixed patterns' matches, in order."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m[0]) for m in CANDIDATE.finditer(text)]


def covered(start: int, end: int, taken: list[tuple[int, int, int, str]]) -> bool:
    return any(a <= start and end <= b for a, b, _, _ in taken)


def joined(spans: list[tuple[int, int, int | str]]) -> str:
    return ",".join(f"{KINDS[k] if isinstance(k, int) else k}:{a}:{b}" for a, b, k in spans)


@dataclass
class State:
    passed: int = 0
    ended: int = 0
    to: dict[str, int] = field(default_factory=dict)
    taken: dict[str, int] = field(default_factory=dict)


def prefix_tree(values: list[str]) -> list[State]:
    states = [State()]
    for value in values:
        at = 0
        states[0].passed += 1
        for c in value:
            c = CLASSES.get(c, c)
            s = states[at]
            s.taken[c] = s.taken.get(c, 0) + 1
            if c not in s.to:
                s.to[c] = len(states)
                states.append(State())
            at = s.to[c]
            states[at].passed += 1
        states[at].ended += 1
    return states


class Automaton:
    """A probabilistic automaton: states of the prefix tree of labelled credentials, merged where their outcomes agree."""

    def __init__(self, values: list[str], alpha: float = ALPHA) -> None:
        self.states = states = prefix_tree(values)
        red, blue = [0], sorted(states[0].to.values())
        while blue:
            candidate = blue.pop(0)
            for r in red:
                if self._agree(r, candidate, alpha):
                    self._merge(r, candidate)
                    break
            else:
                red.append(candidate)
            known = set(red)
            blue = sorted({t for r in red for t in states[r].to.values()} - known, key=lambda t: (-states[t].passed, t))
        self.values = len(values)
        classes = {CLASSES.get(c, c) for v in values for c in v}
        alphabet = classes - set(SIZE) | {c for c, k in CLASSES.items() if k in classes}
        self.outcomes = len(classes) + 1
        # where an unseen step leads: where most steps of its class do
        leads: dict[str, dict[int, int]] = {}
        for r in red:
            for c, t in states[r].to.items():
                at = leads.setdefault(c, {})
                at[t] = at.get(t, 0) + states[r].taken[c]
        self.leads = {c: max(at, key=lambda t: (at[t], -t)) for c, at in leads.items()}
        self.states = {i: states[i] for i in red}
        # by state and character the next state and the nats of the step; under None those of the end
        self.steps = {i: {c: self._step(i, c) for c in alphabet} | {None: (i, self._nats(i, s.ended))} for i, s in self.states.items()}
        self.low = 0.0
        if values:
            scores = sorted(self.score(v) for v in values)
            self.low = scores[len(scores) // 50] - MARGIN

    def _differ(self, a: State, b: State, alpha: float) -> bool:
        if not a.passed or not b.passed:
            return False
        bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(a.passed) + 1 / math.sqrt(b.passed))
        if abs(a.ended / a.passed - b.ended / b.passed) > bound:
            return True
        return any(abs(a.taken.get(c, 0) / a.passed - b.taken.get(c, 0) / b.passed) > bound for c in a.taken.keys() | b.taken.keys())

    def _agree(self, r: int, b: int, alpha: float) -> bool:
        pairs = [(r, b)]
        while pairs:
            x, y = (self.states[i] for i in pairs.pop())
            if self._differ(x, y, alpha):
                return False
            pairs += [(x.to[c], t) for c, t in y.to.items() if c in x.to]
        return True

    def _merge(self, r: int, b: int) -> None:
        """Folds the tree below b into r."""
        for s in self.states:
            for c, t in s.to.items():
                if t == b:
                    s.to[c] = r
        pairs = [(r, b)]
        while pairs:
            i, j = pairs.pop()
            x, y = self.states[i], self.states[j]
            x.passed += y.passed
            x.ended += y.ended
            for c, t in y.to.items():
                x.taken[c] = x.taken.get(c, 0) + y.taken[c]
                if c in x.to:
                    pairs.append((x.to[c], t))
                else:
                    x.to[c] = t

    def _nats(self, state: int, times: int) -> float:
        """One more passing is shared among all outcomes, so that unseen steps have a small share."""
        return math.log((times + 1 / self.outcomes) / (self.states[state].passed + 1))

    def _step(self, state: int, c: str) -> tuple[int, float]:
        kind, s = CLASSES.get(c, c), self.states[state]
        return s.to.get(kind, self.leads.get(kind, state)), self._nats(state, s.taken.get(kind, 0)) - math.log(SIZE.get(kind, 1))

    def score(self, value: str) -> float:
        """Nats a character of the value and its end."""
        at, total, steps = 0, 0.0, self.steps
        for c in value:
            at, nats = steps[at].get(c) or self._step(at, c)
            total += nats
        return (total + steps[at][None][1]) / len(value)


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, base (spans of the fixed patterns) and runs (candidates). Null texts are empty, ids may be null or repeat. No shuffle."""
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))

    def each(batch: pa.RecordBatch):
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "base", "runs")}
        for x in texts_of(batch.column("text")):
            spans = base_spans(x)
            for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name].append(sum(s[2] == k for s in spans))
            out["base_sha256"].append(hashlib.sha256(joined([s[:3] for s in spans]).encode()).hexdigest())
            out["base"].append([{"start": a, "end": b, "kind": KINDS[k], "value": v} for a, b, k, v in spans])
            out["runs"].append([{"start": a, "end": b, "value": v} for a, b, v in candidates(x)])
        yield {"doc_id": batch.column("doc_id"), **out}

    return map_batches(
        rows, lambda: each,
        f"doc_id {id_type(docs, doc_id)}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, base array<struct<start:bigint,end:bigint,kind:string,value:string>>, runs array<struct<start:bigint,end:bigint,value:string>>",
    )


def infer(scanned: DataFrame, sample: int = SAMPLE) -> dict[str, Automaton]:
    """An automaton for each kind, from at most `sample` distinct credentials that the fixed patterns label."""
    values = scanned.select(F.explode("base").alias("b")).select("b.kind", "b.value").distinct()
    out = {}
    for kind in KINDS:
        chosen = values.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(sample).collect()
        out[kind] = Automaton([r.value for r in chosen])
    return out


def parts(value: str) -> set[tuple[int, int]]:
    """Where a candidate's credential may lie: all of it, without marks at its end, and either after its first equals sign."""
    ends = {len(value), len(value.rstrip(MARKS))}
    return {(a, b) for a in {0, value.find("=") + 1} for b in ends if b - a >= ASSIGN_LEAST} or {(0, len(value))}


def judged(runs: list[tuple[int, int, str]], automata: dict[str, Automaton]) -> list[tuple[int, int, str, float, float]]:
    """(start, end, kind, score, threshold) of each candidate, by all automata that labelled credentials taught: of its parts the one, and the kind, that fits best.

    Nothing but the likelihood decides: characters that an automaton has not met and lengths at which it never ended cost what its smoothing gives them.
    """
    out = []
    taught = [(kind, a) for kind, a in sorted(automata.items()) if a.values]
    for start, _, value in runs:
        found = ((a.score(value[i:j]), kind, a.low, i, j) for i, j in sorted(parts(value)) for kind, a in taught)
        if best := max(found, key=lambda x: (x[0] - x[2], x[1]), default=None):
            score, kind, low, i, j = best
            out.append((start + i, start + j, kind, score, low))
    return out


def learned(scores: list[tuple[int, int, str, float, float]], base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what an automaton fits as well as its own labelled credentials and no match of the fixed patterns covers whole."""
    return [(a, b, kind) for a, b, kind, score, low in scores if score >= low and not covered(a, b, base)]


def find_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans (all, by start), n_added, n_candidates, n_fit, scores.

    The fixed patterns label credentials. From a bounded sample of them the states of a prefix tree are merged where their outcomes do not
    differ beyond a Hoeffding bound, into one probabilistic automaton a kind. All candidates, those within the patterns' matches too, are scored by all automata:
    `scores` has one row for each candidate, with its best kind, its nats a character and that kind's threshold; n_fit of them reach it. Those that no match of a
    pattern covers whole are added as learned-<kind>, beside a match within them. Texts are read once; the second pass has only what the first found.

    Null texts are empty; ids may be null or repeat; without any labelled credential no candidate has a score and nothing is added; other columns are not read.
    """
    scanned = written(scan(docs, doc_id=doc_id, text=text), "secrets")
    shared = docs.sparkSession.sparkContext.broadcast(infer(scanned, sample))

    def make():
        automata = shared.value
        return lambda batch: added(batch, automata)

    def added(batch: pa.RecordBatch, automata) -> Iterator[dict]:
        out: dict[str, list] = {k: [] for k in ("spans", "n_added", "n_candidates", "n_fit", "scores")}
        for base, runs in zip(batch.column("base").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            taken = [(b["start"], b["end"], KINDS.index(b["kind"]), b["value"]) for b in base]
            scores = judged([(r["start"], r["end"], r["value"]) for r in runs], automata)
            more = [(a, b, f"learned-{kind}") for a, b, kind in learned(scores, taken)]
            merged = [(a, k, b, KINDS[k]) for a, b, k, _ in taken] + [(a, len(KINDS), b, k) for a, b, k in more]
            out["spans"].append(joined([(a, b, k) for a, _, b, k in sorted(merged)]))
            out["n_added"].append(len(more))
            out["n_candidates"].append(len(runs))
            out["n_fit"].append(sum(score >= low for *_, score, low in scores))
            out["scores"].append([dict(zip(("start", "end", "kind", "score", "threshold"), x, strict=True)) for x in scores])
        yield {c: batch.column(c) for c in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")} | out

    return map_batches(
        scanned, make,
        f"doc_id {id_type(docs, doc_id)}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_added bigint, n_candidates bigint, n_fit bigint, scores array<struct<start:bigint,end:bigint,kind:string,score:double,threshold:double>>",
    )


def redacted(docs: DataFrame, automata: dict[str, Automaton], *, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with all columns, secrets of the text replaced by `mark`; overlapping spans become one. Null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(automata)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in chain.from_iterable(map(sliced, batches)):
            texts = [x if x is None else without_secrets(x, known, mark) for x in batch.column(text).to_pylist()]
            yield batch.set_column(batch.schema.get_field_index(text), text, pa.array(texts, pa.string()))

    return bounded(docs).mapInArrow(run, docs.schema)


def without_secrets(text: str, automata: dict[str, Automaton], mark: str) -> str:
    base = base_spans(text)
    spans = sorted([(a, b) for a, b, _, _ in base] + [(a, b) for a, b, _ in learned(judged(candidates(text), automata), base)])
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text
