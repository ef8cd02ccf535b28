"""Operators 11 to 13 against brute force, on whole small tables and on fixtures with nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash

from dossier.llm import periods, queries, repair, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMPTY = hashlib.sha256(b"").hexdigest()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11


def plain_damage(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def cheapest(turns):
    """By cost, then by the whole audit's letters: (cost, audit, repaired) of all turns (role, text, must go, truncated)."""
    best = {"": (0, "", [])}  # by what may come next: "" at the start, else the last initial

    def offer(out, state, entry):
        if state not in out or entry[:2] < out[state][:2]:
            out[state] = entry

    def insertions(cells):
        for _ in range(3):
            for state, (cost, audit, said) in list(cells.items()):
                new = "a" if state == "u" else "u"
                offer(cells, new, (cost + 3, audit + "I", [*said, ({"u": "user", "a": "assistant"}[new], "")]))

    for role, text, go, cut in turns:
        insertions(best)
        out = {}
        for state, (cost, audit, said) in best.items():
            offer(out, state, (cost + 4, audit + "D", said))
            if not go:
                new = "a" if state == "u" else "u"
                offer(out, new, (cost + 3 + 3 * cut, audit + "R", [*said, ({"u": "user", "a": "assistant"}[new], text)]))
                if role[:1] == new or (role[:1] == "s" and state == ""):
                    offer(out, role[:1], (cost + 3 * cut, audit + "K", [*said, (role, text)]))
        best = out
    insertions(best)
    return min((best[s] for s in ("", "a") if s in best), key=lambda e: e[:2])


def plain_repair(rows, damage=True):
    """conv_id: the row of op11, from all rows."""
    by, out = {r[0]: [] for r in rows}, {}
    for conv, *rest in plain_damage(rows) if damage else rows:
        by[conv].append(rest)
    for conv, turns in by.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))
        seen, faults = set(), []
        for _, role, text in turns:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        numbers = [t for t, _, _ in turns if t is not None]
        cost, audit, said = cheapest([(r, x, f in ("blank", "duplicate"), f == "truncated") for (_, r, x), f in zip(turns, faults, strict=True)])
        initials = [r[:1] for _, r, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[conv] = (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(f"{r}:{x}" for r, x in said)))
    return out


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_structure_repair_whole_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[n] for n in NUMBERS) for r in queries.op11_structure_repair(spark, small).collect()}
    assert got == plain_repair(rows)


@pytest.fixture(scope="module")
def odd_turns():
    random.seed(5)
    rows = [(1, None, "user", "hm."), (1, None, None, None), (1, 3, "user", "a?"), (1, 3, "user", "a?"), (1, 3, "assistant", "b"), (1, 9, "", "c."), (2, 0, "system", "  \n"), (None, 1, "user", "null id."), (None, 2, "assistant", "x" * 300_000 + ".")]
    rows += [(3, None, "tool", None), (3, None, "system", "s."), (3, None, "system", "s.")]
    # one conversation holds most turns; often equally dear
    rows += [(7, i, random.choice(["user"] * 5 + ["assistant", "system"]), random.choice(["yes.", "no", f"t{i}.", f"t{i}!", " "])) for i in range(300)]
    rows += [(c, i, random.choice(["user", "assistant", "system", "tool"]), random.choice([f"t{i}.", f"t{i}", "same."])) for c in range(10, 60) for i in range(random.randrange(1, 9))]
    return rows


@pytest.mark.parametrize("chunk", [4096, 16])
def test_structure_repair_edges(spark, odd_turns, chunk, monkeypatch):
    """Nulls, equal numbers, repeated rows, odd roles, a long conversation in many chunks; columns beside the four clash with the operator's own."""
    monkeypatch.setattr(repair, "CHUNK", chunk)
    df = spark.createDataFrame([(*r, "x", 1) for r in odd_turns], "conv_id long, turn long, role string, text string, audit string, at int").repartition(5)
    found = repair.Repair(df)
    hashes = {r.conv_id: r.repaired_sha256 for r in found.hashes.collect()}
    got = {r.conv_id: (*(r[n] for n in NUMBERS[:-1]), hashes[r.conv_id]) for r in found.conversations.collect()}
    want = plain_repair([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in odd_turns], damage=False)
    assert got == want
    said = {}
    for r in sorted(found.turns.collect(), key=lambda r: (r.at, r.step)):
        said.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: sha("\n".join(said.get(c, []))) for c in hashes} == hashes
    for parts in said.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(p[0] for p in parts))


def test_structure_repair_drops_whole_conversations(spark, tmp_path):
    """Conversations of which the damage leaves nothing, and an empty table."""
    gone = [(c, t) for c in range(300) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    spark.createDataFrame([(c, t, "user", "x.") for c, t in gone], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/a/conversations.parquet")
    rows = queries.op11_structure_repair(spark, f"{tmp_path}/a").collect()
    assert {r.conv_id for r in rows} == {c for c, _ in gone} and {tuple(r[n] for n in NUMBERS) for r in rows} == {(0,) * 6 + ("", EMPTY)}
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert queries.op11_structure_repair(spark, f"{tmp_path}/b").count() == 0


@pytest.mark.parametrize("modulus", [repair.MOD, 5])
def test_audits_compare_as_their_texts(modulus, monkeypatch):
    """Also where nearly all hashes collide."""
    monkeypatch.setattr(repair, "MOD", modulus)
    random.seed(2)
    nodes = [repair.Node(None, "")]
    for _ in range(300):
        nodes.append(repair.Node(random.choice(nodes[-20:]), random.choice(["D", "I", "K", "R", "KD", "KKIR", ""])))
    for a, b in random.sample(list(combinations(nodes, 2)), 3000):
        x, y = a.text(), b.text()
        n = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        assert repair.common_prefix(a, b) == n and repair.less(a, b) == (x < y) and repair.less(b, a) == (y < x)


# 12


def plain_runs(w):
    """All stretches, period by period."""
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = q
        while i < len(w):
            start = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            if i - start + q >= max(24, 3 * q) and not any(all(w[k] == w[k - p] for k in range(start - q + p, i)) for p in range(1, q)):
                out.append((start - q, i - start + q, q))
            i += i == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(w):
    found = plain_runs(w)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    row = (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None)
    return (*row, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_runs_of_random_words():
    random.seed(4)
    several = []
    for _ in range(300):
        w = []
        for _ in range(random.randint(1, 4)):
            block = [random.randrange(random.choice([1, 2, 3, 50])) for _ in range(random.randint(1, 40))]
            block *= random.randint(1, 6)
            w += block[: random.randint(1, len(block))]
        w = w[:260]
        want = plain_runs(w)
        assert [tuple(r) for r in periods.runs(np.array(w, np.int64)).tolist()] == want
        several.append((w, want))
    # texts that follow each other, numbered apart
    at, whole, want = 0, [], []
    for i, (w, found) in enumerate(several):
        whole += [x + 100 * i for x in w]
        want += [(s + at, n, q) for s, n, q in found]
        at += len(w)
    assert [tuple(r) for r in periods.runs(np.array(whole, np.int64)).tolist()] == want


def test_runs_of_very_long_text():
    n = 1_000_000
    assert periods.runs(np.zeros(n, np.int64)).tolist() == [[0, n, 1]]
    half = np.random.default_rng(1).integers(0, 1000, n // 4)
    assert periods.runs(np.concatenate([half, half, half, half[:5]])).tolist() == [[0, 3 * (n // 4) + 5, n // 4]]


DIGEST = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_periodic_runs_whole_table(spark, small):
    want = {}
    for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect():
        w, h = WORD.findall(r.text or ""), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        want[r.doc_id] = plain_row(w)
    got = {r.doc_id: tuple(r[n] for n in DIGEST) for r in queries.op12_periodic_runs(spark, small).collect()}
    assert got == want and sum(r[0] for r in want.values()) > 5


@pytest.mark.parametrize("size", [1, 7, 50, 10_000])
def test_words_of_pieces(size):
    raw = "  one two\tÉté one\n\n two  x\x0b".encode() * 40
    ids, names = periods.numbered(raw, size)
    assert [names[i] for i in ids] == raw.split() and len(set(names)) == len(names)


def test_periodic_runs_edges(spark):
    """Null, empty, blank and long texts, repeated and null ids, clashing columns, no rows."""
    texts = [None, "", " \n\t", "one", "a " * 23, "a\t" * 24, "ü x " * 30, "a b c d e f g h i " * 9 + "a b", " ".join(["x"] * 30 + ["y"] + ["x"] * 40), "w" * 400_000]
    rows = [(i, t, 1, "z") for i, t in enumerate(texts)] + [(3, "one", 2, "z"), (None, "b " * 30, 2, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, runs string").repartition(3)
    got = periods.digests(periods.periodic_runs(df)).collect()
    assert sorted(((r.doc_id, *(r[n] for n in DIGEST)) for r in got), key=lambda r: str(r)) == sorted(((i, *plain_row(WORD.findall(t or ""))) for i, t, _, _ in rows), key=lambda r: str(r))
    assert periods.periodic_runs(df.limit(0)).count() == 0


# 13


def plain_fingerprint(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    s = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(rows, most=3):
    """doc_id: (fingerprints, smallest id reached); rows: doc_id, fingerprint."""
    top = {i: i for i, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for (i, x), (j, y) in combinations(rows, 2):
        if (x ^ y).bit_count() <= most:
            a, b = find(i), find(j)
            top[max(a, b)] = min(a, b)
    return sorted((i, f"{x:016x}", find(i)) for i, x in rows)


def test_simhash_whole_table(spark, small):
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.op13_simhash(spark, small).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(got) == plain_components(rows)


@pytest.mark.parametrize(("bucket", "sent"), [(simhash.BUCKET, simhash.SENT_IDS), (5, 0)])
def test_simhash_edges(spark, monkeypatch, bucket, sent):
    """Near copies in large buckets, nulls, short texts, ids of several texts, null ids, clashing columns; no rows."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "SENT_IDS", sent)
    random.seed(6)
    base = [" ".join(f"w{random.randrange(500)}" for _ in range(120)) for _ in range(3)]
    rows = [(i, t) for i, t in enumerate([None, "", " \n", "one", "ONE", "two words", "x" * 300_000, "Été  über"])]
    for i in range(100, 240):
        w = base[i % 3].split()
        for _ in range(random.randrange(4)):
            w[random.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(3, base[0]), (3, "one"), (231, "one of its own"), (None, "one")]
    df = spark.createDataFrame([(*r, 1, b"x") for r in rows], "doc_id long, text string, fp int, distances binary").repartition(4)
    got = sorted((r.doc_id, f"{r.fp % (1 << 64):016x}", r.component_id) for r in simhash.near_copies(df).collect())
    assert got == plain_components([(i, plain_fingerprint(t)) for i, t in rows if i is not None])
    assert simhash.near_copies(df.limit(0)).count() == 0


def test_pivots_lose_no_link():
    """Differences from each pivot are no greater than those of the fingerprints, and the links connect what all pairs connect, across two parts as well."""
    rng = np.random.default_rng(0)
    for parts in (1, 2):
        centre = rng.integers(0, 2**64, 4, dtype=np.uint64)
        fps = {int(centre[rng.integers(4)]) ^ sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 7))}) for _ in range(300)}
        fp = np.array(sorted(fps), np.uint64)
        table = np.bitwise_count(fp[:, None] ^ simhash.pivots())
        far = np.bitwise_count(fp[:, None] ^ fp)
        assert (np.abs(table[:, None].astype(int) - table[None]).max(axis=2) <= far).all()
        part = np.arange(len(fp)) % parts
        near = [(i, j) for i, j in combinations(range(len(fp)), 2) if far[i, j] <= 3 and (parts == 1 or part[i] != part[j])]
        reach = lambda links: [c for *_, c in sorted(plain_links(len(fp), links))]
        assert reach(simhash.linked(fp, table, part, 3)) == reach(near)


def plain_links(n, links):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [(i, find(i)) for i in range(n)]
