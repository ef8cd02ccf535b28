"""Tokenising with a memory of pieces, and exact token counts of huge documents by resynchronised chunks."""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memory, held, id_type, map_batches, texts_of, written

#: Bytes that the pieces a worker remembers may take, about.
PIECES_BYTES = 32 << 20
#: A text of more code points is cut into chunks of so many, that overlap by OVERLAP.
HUGE, CHUNK, OVERLAP, WIDER = 32_768, 16_384, 512, 8
#: Blanks that split a text; one that holds any other white space is encoded whole.
BLANK = " \\t\\n\\r"
ODD = re.compile(rf"[^\S{BLANK}]")
PIECE = re.compile(rf"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+\Z")
#: Latin-1 letters, digits and white space, as the tokenizers' patterns class them.
LETTER, DIGIT, SPACE = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
#: Pieces of more code points are not remembered.
LONG = 256
#: Between a word and a blank byte-level pre-tokenisation always has a boundary.
STABLE = re.compile(rf"(?<=\S)(?=[{BLANK}])")


def located(path: str) -> str:
    """A path as it is; a bare file name is looked up among this machine's public tokenizers, so that each executor finds its own."""
    if "/" in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(located(path))


def offset_tokenizer(path: str):
    """The same tokenizer, whose offsets keep the blanks that tokens begin with."""
    from tokenizers import Tokenizer

    with open(located(path)) as file:
        parts = json.load(file)
    parts["post_processor"] = None
    return Tokenizer.from_str(json.dumps(parts))


class Pieces:
    """Splits texts into pieces whose encodings, one after another, are the text's, and remembers what each piece gave.

    A Latin-1 text without special strings splits at the tokenizer's own pre-tokens. Any other splits between a word and a blank,
    where pre-tokens never reach over, or not at all.
    """

    pattern: re.Pattern[str]
    folded = False

    def __init__(self, path: str, memory_bytes: int = PIECES_BYTES) -> None:
        self.tokenizer = tokenizer(path)
        self.memory = Memory(memory_bytes)

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.elsewhere(text)
        return self.elsewhere(text) if "<|" in text else self.pattern.findall(text.lower() if self.folded else text)

    def elsewhere(self, text: str) -> list[str]:
        return [text] if ODD.search(text) else PIECE.findall(text)

    def learn(self, pieces: list[str]) -> None:
        raise NotImplementedError

    def looked_up(self, texts: list[str], join) -> list:
        memory = self.memory
        memory.room()
        split = [self.split(x) for x in texts]
        self.learn(new := list(set(chain.from_iterable(split)).difference(memory)))
        out = [join(map(memory.__getitem__, pieces)) for pieces in split]
        for piece in new:
            if len(piece) > LONG:
                del memory[piece]
                memory.used -= len(piece)
        return out


class WordIds(Pieces):
    """Ids of texts under a tokenizer that drops white space, folds case and marks the last token of each pre-token."""

    pattern = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^{SPACE}{LETTER}{DIGIT}]+")
    folded = True

    def __init__(self, path: str, memory_bytes: int = PIECES_BYTES) -> None:
        super().__init__(path, memory_bytes)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def learn(self, pieces: list[str]) -> None:
        for i in range(0, len(pieces), 512):
            some = pieces[i : i + 512]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends = [0, *(4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()]
            if len(ends) == len(some) + 1 and all(map(str.strip, some)) and not any("<|" in p for p in some):
                raw = ids.tobytes()
                for p, a, b in zip(some, ends, ends[1:], strict=False):
                    self.memory.note(p, raw[a:b], len(p) + b - a)
            else:  # some piece is not just one pre-token
                for p, coded in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                    self.memory.note(p, np.array(coded.ids, "<u4").tobytes(), len(p) + 4 * len(coded))

    def bytes_of(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return self.looked_up(texts, b"".join)


class PieceCounts(Pieces):
    """Token counts of texts under a byte-level tokenizer."""

    pattern = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^{SPACE}{LETTER}{DIGIT}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

    def learn(self, pieces: list[str]) -> None:
        for i in range(0, len(pieces), 1024):
            some = pieces[i : i + 1024]
            for p, coded in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.memory.note(p, len(coded), len(p))

    def of(self, texts: list[str]) -> list[int]:
        return self.looked_up(texts, sum)


def remembered(kind: type, path: str, memory_bytes: int = PIECES_BYTES) -> Pieces:
    """One for all tasks of a worker; its memory of pieces is bounded in bytes."""
    return held((kind, path, memory_bytes), lambda: kind(path, memory_bytes))


def seam(text: str, cut: int, overlap: int, ends: dict[int, int], base: int) -> int | None:
    """The first proven boundary from `cut` on and before `cut + overlap`, as an offset of the document; None where there is none.

    text starts at offset base of the document. A boundary is proven if a word ends and a blank starts there
    (no pre-token reaches over it, whatever stands further left or right) and this chunk's own encoding ends a token there.
    """
    for m in STABLE.finditer(text, max(cut - base, 1), min(cut + overlap - base, len(text))):
        if m.start() in ends and m.start() + base < cut + overlap:
            return m.start() + base
    return None


def count_tokens(
    docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = 1024, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_tokens, over_limit, n_chunks.

    Texts of at most `huge` code points are counted where they lie. A longer one becomes chunks of `chunk` code points that
    overlap by `overlap`, dealt out evenly, each encoded with offsets. Neighbours meet at the first boundary in their overlap that
    both encodings have and that holds whatever stands around it; each token counts in the one chunk that has it between its two
    meeting points. Where neighbours find no common point, the document is cut again with `WIDER` times the overlap and chunk, until
    a chunk holds all of it. Counts equal those of one encoding of the whole text.

    Null texts are empty and have 0 tokens; ids may be null or repeat; other columns are not read.
    """
    spark = docs.sparkSession
    key = id_type(docs, doc_id)
    rows = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    long = F.length("text") > huge

    def small():
        counts = remembered(PieceCounts, path)

        def each(batch: pa.RecordBatch):
            texts = texts_of(batch.column("text"))
            yield {"doc_id": batch.column("doc_id"), "n_bytes": [len(x.encode()) for x in texts], "n_tokens": counts.of(texts), "n_chunks": [1] * len(texts)}

        return each

    whole = map_batches(rows.where(~long), small, f"doc_id {key}, n_bytes bigint, n_tokens bigint, n_chunks bigint")
    cut = _spliced(rows.where(long), path, key, chunk, overlap)
    return whole.unionByName(cut).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chunks")


def _spliced(rows: DataFrame, path: str, key: str, chunk: int, overlap: int) -> DataFrame:
    """n_tokens of each long row, by chunks. A row is known by the hash of its text: rows of equal texts are counted once each round."""
    spark = rows.sparkSession
    left = rows.select("doc_id", "text", F.sha2("text", 256).alias("own"))
    done: list[DataFrame] = []
    while True:
        pieces = written(_chunk_counts(left, path, chunk, overlap), "chunks")
        sums = pieces.groupBy("own", "total").agg(
            F.sum("n_tokens").alias("n_tokens"), F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_chunks"),
            F.bool_and("met").alias("met"), (F.bit_xor(F.xxhash64("right")) == F.bit_xor(F.xxhash64("left"))).alias("same"),
        )
        state = written(sums.select("own", "n_tokens", "n_bytes", "n_chunks", (F.col("met") & F.col("same") & (F.col("n_chunks") == F.col("total"))).alias("good")), "splices")
        done.append(left.select("doc_id", "own").join(state.where("good"), "own").select("doc_id", "n_bytes", "n_tokens", "n_chunks"))
        failed = state.where("NOT good").select("own")
        if failed.isEmpty():
            break
        left = left.join(failed, "own", "left_semi")
        chunk, overlap = chunk * WIDER, overlap * WIDER
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def _chunk_counts(left: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    once = left.groupBy("own").agg(F.first("text").alias("text"))

    def cut(batch: pa.RecordBatch):
        for own, text in zip(batch.column("own").to_pylist(), texts_of(batch.column("text")), strict=True):
            total = max(1, -(-len(text) // chunk))
            for k in range(0, total, 64):
                some = range(k, min(k + 64, total))
                yield {"own": [own] * len(some), "total": [total] * len(some), "k": list(some), "part": [text[max(0, i * chunk - overlap) : (i + 1) * chunk + overlap] for i in some]}

    # a number of partitions of our own, as the chunks are few bytes but much work
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = map_batches(once, lambda: cut, "own string, total int, k int, part string").repartition(parts, "own", "k")

    def make():
        encode = held(("offsets", path), lambda: offset_tokenizer(path)).encode

        def each(batch: pa.RecordBatch):
            out: dict[str, list] = {k: [] for k in ("n_tokens", "n_bytes", "left", "right", "met")}
            parts = texts_of(batch.column("part"))
            ks, totals = batch.column("k").to_pylist(), batch.column("total").to_pylist()
            for text, k, total in zip(parts, ks, totals, strict=True):
                base = max(0, k * chunk - overlap)
                coded = encode(text, add_special_tokens=False)  # one at a time: encodings with offsets are large
                ends = {end: i + 1 for i, (_, end) in enumerate(coded.offsets)}  # tokens up to there
                a = 0 if k == 0 else seam(text, k * chunk, overlap, ends, base)
                b = base + len(text) if k == total - 1 else seam(text, (k + 1) * chunk, overlap, ends, base)
                met = a is not None and b is not None and a <= b
                own = text[a - base : b - base] if met else ""
                out["n_tokens"].append((len(coded) if k == total - 1 else ends[b - base]) - (ends[a - base] if k else 0) if met else 0)
                out["n_bytes"].append(len(own.encode()))
                out["left"].append(a if k else -1)  # the outer ends meet none
                out["right"].append(b if k < total - 1 else -1)
                out["met"].append(met)
            yield out | {c: batch.column(c) for c in ("own", "total")}

        return each

    return map_batches(dealt.select("own", "total", "k", "part"), make, "own string, total int, n_tokens bigint, n_bytes bigint, left bigint, right bigint, met boolean")
