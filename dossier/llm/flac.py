"""FLAC columns: payloads to FLAC files and back, many frames at a time.

The decoder reads mono streams of 8 bits a sample in blocks of 192 samples: constant, verbatim, fixed and linear predictors, Rice
partitions of either kind with escapes. The encoder writes such streams with a seek table.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_type, map_batches, raw_texts

BLOCK, RATE = 192, 8000
#: Frames from one seek point to the next.
SEEK_FRAMES = 64
#: Samples encoded or decoded at once, of many files or a part of one.
AT_ONCE = 786_432
#: Order of the linear predictor that each frame is tried with, beside the fixed ones.
LINEAR = 8


def _table(poly: int, width: int) -> np.ndarray:
    """CRC of each byte, most significant bit first."""
    out = np.arange(256, dtype=np.uint32) << (width - 8)
    for _ in range(8):
        out = np.where(out >> (width - 1) & 1, (out << 1) ^ poly, out << 1) & ((1 << width) - 1)
    return out


CRC8, CRC16 = _table(0x07, 8).astype(np.uint8), _table(0x8005, 16).astype(np.uint16)
#: Zero bits before the first one of 16.
ZEROS = np.array([16, *(15 - np.floor(np.log2(np.arange(1, 65536))).astype(int))], np.int64)


def crc8(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(starts), np.uint8)
    for i in range(int(sizes.max(initial=0))):
        crc = np.where(i < sizes, CRC8[crc ^ data[np.minimum(starts + i, len(data) - 1)]], crc)
    return crc


def crc16(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    crc = np.zeros(len(starts), np.uint16)
    live = len(starts)
    for i in range(int(sizes.max(initial=0))):
        while live and sizes[live - 1] <= i:
            live -= 1
        c = crc[:live]
        crc[:live] = (c << 8) ^ CRC16[(c >> 8) ^ data[starts[:live] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def coded_number(n: int) -> bytes:
    """A frame's number, as UTF-8 codes a code point."""
    if n < 128:
        return bytes([n])
    size = next(s for s in range(2, 8) if n < 1 << (5 * s + 1))
    return bytes([(0xFF00 >> size) & 0xFF | n >> 6 * (size - 1), *(0x80 | n >> 6 * i & 0x3F for i in range(size - 2, -1, -1))])


def _put(bits: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> None:
    """Writes values of `width` bits, one for each place."""
    for j in range(width):
        bits[at + j] = values >> (width - 1 - j) & 1


def linear_coefficients(x: np.ndarray, order: int, precision: int = 12) -> tuple[np.ndarray, int]:
    """Quantised predictors of each frame by the autocorrelation method, and their shift."""
    x = x.astype(float)
    r = np.stack([(x[:, : x.shape[1] - k] * x[:, k:]).sum(1) for k in range(order + 1)], 1)
    a, error = np.zeros((len(x), order)), r[:, 0] + 1e-9
    for i in range(order):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / error
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        error = error * (1 - k**2) + 1e-9
    shift = precision - 3
    return np.clip(np.rint(a * (1 << shift)), -(1 << precision - 1), (1 << precision - 1) - 1).astype(np.int64), shift


def encode_frames(samples: np.ndarray, numbers: list[int], orders: tuple[int, ...] = (0, 1, 2), linear: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all frames and the size of each. samples: a frame a row, int. Each frame takes the fixed predictor of those orders, or the linear one
    of order `linear`, that leaves least, or its samples as they are if that is shorter."""
    x = samples.astype(np.int32)
    f, n = x.shape
    everything = np.arange(f)
    tried: list[tuple[int, np.ndarray]] = []
    residual = x
    for o in range(max(orders) + 1):
        if o in orders:
            tried.append((o, residual))
        residual = np.diff(residual, axis=1)
    coefficients = shift = None
    if linear:
        coefficients, shift = linear_coefficients(x, linear)
        guess = sum(coefficients[:, j : j + 1] * x[:, linear - 1 - j : n - 1 - j] for j in range(linear)) >> shift
        tried.append((-linear, (x[:, linear:] - guess).astype(np.int32)))
    best = np.full(f, np.iinfo(np.int64).max)
    plan, rice, own = np.zeros(f, np.int64), np.zeros(f, np.int64), {}
    for what, e in tried:
        u = (e << 1) ^ (e >> 31)
        mean = np.maximum(u.sum(1, dtype=np.int64) // u.shape[1], 1)
        k = np.minimum(np.floor(np.log2(mean)).astype(np.int64), 14)
        for k_ in (k, np.maximum(k - 1, 0)):
            size = 18 + 8 * abs(what) + (0 if what >= 0 else 9 + 12 * linear) + (u >> k_[:, None].astype(np.int32)).sum(1, dtype=np.int64) + u.shape[1] * (1 + k_)
            better = size < best
            best[better], plan[better], rice[better] = size[better], what, k_[better]
        own[what] = u
    verbatim = best >= 8 + 8 * n
    best[verbatim], plan[verbatim] = 8 + 8 * n, 99
    heads = [b"\xff\xf8\x14\x02" + coded_number(i) for i in numbers]
    head = np.array([len(h) + 1 for h in heads])
    sizes = head + (best + 7) // 8 + 2
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    bits = np.zeros(8 * int(sizes.sum()), np.uint8)
    body = 8 * (starts + head)
    for what in np.unique(plan):
        rows = everything[plan == what]
        at = body[rows]
        if what == 99:
            _put(bits, at, np.full(len(rows), 1 << 1), 8)
            _put(bits, (at + 8)[:, None] + 8 * np.arange(n), x[rows] & 255, 8)
            continue
        o = abs(int(what))
        _put(bits, at, np.full(len(rows), (8 + o if what >= 0 else 32 + o - 1) << 1), 8)
        at = at + 8
        if o:
            _put(bits, at[:, None] + 8 * np.arange(o), x[rows, :o] & 255, 8)
            at = at + 8 * o
        if what < 0:
            _put(bits, at, np.full(len(rows), 11), 4)  # precision 12
            _put(bits, at + 4, np.full(len(rows), shift), 5)
            _put(bits, (at + 9)[:, None] + 12 * np.arange(o), coefficients[rows] & 4095, 12)
            at = at + 9 + 12 * o
        _put(bits, at + 6, rice[rows], 4)  # kind 0, one partition
        at = at + 10
        for k in np.unique(rice[rows]):
            some = rice[rows] == k
            u = own[int(what)][rows[some]].astype(np.int64)
            ends = at[some][:, None] + np.cumsum((u >> k) + 1 + k, axis=1)
            bits[ends - k - 1] = 1
            _put(bits, ends - k, u, int(k))
    data = np.packbits(bits)
    for size in np.unique(head):
        rows = everything[head == size]
        data[starts[rows][:, None] + np.arange(size - 1)] = np.frombuffer(b"".join(heads[i] for i in rows), np.uint8).reshape(len(rows), size - 1)
    data[starts + head - 1] = crc8(data, starts, head - 1)
    check = crc16(data, starts, sizes - 2)
    data[starts + sizes - 2], data[starts + sizes - 1] = check >> 8, check & 255
    return data, sizes


def _metadata(payload: bytes, signed: bytes, sizes: np.ndarray) -> bytes:
    frames = len(sizes)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    info = BLOCK.to_bytes(2, "big") * 2 + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(signed).digest()
    points = b"".join((i * BLOCK).to_bytes(8, "big") + int(offsets[i]).to_bytes(8, "big") + BLOCK.to_bytes(2, "big") for i in range(0, frames, SEEK_FRAMES))
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points


def encode(payloads: list[bytes], orders: tuple[int, ...] = (0, 1, 2), linear: int = 0) -> list[bytes]:
    """A FLAC file of each payload; a payload is a positive multiple of 192 bytes, taken as unsigned samples."""
    if not payloads:
        return []
    samples = (np.frombuffer(b"".join(payloads), np.uint8) ^ 128).view(np.int8).reshape(-1, BLOCK)
    counts = [len(p) // BLOCK for p in payloads]
    numbers = [i for n in counts for i in range(n)]
    step = AT_ONCE // BLOCK
    coded = [encode_frames(samples[i : i + step], numbers[i : i + step], orders, linear) for i in range(0, len(samples), step)]
    data, sizes = (np.concatenate(x) for x in zip(*coded, strict=True))
    signed = samples.tobytes()
    out, frame, byte = [], 0, 0
    for payload, n in zip(payloads, counts, strict=True):
        own = sizes[frame : frame + n]
        end = byte + int(own.sum())
        out.append(_metadata(payload, signed[frame * BLOCK : (frame + n) * BLOCK], own) + data[byte:end].tobytes())
        frame, byte = frame + n, end
    return out


class Bits:
    """Reads from many places of one buffer at once."""

    def __init__(self, data: np.ndarray) -> None:
        self.raw = np.concatenate([data, np.zeros(16, np.uint8)]).tobytes()
        self.words = np.ndarray((len(self.raw) - 7,), ">u8", self.raw, strides=(1,))

    def peek(self, at: np.ndarray) -> np.ndarray:
        """64 bits from each place, of which 57 hold."""
        return self.words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)

    def read(self, at: np.ndarray, width: int) -> np.ndarray:
        return (self.peek(at) >> np.uint64(64 - width)).astype(np.int64) if width else np.zeros(len(at), np.int64)

    def rice(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rice-coded values at each place with parameter k, and the places after them."""
        window = self.peek(at)
        zeros = ZEROS[window >> np.uint64(48)]
        if (zeros == 16).any():  # rare: long unary parts
            q, more = zeros.copy(), np.flatnonzero(zeros == 16)
            while len(more):
                step = ZEROS[self.peek(at[more] + q[more]) >> np.uint64(48)]
                q[more] += step
                more = more[step == 16]
                if (at + q > 8 * len(self.raw)).any():
                    raise ValueError("a residual runs out of the stream")
            at = at + q + 1
            window = self.peek(at)
        else:
            q = zeros
            window <<= (zeros + 1).astype(np.uint64)
            at = at + zeros + 1
        # a shift by 64 is not defined
        low = (window >> np.uint64(1) >> (63 - k).astype(np.uint64)).astype(np.int64)
        u = q << k | low
        return u >> 1 ^ -(u & 1), at + k


def _signed(x: np.ndarray, width: int) -> np.ndarray:
    return (x ^ 1 << width - 1) - (1 << width - 1)


def _header(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of frames at those places: the frame number, the header's size with its checksum, and whether it holds."""
    safe = np.concatenate([data, np.zeros(32, np.uint8)])
    first = safe[starts + 4].astype(np.int64)
    size = np.select([first < 0x80, first >> 5 == 6, first >> 4 == 14, first >> 3 == 30, first >> 2 == 62, first >> 1 == 126], [1, 2, 3, 4, 5, 6], 99)
    number = np.where(size == 1, first, first & (0x7F >> np.minimum(size, 6)))
    good = size < 99
    for i in range(1, 6):
        more = safe[starts + 4 + i].astype(np.int64)
        number = np.where(good & (i < size), number << 6 | more & 0x3F, number)
    head = np.where(good, 4 + size, 4)
    return number, head + 1, good & (crc8(safe, starts, head) == safe[starts + head])


def _frame_starts(data: np.ndarray, begin: int, end: int, frames: int) -> np.ndarray:
    """Places of the frames 0, 1, ... between begin and end: sync code, header checksum and number in order."""
    own = data[begin:end]
    found = np.flatnonzero((own[:-3] == 0xFF) & (own[1:-2] == 0xF8) & (own[2:-1] == 0x14) & (own[3:] == 0x02))
    number, _, good = _header(own, found)
    found, number = found[good], number[good]
    if len(found) != frames or (number != np.arange(frames)).any():  # a residual may look like a header
        places: dict[int, list[int]] = {}
        for at, n in zip(found.tolist(), number.tolist(), strict=True):
            places.setdefault(n, []).append(at)
        kept = [0]
        for n in range(1, frames):
            later = [at for at in places.get(n, []) if at > kept[-1]]
            if len(later) > 1:  # the one up to which the frame before has its checksum
                later = [at for at in later if int(crc16(own, np.array(kept[-1:]), np.array([at - 2 - kept[-1]]))[0]) == int(own[at - 2]) << 8 | int(own[at - 1])]
            if not later:
                raise ValueError("frames are missing")
            kept.append(later[0])
        found = np.array(kept, np.int64)
    return found + begin


def decode_frames(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int = BLOCK, bps: int = 8) -> np.ndarray:
    """Samples of each frame, which follow each other; raises ValueError where a frame's checksum does not hold."""
    _, head, good = _header(data, starts)
    stored = data[ends - 2].astype(np.uint16) << 8 | data[ends - 1]
    if not good.all() or (crc16(data, starts, ends - starts - 2) != stored).any():
        raise ValueError("a frame's checksum does not hold")
    bits = Bits(data)
    out = np.zeros((len(starts), n), np.int64)
    at = 8 * (starts + head)
    kind = bits.read(at, 8) >> 1
    at = at + 8
    for what in np.unique(kind):
        rows = np.flatnonzero(kind == what)
        if what == 0:
            out[rows] = _signed(bits.read(at[rows], bps), bps)[:, None]
        elif what == 1:
            out[rows] = _signed(bits.read((at[rows][:, None] + bps * np.arange(n)).ravel(), bps), bps).reshape(len(rows), n)
        elif 8 <= what <= 12 or what >= 32:
            out[rows] = _predicted(bits, at[rows], int(what - 8 if what < 32 else what - 31), what >= 32, n, bps)
        else:
            raise ValueError("reserved kind of subframe")
    return out


def _predicted(bits: Bits, at: np.ndarray, order: int, linear: bool, n: int, bps: int) -> np.ndarray:
    x = np.zeros((len(at), n), np.int64)
    for i in range(order):
        x[:, i] = _signed(bits.read(at, bps), bps)
        at = at + bps
    if linear:
        precision, shift = bits.read(at, 4) + 1, bits.read(at + 4, 5)
        at = at + 9
        c = np.zeros((len(at), order), np.int64)
        for p in np.unique(precision):
            some = precision == p
            for j in range(order):
                c[some, j] = _signed(bits.read(at[some] + p * j, int(p)), int(p))
        at = at + precision * order
    wide = 4 + bits.read(at, 2)  # bits of a Rice parameter
    parts = bits.read(at + 2, 4)
    at = at + 6
    for w in np.unique(wide):
        for p in np.unique(parts):
            some = np.flatnonzero((wide == w) & (parts == p))
            if len(some):
                x[some, order:] = _residual(bits, at[some], n, order, n >> p, int(w))
    if linear:
        for i in range(order, n):
            x[:, i] += (x[:, i - order : i][:, ::-1] * c).sum(1) >> shift
        return x
    # undo the differences, from the highest to the first
    start = [np.diff(x[:, :order], i, axis=1)[:, -1:] for i in range(order)]
    e = x[:, order:]
    for i in reversed(range(order)):
        e = start[i] + np.cumsum(e, axis=1)
    x[:, order:] = e
    return x


def _residual(bits: Bits, at: np.ndarray, n: int, order: int, part: int, wide: int) -> np.ndarray:
    out = np.zeros((len(at), n - order), np.int64)
    k = escaped = raw = None
    for i in range(order, n):
        if i == order or i % part == 0:
            k = bits.read(at, wide)
            at = at + wide
            escaped = k == (1 << wide) - 1
            if any_escaped := bool(escaped.any()):
                raw = np.where(escaped, bits.read(at, 5), 0)
                at = at + 5 * escaped
                k = np.where(escaped, 0, k)
        if not any_escaped:
            out[:, i - order], at = bits.rice(at, k)
            continue
        some = np.flatnonzero(~escaped)
        if len(some):
            out[some, i - order], at[some] = bits.rice(at[some], k[some])
        for r in np.unique(raw[escaped]):
            some = np.flatnonzero(escaped & (raw == r))
            if r:
                out[some, i - order] = _signed(bits.read(at[some], int(r)), int(r))
            at[some] += r
    return out


def decode(files: list[bytes]) -> list[bytes]:
    """The payloads of FLAC files that encode() wrote, or of like streams whose blocks all have 192 samples of 8 bits.

    Checks each frame's two checksums, the frame numbers, the number of samples and the MD5 sum of the samples; raises ValueError if one does not hold.
    """
    if not files:
        return []
    data = np.frombuffer(b"".join(files), np.uint8)
    base, starts, ends, counts, sums = 0, [], [], [], []
    for file in files:
        if file[:4] != b"fLaC" or file[4] & 0x7F:
            raise ValueError("not a FLAC stream")
        at, last = 4, False
        while not last:
            last = bool(file[at] & 0x80)
            size = int.from_bytes(file[at + 1 : at + 4], "big")
            if not file[at] & 0x7F:
                total = int.from_bytes(file[at + 14 : at + 22], "big")
                if file[at + 4 : at + 8] != BLOCK.to_bytes(2, "big") * 2 or total >> 36 & 0xFF != 7 or (total & (1 << 36) - 1) % BLOCK:
                    raise ValueError("blocks of 192 samples of 8 bits are read")
                sums.append(file[at + 22 : at + 38])
                counts.append((total & (1 << 36) - 1) // BLOCK)
            at += 4 + size
        own = _frame_starts(data, base + at, base + len(file), counts[-1])
        starts.append(own)
        ends.append(np.append(own[1:], base + len(file)))
        base += len(file)
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    parts = []
    for i in range(0, len(starts), step := AT_ONCE // BLOCK):
        a, b = starts[i : i + step], ends[i : i + step]
        parts.append(decode_frames(data[a[0] : b[-1]], a - a[0], b - a[0]).astype(np.int8))
    samples = np.concatenate(parts)
    out, at = [], 0
    for n, md5 in zip(counts, sums, strict=True):
        own = samples[at : at + n]
        if hashlib.md5(own.tobytes()).digest() != md5:
            raise ValueError("the samples' MD5 sum does not hold")
        out.append((own.view(np.uint8) ^ 128).tobytes())
        at += n
    return out


def blocks_of(payload: bytes, block: int) -> list[dict]:
    """PCM blocks of a payload read back: block_no, sample_offset, n_samples and pcm (signed 8-bit samples)."""
    out = []
    for number, at in enumerate(range(0, len(payload), block)):
        pcm = (np.frombuffer(payload[at : at + block], np.uint8) ^ 128).tobytes()
        out.append({"block_no": number, "sample_offset": at, "n_samples": len(pcm), "pcm": pcm})
    return out


def seek_table(file: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First samples of the seek points and their byte offsets in the file."""
    at, last, points = 4, False, b""
    while not last:
        last, size = bool(file[at] & 0x80), int.from_bytes(file[at + 1 : at + 4], "big")
        points = file[at + 4 : at + 4 + size] if file[at] & 0x7F == 3 else points
        at += 4 + size
    table = np.frombuffer(points, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")]))
    return table["sample"].astype(np.int64), table["offset"].astype(np.int64) + at


def seek(file: bytes, sample: int) -> tuple[int, int]:
    """The last seek point at or before a sample: its first sample and its byte offset in the file."""
    samples, offsets = seek_table(file)
    i = int(np.searchsorted(samples, sample, side="right")) - 1
    return int(samples[i]), int(offsets[i])


def padded(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % BLOCK or (0 if raw else BLOCK))


def feature(payload: bytes) -> str:
    """Of the samples: frames, peak, mean energy, and sign changes."""
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    return f"frames={len(x) // BLOCK};peak={int(np.abs(x).max())};energy={int((x * x).sum()) // len(x)};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def _groups(raws: list[bytes]):
    """Slices of a batch with about AT_ONCE bytes each."""
    start = size = 0
    for i, raw in enumerate(raws):
        size += len(raw)
        if size >= AT_ONCE:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(raws):
        yield slice(start, len(raws))


def _placed(blocks: list[dict], samples: np.ndarray, offsets: np.ndarray) -> list[dict]:
    """Blocks by their places in the samples and in the file: the last seek point at or before each."""
    at = offsets[np.searchsorted(samples, [x["sample_offset"] for x in blocks], side="right") - 1].tolist()
    return [{"sample_offset": x["sample_offset"], "byte_offset": place, "n_samples": x["n_samples"], "pcm_sha256": hashlib.sha256(x["pcm"]).hexdigest()} for x, place in zip(blocks, at, strict=True)]


def media_features(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", linear: int = LINEAR, block: int = SEEK_FRAMES * BLOCK, with_media: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, blocks, and with `with_media` the FLAC file.

    Each text's UTF-8 bytes, filled with blanks to a positive multiple of 192, are stored as FLAC, frame by frame with the fixed or linear
    predictor that leaves least, and read back from the stored bytes as PCM blocks of `block` samples; every digest of the payload is of these. `blocks` has each one's
    sample_offset, its place byte_offset in the file from the seek table, n_samples and pcm_sha256. No shuffle; about 1 MB is coded at once, of a longer text part by part.
    Null texts are empty; ids may be null or repeat; other columns are not read.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))

    def each(batch: pa.RecordBatch):
        raws = raw_texts(batch.column("text"))
        for part in _groups(raws):
            files = encode([padded(raw) for raw in raws[part]], linear=linear)
            pcm = [blocks_of(payload, block) for payload in decode(files)]
            back = [(np.frombuffer(b"".join(x["pcm"] for x in own), np.uint8) ^ 128).tobytes() for own in pcm]
            places = [_placed(own, *seek_table(file)) for file, own in zip(files, pcm, strict=True)]
            yield {
                "doc_id": batch.column("doc_id")[part], "n_bytes": [len(raw) for raw in raws[part]], "payload_bytes": [len(p) for p in back],
                "payload_sha256": [hashlib.sha256(p).hexdigest() for p in back], "tail_crc32": [zlib.crc32(p[-16:]) for p in back], "media_bytes": [len(x) for x in files],
                "media_sha256": [hashlib.sha256(x).hexdigest() for x in files], "feature": [feature(p) for p in back], "blocks": places, "media": files,
            }

    return map_batches(
        rows, lambda: each,
        f"doc_id {id_type(docs, doc_id)}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, blocks array<struct<sample_offset:bigint,byte_offset:bigint,n_samples:bigint,pcm_sha256:string>>" + ", media binary" * with_media,
    )


def pcm_blocks(media: DataFrame, *, key: str = "doc_id", column: str = "media", block: int = SEEK_FRAMES * BLOCK) -> DataFrame:
    """Decodes a column of FLAC files into PCM blocks: a row for each with the key, block_no, sample_offset, n_samples and pcm (signed 8-bit samples).

    Null files give no blocks. A stream whose checksums do not hold fails the task.
    """
    rows = media.where(media[column].isNotNull()).select(media[key].alias("key"), media[column].alias("media"))

    def each(batch: pa.RecordBatch):
        files = [bytes(x) for x in batch.column("media").to_pylist()]
        for part in _groups(files):
            out: dict[str, list] = {k: [] for k in ("row", "block_no", "sample_offset", "n_samples", "pcm")}
            for row, payload in enumerate(decode(files[part])):
                for x in blocks_of(payload, block):
                    for name, value in ({"row": row} | x).items():
                        out[name].append(value)
            yield {"key": batch.column("key")[part].take(pa.array(out.pop("row"), pa.int64())), **out}

    return map_batches(rows, lambda: each, f"key {id_type(media, key)}, block_no bigint, sample_offset bigint, n_samples bigint, pcm binary").withColumnRenamed("key", key)
