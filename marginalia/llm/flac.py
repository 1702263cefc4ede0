"""Media columns: FLAC streams from samples and back, with checked frames and seekable sample offsets.

The encoder writes one-channel streams of 8-bit samples: fixed-size blocks, each constant, verbatim, or a fixed linear predictor with a Rice-coded
residual, whichever is smallest, and a seek table with a point for every block.  ``decode`` reads any FLAC stream of up to
eight channels (fixed and LPC predictors, Rice partitions and their escapes, stereo decorrelation) and checks both frame checksums
and the MD5 sum.  ``decode_many`` reads many one-channel streams at once: it walks the Rice codes of a bounded group of blocks in step, a
vector operation per sample number.  ``pcm_blocks`` turns a column of streams into rows of PCM blocks with their places.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import pick

BLOCK = 4096
RATE = 8000
#: Payload bytes that are encoded and read back together.
RUN_BYTES = 1_500_000
#: Bytes of frames that are walked in step: decoding needs some hundred bytes of memory for each, whatever the texts' lengths.
GROUP_BYTES = 1_000_000
#: Payloads are padded with zeros to a positive multiple of this.
PAD = 64

_CRC8 = []
for _b in range(256):
    for _ in range(8):
        _b = (_b << 1 ^ 0x07) & 0xFF if _b & 0x80 else _b << 1
    _CRC8.append(_b)
_CRC16 = []
for _b in range(256):
    _b <<= 8
    for _ in range(8):
        _b = (_b << 1 ^ 0x8005) & 0xFFFF if _b & 0x8000 else _b << 1
    _CRC16.append(_b)
_AHEAD: list = []
_SPAN = 4608


class FlacError(ValueError):
    """A stream that breaks the format or fails a checksum."""


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16(data: bytes) -> int:
    """CRC-16 of a frame, from the share that each byte has at its distance from the end."""
    import numpy as np

    if not _AHEAD:
        table = np.array(_CRC16, dtype=np.uint16)
        rows = np.empty((_SPAN, 256), dtype=np.uint16)
        rows[0] = table
        for d in range(1, _SPAN):
            rows[d] = rows[d - 1] << 8 ^ table[rows[d - 1] >> 8]
        _AHEAD.append(rows.ravel())
        _AHEAD.append(np.arange(_SPAN - 1, -1, -1, dtype=np.int64) * 256)
    table, at = _AHEAD
    crc = 0
    for i in range(0, len(data), _SPAN - 2):
        part = np.frombuffer(data[i : i + _SPAN - 2], dtype=np.uint8)
        if crc:
            lead = np.zeros(max(2, len(part)), dtype=np.uint8)
            lead[: len(part)] = part
            if len(part) < 2:
                for b in part.tolist():
                    crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ b]
                continue
            lead[0] ^= crc >> 8
            lead[1] ^= crc & 0xFF
            part = lead
        crc = int(np.bitwise_xor.reduce(table[at[_SPAN - len(part) :] + part]))
    return crc


def _number(n: int) -> bytes:
    """A frame number in the extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    tail = []
    size = 2
    while n >= 1 << (5 * size + 1):
        size += 1
    for _ in range(size - 1):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF << (8 - size)) & 0xFF | n, *tail[::-1]])


def encode_frame(x, number: int, bits: int = 8) -> bytes:
    """One block of samples (signed) as a frame."""
    import numpy as np

    n = len(x)
    head = b"\xff\xf8" + bytes([0x70, {8: 0x02, 16: 0x08}[bits]]) + _number(number) + struct.pack(">H", n - 1)
    head += bytes([crc8(head)])
    x = np.asarray(x, dtype=np.int64)
    if (x == x[0]).all():
        body = b"\x00" + int(x[0]).to_bytes(bits // 8, "big", signed=True)
    else:
        residuals = [x]
        for _ in range(min(3, n - 1)):
            residuals.append(np.diff(residuals[-1]))
        order = min(range(len(residuals)), key=lambda o: np.abs(residuals[o]).sum() / len(residuals[o]))
        e = residuals[order]
        u = (e << 1) ^ (e >> 63)
        guess = max(0, int(u.mean()).bit_length() - 1)
        k = min((k for k in {max(0, guess - 1), guess, guess + 1} if k < 15), key=lambda k: (int((u >> k).sum()) + (k + 1) * len(u), k), default=14)
        q = u >> k
        size = int(q.sum()) + (k + 1) * len(u)
        if size + 10 + order * bits >= n * bits:
            body = b"\x02" + x.astype(">i2" if bits == 16 else ">i1").tobytes()
        else:
            lead = f"0{8 + order:06b}0"
            lead += "".join(format(int(v) & (1 << bits) - 1, f"0{bits}b") for v in x[:order]) + f"000000{k:04b}"
            made = np.zeros(len(lead) + size, dtype=np.uint8)
            made[: len(lead)] = np.frombuffer(lead.encode(), dtype=np.uint8) - 48
            ends = np.cumsum(q + (k + 1)) + (len(lead) - k - 1)
            made[ends] = 1
            for j in range(k):
                made[ends + (1 + j)] = u >> (k - 1 - j) & 1
            body = np.packbits(made).tobytes()
    frame = head + body
    return frame + struct.pack(">H", crc16(frame))


def encode(samples, bits: int = 8, rate: int = RATE, block: int = BLOCK) -> bytes:
    """A FLAC stream of one channel, with a seek table of every block; without samples only its header."""
    import numpy as np

    x = np.asarray(samples)
    frames = [encode_frame(x[i : i + block], number, bits) for number, i in enumerate(range(0, len(x), block))]
    sizes = [len(f) for f in frames] or [0]
    md5 = hashlib.md5(x.astype("<i2" if bits == 16 else "<i1").tobytes()).digest()
    info = struct.pack(">HH", block, block) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (rate << 44 | 0 << 41 | (bits - 1) << 36 | len(x)).to_bytes(8, "big") + md5
    points, at = [], 0
    for number, f in enumerate(frames):
        points.append(struct.pack(">QQH", number * block, at, min(block, len(x) - number * block)))
        at += len(f)
    seek = b"".join(points)
    blocks = bytes([0 if seek else 0x80]) + len(info).to_bytes(3, "big") + info
    if seek:
        blocks += b"\x83" + len(seek).to_bytes(3, "big") + seek
    return b"fLaC" + blocks + b"".join(frames)


def header(stream: bytes) -> dict:
    """STREAMINFO, the seek points and where the frames begin."""
    if stream[:4] != b"fLaC":
        raise FlacError("not a FLAC stream")
    at, out = 4, {"points": []}
    while True:
        if at + 4 > len(stream):
            raise FlacError("metadata is cut short")
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        data = stream[at + 4 : at + 4 + size]
        if kind & 0x7F == 0:
            packed = int.from_bytes(data[10:18], "big")
            out |= {"rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": data[18:34]}
        elif kind & 0x7F == 3:
            out["points"] = [p for p in struct.iter_unpack(">QQH", data) if p[0] != (1 << 64) - 1]
        at += 4 + size
        if kind & 0x80:
            break
    if "rate" not in out:
        raise FlacError("no STREAMINFO")
    return out | {"frames": at}


class _Bits:
    """Reads bits of a byte string from the left."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.end = data, at * 8, len(data) * 8

    def take(self, n: int) -> int:
        if not n:
            return 0
        stop = self.at + n
        if stop > self.end:
            raise FlacError("a frame is cut short")
        first, last = self.at >> 3, (stop + 7) >> 3
        value = int.from_bytes(self.data[first:last], "big") >> (last * 8 - stop) & (1 << n) - 1
        self.at = stop
        return value

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def _residual(b: _Bits, order: int, n: int) -> list[int]:
    method, parts = b.take(2), b.take(4)
    if method > 1:
        raise FlacError("unknown residual coding")
    wide, out = 4 + method, []
    if n % (1 << parts) or (n >> parts) < order:
        raise FlacError("uneven residual partitions")
    for p in range(1 << parts):
        count = (n >> parts) - (order if p == 0 else 0)
        k = b.take(wide)
        if k == (1 << wide) - 1:
            raw = b.take(5)
            out += [b.signed(raw) for _ in range(count)]
        else:
            for _ in range(count):
                u = b.unary() << k | b.take(k)
                out.append(u >> 1 ^ -(u & 1))
    return out


_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _subframe(b: _Bits, n: int, bits: int) -> list[int]:
    if b.take(1):
        raise FlacError("bad subframe header")
    kind, wasted = b.take(6), 0
    if b.take(1):
        wasted = b.unary() + 1
        bits -= wasted
    if kind == 0:
        x = [b.signed(bits)] * n
    elif kind == 1:
        x = [b.signed(bits) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        x = [b.signed(bits) for _ in range(order)]
        shift, coefficients = 0, _FIXED[order] if kind < 32 else ()
        if kind >= 32:
            precision = b.take(4) + 1
            shift = b.signed(5)
            coefficients = tuple(b.signed(precision) for _ in range(order))
        for e in _residual(b, order, n):
            x.append(e + (sum(c * v for c, v in zip(coefficients, x[: -order - 1 : -1] if order else ())) >> shift))
    else:
        raise FlacError("reserved subframe type")
    return [v << wasted for v in x] if wasted else x


def _frame_header(data: bytes, at: int, info: dict) -> tuple[int, int, int, int]:
    """(block size, channel assignment, bits, where the first subframe begins), the header's checksum verified."""
    if len(data) < at + 6 or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise FlacError("no frame where one is due")
    size, rate, channels, depth = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    b = at + 4
    lead = data[b]
    b += 1 if lead < 0x80 else next(i for i in range(8) if not lead << i & 0x80)
    if size == 6:
        n, b = data[b] + 1, b + 1
    elif size == 7:
        n, b = int.from_bytes(data[b : b + 2], "big") + 1, b + 2
    elif size == 1:
        n = 192
    elif 2 <= size <= 5:
        n = 576 << (size - 2)
    elif size >= 8:
        n = 256 << (size - 8)
    else:
        raise FlacError("reserved block size")
    b += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if b >= len(data) or crc8(data[at:b]) != data[b]:
        raise FlacError("a frame header's checksum is wrong")
    bits = {0: info["bits"], 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}.get(depth)
    if bits is None or channels > 10:
        raise FlacError("reserved sample size or channels")
    return n, channels, bits, b + 1


def decode_frame(data: bytes, at: int, info: dict) -> tuple[list[list[int]], int]:
    """The channels of the frame at a byte offset, and where the next one begins."""
    n, mode, bits, start = _frame_header(data, at, info)
    b = _Bits(data, start)
    count = mode + 1 if mode < 8 else 2
    x = [_subframe(b, n, bits + ((mode == 8 and c == 1) or (mode == 9 and c == 0) or (mode == 10 and c == 1))) for c in range(count)]
    if mode == 8:
        x[1] = [left - side for left, side in zip(*x)]
    elif mode == 9:
        x[0] = [side + right for side, right in zip(*x)]
    elif mode == 10:
        full = [(mid << 1 | side & 1, side) for mid, side in zip(*x)]
        x = [[(m + s) >> 1 for m, s in full], [(m - s) >> 1 for m, s in full]]
    end = (b.at + 7) >> 3
    if len(data) < end + 2 or crc16(data[at:end]) != int.from_bytes(data[end : end + 2], "big"):
        raise FlacError("a frame's checksum is wrong")
    return x, end + 2


def decode(stream: bytes) -> tuple[list[list[int]], dict]:
    """All samples of a stream, by channel, and its header; sample by sample, for streams of any kind."""
    info = header(stream)
    x: list[list[int]] = [[] for _ in range(info["channels"])]
    at = info["frames"]
    while at < len(stream):
        got, at = decode_frame(stream, at, info)
        for own, more in zip(x, got):
            own += more
    if info["samples"] and len(x[0]) != info["samples"]:
        raise FlacError("samples are missing")
    size = (info["bits"] + 7) // 8
    if any(info["md5"]) and hashlib.md5(b"".join(v.to_bytes(size, "little", signed=True) for row in zip(*x) for v in row)).digest() != info["md5"]:
        raise FlacError("the stream's MD5 sum is wrong")
    return x, info


def seek(stream: bytes, first: int, count: int) -> list[int]:
    """Samples ``first`` to ``first + count`` of the first channel, from the seek point before them."""
    info = header(stream)
    point = max((p for p in info["points"] if p[0] <= first), default=(0, 0, 0))
    at, have, out = info["frames"] + point[1], point[0], []
    while at < len(stream) and have < first + count:
        got, at = decode_frame(stream, at, info)
        out += got[0][max(0, first - have) : first + count - have]
        have += len(got[0])
    return out


def decode_many(streams: list[bytes]) -> list:
    """The samples of many one-channel streams, as arrays; all checksums verified.

    Blocks with one Rice partition and a fixed predictor, at a seek point, are walked in step; the rest go through ``decode_frame``.
    """
    import numpy as np

    infos = [header(s) for s in streams]
    out = [np.zeros(i["samples"], dtype=np.int16 if i["bits"] <= 16 else np.int64) for i in infos]
    fast: list[tuple] = []  # stream, first sample, size, order, warm-up, k, bit where the residual begins
    data: list[bytes] = []
    base = 0
    for s, (stream, info) in enumerate(zip(streams, infos)):
        x = out[s]
        points = sorted(info["points"])
        known = info["channels"] == 1 and (sum(p[2] for p in points) == info["samples"])
        if not known:
            x[:] = decode(stream)[0][0]
            continue
        ends = [info["frames"] + p[1] for p in points[1:]] + [len(stream)]
        for (first, offset, size), end in zip(points, ends):
            at = info["frames"] + offset
            n, mode, bits, start = _frame_header(stream, at, info)
            if n != size or crc16(stream[at : end - 2]) != int.from_bytes(stream[end - 2 : end], "big"):
                raise FlacError("a frame's checksum is wrong")
            kind = stream[start]
            if kind == 2 and bits in (8, 16):
                x[first : first + n] = np.frombuffer(stream, dtype=f">i{bits // 8}", count=n, offset=start + 1)
                continue
            order = (kind >> 1) - 8
            b = _Bits(stream, start + 1)
            warm = [b.signed(bits) for _ in range(order)] if 0 <= order <= 4 and not kind & 1 else []
            if 0 <= order <= 4 and not kind & 1 and b.take(6) == 0 and (k := b.take(4)) != 15:
                fast.append((s, first, n, order, warm, k, base * 8 + b.at - at * 8))
                data.append(stream[at:end])
                base += end - at
                if base >= GROUP_BYTES:
                    _walk(fast, data, out)
                    fast, data, base = [], [], 0
            else:
                x[first : first + n] = decode_frame(stream, at, info)[0][0]
    if fast:
        _walk(fast, data, out)
    for x, info in zip(out, infos):
        if hashlib.md5(x.astype("<i2" if info["bits"] == 16 else "<i1").tobytes()).digest() != info["md5"]:
            raise FlacError("the stream's MD5 sum is wrong")
    return out


def _walk(fast: list[tuple], data: list[bytes], out: list) -> None:
    """Decode a group of blocks with one Rice partition in step, into the arrays of ``out``."""
    import numpy as np

    own = sorted(fast, key=lambda f: f[3] - f[2])
    bits = np.unpackbits(np.frombuffer(b"".join(data), dtype=np.uint8))
    size = len(bits)  # a group is a few megabytes at most: its bits are numbered well within 32 bits
    ones = np.where(bits, np.arange(size, dtype=np.int32), np.int32(size))
    following = np.minimum.accumulate(ones[::-1])[::-1]
    following = np.append(following, np.full(64, size, dtype=np.int32))
    counts = np.array([f[2] - f[3] for f in own])
    k = np.array([f[5] for f in own], dtype=np.int32)
    at = np.array([f[6] for f in own], dtype=np.int32)
    longest = int(counts[0])
    ends = np.zeros((longest, len(own)), dtype=np.int32)
    begins = np.zeros((longest, len(own)), dtype=np.int32)
    active = np.searchsorted(-counts, -np.arange(1, longest + 1), side="right")
    step = k + 1
    for i in range(longest):
        m = active[i]
        begins[i, :m] = at[:m]
        t = following[at[:m]]
        ends[i, :m] = t
        at = np.minimum(t + step[:m], size)
    u = (ends - begins).astype(np.int64)
    padded = np.append(bits, np.zeros(64, dtype=np.uint8))
    for j in range(int(k.max(initial=0))):
        use = np.flatnonzero(k > j)
        u[:, use] = u[:, use] << 1 | padded[ends[:, use] + (1 + j)]
    e = u >> 1 ^ -(u & 1)
    for c, (s, first, n, order, warm, _, _) in enumerate(own):
        v = e[: n - order, c]
        seeds = [np.asarray(warm, dtype=np.int64)]  # the warm-up and its differences
        for _ in range(order - 1):
            seeds.append(np.diff(seeds[-1]))
        for o in range(order, 0, -1):
            v = np.concatenate([seeds[o - 1], seeds[o - 1][-1] + np.cumsum(v)]) if o == order else np.concatenate([seeds[o - 1][:1], seeds[o - 1][0] + np.cumsum(v)])
        out[s][first : first + n] = v


def blocks(stream: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(first sample, samples, byte offset of the frame, little-endian PCM with channels interleaved) of every frame, checksums verified."""
    info = header(stream)
    at, first, size = info["frames"], 0, (info["bits"] + 7) // 8
    while at < len(stream):
        x, after = decode_frame(stream, at, info)
        yield first, len(x[0]), at, b"".join(v.to_bytes(size, "little", signed=True) for row in zip(*x) for v in row)
        at, first = after, first + len(x[0])
    if info["samples"] and first != info["samples"]:
        raise FlacError("samples are missing")


def pcm_blocks(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per frame of a column of FLAC streams: the key, block, first_sample, n_samples, byte_offset, pcm, error.

    A reader finds sample s in the last block whose first_sample is at most s.  Defined cases: a null stream gives no row; one that is
    damaged gives its sound blocks and then a row with the error and no PCM; repeated and null keys give their rows each; further columns are ignored.
    """
    from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

    names = [("block", LongType()), ("first_sample", LongType()), ("n_samples", LongType()), ("byte_offset", LongType()), ("pcm", BinaryType()), ("error", StringType())]
    schema = StructType([media.schema[key], *[StructField(n, t) for n, t in names]])

    def made(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows(own, stream):
            k = 0
            try:
                for first, n, at, pcm in blocks(stream):
                    yield own, k, first, n, at, pcm, None
                    k += 1
            except (FlacError, IndexError, struct.error) as exc:
                yield own, k, None, None, None, None, str(exc) or type(exc).__name__

        def batch_of(out: list[tuple], kind) -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [key, *[n for n, _ in names]])

        for batch in batches:
            out, size = [], 0
            for own, stream in zip(batch.column(0).to_pylist(), batch.column(1)):
                for row in rows(own, stream.as_py()) if stream.is_valid else ():
                    out.append(row)
                    size += len(row[5] or b"")
                    if size > RUN_BYTES:
                        yield batch_of(out, batch.column(0).type)
                        out, size = [], 0
            if out:
                yield batch_of(out, batch.column(0).type)

    return pick(media, [key, column]).mapInArrow(made, schema)


def features(x) -> str:
    """Whole-number statistics of samples: count, sum, energy, extremes, zero crossings, and the energies of eight equal parts."""
    import numpy as np

    x = np.asarray(x)
    parts = [int(np.square(p.astype(np.int64)).sum()) for p in np.array_split(x, 8)]
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"n={len(x)};sum={int(x.sum(dtype=np.int64))};energy={sum(parts)};min={int(x.min(initial=0))};max={int(x.max(initial=0))};crossings={crossings};parts=" + ",".join(map(str, parts))


RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """One row per input row: the texts stored as FLAC, read back and described; on request with the streams as ``media``.

    Defined cases: a null text is an empty one, and an empty one is 64 zero bytes; null ids and repeated rows keep their rows; texts of any length are stored
    whole; equal texts give equal values; an empty table gives no row; further columns are ignored.
    """

    def stored(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        def finish(run: list[tuple]) -> pa.RecordBatch:
            rows = []
            for (doc_id, n, stream), x in zip(run, decode_many([r[2] for r in run])):
                payload = (x + 128).astype(np.uint8).tobytes()
                row = (doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(stream), hashlib.sha256(stream).hexdigest(), features(x))
                rows.append(row + ((stream,) if keep_media else ()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * keep_media
            names = [c.split()[0] for c in RESULT.split(", ")] + ["media"] * keep_media
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        run, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (text.as_py() or "").encode()
                payload = raw + bytes(PAD - len(raw) % PAD if len(raw) % PAD or not raw else 0)
                run.append((doc_id, len(raw), encode(np.frombuffer(payload, dtype=np.uint8).astype(np.int16) - 128)))
                size += len(payload)
                if size > RUN_BYTES:
                    yield finish(run)
                    run, size = [], 0
        if run:
            yield finish(run)

    rows = pick(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(stored, RESULT + ", media binary" * keep_media)
