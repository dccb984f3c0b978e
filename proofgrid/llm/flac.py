"""FLAC columns: Rice-coded residuals of linear predictors, with checked frames and seekable PCM blocks.

Fixed values of the format (RFC 9639) are the code tables, sync code and checksum polynomials below.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

BLOCK = 4608  # samples of a frame; the last one may hold less
UNIT = 192  # texts are padded to a multiple of this
RATE = 8000
CHUNK = 1 << 19  # samples or bytes that are coded at once
MOST_RICE = 14  # 15 marks an unencoded partition

_FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}  # fixed predictors
_BLOCK_CODES = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}
_DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


class BadMedia(ValueError):
    """The bytes are no FLAC stream, or a checksum does not hold."""


def _crc_table(width: int, polynomial: int) -> np.ndarray:
    top, mask = 1 << (width - 1), (1 << width) - 1
    out = []
    for value in range(256):
        rest = value << (width - 8)
        for _ in range(8):
            rest = ((rest << 1) ^ polynomial if rest & top else rest << 1) & mask
        out.append(rest)
    return np.array(out, np.uint16)


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)
_AHEAD = [_CRC16]  # rows of _ahead(): a byte's part in the checksum when j bytes follow it


def _ahead(length: int) -> np.ndarray:
    """Checksums are linear: a message's is the XOR of its bytes' parts, each by its place from the end."""
    have = _AHEAD[0] if _AHEAD[0].ndim == 2 else _AHEAD[0][None]
    if len(have) < length:
        rows = list(have)
        while len(rows) < max(length, 2 * len(have)):
            rows.append((rows[-1] << np.uint16(8)) ^ _CRC16[rows[-1] >> np.uint16(8)])
        _AHEAD[0] = have = np.array(rows, np.uint16)
    return have


def crc8(data: bytes) -> int:
    value = 0
    for byte in data:
        value = int(_CRC8[value ^ byte])
    return value


def crc16s(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The checksum of each (non-empty) stretch of ``data``."""
    lengths = stops - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths)
    parts = _ahead(int(lengths.max()))[np.repeat(lengths, lengths) - 1 - place, data[np.repeat(starts, lengths) + place]]
    return np.bitwise_xor.reduceat(parts, offsets[:-1])


def _coded_number(n: int) -> bytes:
    """A number in the way of UTF-8, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    count = next(c for c in range(2, 8) if n < 1 << (5 * c + 1))
    tail = [0x80 | (n >> 6 * i) & 0x3F for i in range(count - 1)][::-1]
    lead = (0xFF << (8 - count)) & 0xFF
    return bytes([lead | n >> 6 * (count - 1), *tail])


def _frame_header(number: int, size: int) -> bytes:
    """Mono, 8 bits, 8 kHz, fixed block size."""
    code = next((c for c, s in _BLOCK_CODES.items() if s == size), 7)
    head = bytes([0xFF, 0xF8, code << 4 | 4, 1 << 1]) + _coded_number(number)
    if code == 7:
        head += (size - 1).to_bytes(2, "big")
    return head + bytes([crc8(head)])


def _stream_info(samples: int, digest: bytes, block: int = BLOCK) -> bytes:
    packed = RATE << 44 | 0 << 41 | (8 - 1) << 36 | samples
    body = block.to_bytes(2, "big") * 2 + bytes(6) + packed.to_bytes(8, "big") + digest
    return b"fLaC" + bytes([0x80]) + len(body).to_bytes(3, "big") + body


_HEADERS: dict[tuple[int, int], bytes] = {}


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream per payload, whose bytes become signed 8-bit samples (128 is 0).

    Frames take the fixed predictor of order 0, 1 or 2 with the least sum of residuals, and one Rice
    parameter. All frames are coded at once. An empty payload is a stream without frames.
    """
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    x = raw.astype(np.int32) - 128
    sizes, owner = [], []
    for i, p in enumerate(payloads):
        full, rest = divmod(len(p), BLOCK)
        sizes += [BLOCK] * full + [rest] * (rest > 0)
        owner += [i] * (full + (rest > 0))
    if not sizes:
        return [_stream_info(0, hashlib.md5(b"").digest()) for _ in payloads]
    size, own = np.array(sizes), np.array(owner)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(len(x)) - np.repeat(first, size)

    residuals = [x]
    for order in (1, 2):
        before = residuals[-1]
        step = before - np.concatenate([[0], before[:-1]]).astype(np.int32)
        residuals.append(step)
    sums = np.stack([np.add.reduceat(np.where(place < order, 0, np.abs(r)), first) for order, r in enumerate(residuals)])
    order = np.minimum(sums.argmin(axis=0), size - 1)
    at = np.repeat(order, size)
    r = np.where(at == 0, residuals[0], np.where(at == 1, residuals[1], residuals[2]))
    u = ((r << 1) ^ (r >> 31)).astype(np.int64)
    u[place < at] = 0
    mean = np.add.reduceat(u, first) // np.maximum(size - order, 1)
    rice = np.clip(np.frexp(mean.astype(np.float64))[1] - 1, 0, MOST_RICE)
    k = np.repeat(rice, size)
    coded = place >= at
    length = np.where(coded, (u >> k) + 1 + k, 0)

    numbers = np.arange(len(size)) - np.searchsorted(own, own)
    heads = []
    for key in zip(numbers.tolist(), size.tolist()):
        if key not in _HEADERS:
            if len(_HEADERS) > 100_000:
                _HEADERS.clear()
            _HEADERS[key] = _frame_header(*key)
        heads.append(_HEADERS[key])
    head = np.array([len(h) for h in heads])
    prefix = 8 + 8 * order + 10
    body = (prefix + np.add.reduceat(length, first) + 7) // 8
    total = head + body + 2
    begin = np.concatenate([[0], np.cumsum(total)])
    bits = np.zeros(8 * int(begin[-1]), np.uint8)
    base = 8 * (begin[:-1] + head)
    for b in range(4):
        bits[base + prefix - 4 + b] = rice >> (3 - b) & 1
    inside = np.cumsum(length) - length
    start = inside - np.repeat(inside[first], size) + np.repeat(base + prefix, size)
    one = (start + (u >> k))[coded]
    bits[one] = 1
    low, width = u[coded], k[coded]
    for b in range(int(rice.max())):
        has = width > b
        bits[(one + width - b)[has]] = low[has] >> b & 1
    data = np.packbits(bits)
    sub = begin[:-1] + head
    data[sub] = 0x10 | order << 1
    for w in (0, 1):
        some = order > w
        data[sub[some] + 1 + w] = (x[first[some] + w] & 0xFF).astype(np.uint8)
    for h, b in zip(heads, begin.tolist()):
        data[b : b + len(h)] = np.frombuffer(h, np.uint8)
    checks = crc16s(data, begin[:-1], begin[1:] - 2)
    data[begin[1:] - 2], data[begin[1:] - 1] = checks >> 8, checks & 0xFF
    signed = x.astype(np.int8)
    ends, out, offset = begin[np.searchsorted(own, np.arange(len(payloads) + 1))], [], 0
    for i, p in enumerate(payloads):
        info = _stream_info(len(p), hashlib.md5(signed[offset : offset + len(p)].tobytes()).digest())
        out.append(info + data[ends[i] : ends[i + 1]].tobytes())
        offset += len(p)
    return out


class _Bits:
    """A reader of single frames, for what the joint way does not cover."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, 8 * at

    def take(self, n: int) -> int:
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        if last > len(self.data):
            raise BadMedia("a frame ends early")
        value = int.from_bytes(self.data[first:last], "big") >> (8 * last - self.at - n)
        self.at += n
        return value & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def zeros(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def _header(data: bytes, at: int, depth: int) -> tuple[int, int, int, int, int]:
    """Of the frame at ``at``: header bytes, block size, channel code, sample bits, frame or sample number."""
    if len(data) < at + 6 or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise BadMedia("no frame where one should be")
    code, rate = data[at + 2] >> 4, data[at + 2] & 15
    channels, bits = data[at + 3] >> 4, data[at + 3] >> 1 & 7
    lead, place = data[at + 4], at + 5
    more = 0 if lead < 0x80 else (lead ^ 0xFF).bit_length()
    more = 0 if lead < 0x80 else 8 - more - 1
    number = lead if lead < 0x80 else lead & ((1 << (6 - more)) - 1) if more < 6 else 0
    if len(data) < place + more + 5:
        raise BadMedia("a frame ends early")
    for byte in data[place : place + more]:
        number = number << 6 | byte & 0x3F
    place += more
    size = _BLOCK_CODES.get(code, 0)
    if code in (6, 7):
        size = int.from_bytes(data[place : place + code - 5], "big") + 1
        place += code - 5
    place += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if not size or rate == 15 or channels > 10 or bits == 3 or data[at + 3] & 1:
        raise BadMedia("a frame has reserved codes")
    if crc8(data[at:place]) != data[place]:
        raise BadMedia("a frame header's checksum does not hold")
    return place + 1 - at, size, channels, _DEPTHS.get(bits, depth), number


def _residual(bits: _Bits, size: int, order: int) -> np.ndarray:
    wide = {0: 4, 1: 5}.get(bits.take(2))
    if wide is None:
        raise BadMedia("a residual has a reserved code")
    parts = 1 << bits.take(4)
    if size % parts or size // parts < order:
        raise BadMedia("a residual's partitions do not fit")
    out = []
    for i in range(parts):
        n = size // parts - (order if i == 0 else 0)
        k = bits.take(wide)
        if k == (1 << wide) - 1:
            raw = bits.take(5)
            out += [bits.signed(raw) if raw else 0 for _ in range(n)]
        else:
            coded = [bits.zeros() << k | bits.take(k) for _ in range(n)]
            out += [v >> 1 ^ -(v & 1) for v in coded]
    return np.array(out, np.int64)


def predict(warm: np.ndarray, residual: np.ndarray, coefficients: tuple[int, ...], shift: int) -> np.ndarray:
    """Samples of frames (rows) from their first ones and the residuals of a linear predictor."""
    order, size = warm.shape[1], warm.shape[1] + residual.shape[1]
    out = np.zeros((size, len(warm)), np.int64)
    out[:order] = warm.T
    if coefficients == _FIXED.get(order) and shift == 0:
        # fixed predictors are running sums of the residual, one for each order
        if order == 0:
            return residual.astype(np.int64)
        steps = [np.diff(warm.astype(np.int64), n, axis=1)[:, -1] for n in range(order)]
        value = residual.astype(np.int64)
        for n in range(order - 1, -1, -1):
            value = np.cumsum(value, axis=1) + steps[n][:, None]
        return np.concatenate([warm.astype(np.int64), value], axis=1)
    weights = np.array(coefficients, np.int64)[::-1, None]
    for t in range(order, size):
        out[t] = residual[:, t - order] + ((weights * out[t - order : t]).sum(axis=0) >> shift)
    return out.T


def _subframe(bits: _Bits, size: int, depth: int) -> np.ndarray:
    if bits.take(1):
        raise BadMedia("a subframe has reserved codes")
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.zeros() + 1
    depth -= wasted
    if kind == 0:
        out = np.full(size, bits.signed(depth), np.int64)
    elif kind == 1:
        out = np.array([bits.signed(depth) for _ in range(size)], np.int64)
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        if order > size:
            raise BadMedia("a predictor is longer than its block")
        warm = np.array([[bits.signed(depth) for _ in range(order)]], np.int64).reshape(1, order)
        coefficients, shift = _FIXED.get(order, ()), 0
        if kind >= 32:
            precision = bits.take(4) + 1
            shift = bits.signed(5)
            if precision == 16 or shift < 0:
                raise BadMedia("a predictor has reserved codes")
            coefficients = tuple(bits.signed(precision) for _ in range(order))
        out = predict(warm, _residual(bits, size, order)[None], coefficients, shift)[0]
    else:
        raise BadMedia("a subframe has reserved codes")
    return out << wasted


def decode_frame(data: bytes, at: int, depth: int) -> tuple[np.ndarray, int]:
    """Samples of the frame at ``at`` (a column per channel) and where it ends, with both checksums held."""
    head, size, layout, depth, _ = _header(data, at, depth)
    bits = _Bits(data, at + head)
    side = {8: 1, 9: 0, 10: 1}.get(layout)  # the channel that needs one bit more
    both = [_subframe(bits, size, depth + (c == side)) for c in range(2 if layout >= 8 else layout + 1)]
    if layout == 8:
        both[1] = both[0] - both[1]
    elif layout == 9:
        both[0] = both[0] + both[1]
    elif layout == 10:
        middle = both[0] << 1 | both[1] & 1
        both = [(middle + both[1]) >> 1, (middle - both[1]) >> 1]
    end = (bits.at + 7) // 8
    part = np.frombuffer(data, np.uint8)
    if len(data) < end + 2 or int(crc16s(part, np.array([at]), np.array([end]))[0]) != int.from_bytes(data[end : end + 2], "big"):
        raise BadMedia("a frame's checksum does not hold")
    return np.stack(both, axis=1), end + 2


def stream_info(data: bytes) -> tuple[int, int, int, int, int, bytes]:
    """Sample rate, channels, sample bits, samples, first frame's place, digest of the samples."""
    if data[:4] != b"fLaC" or len(data) < 42 or data[4] & 0x7F:
        raise BadMedia("no FLAC stream")
    packed, digest = int.from_bytes(data[18:26], "big"), bytes(data[26:42])
    at = 4
    while True:
        last, at = data[at] >> 7, at + 4 + int.from_bytes(data[at + 1 : at + 4], "big")
        if last:
            break
        if at + 4 > len(data):
            raise BadMedia("metadata ends early")
    return packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1), at, digest


def _frames(data: bytes, at: int, depth: int) -> list[tuple[int, int, int, int]] | None:
    """Place, header bytes, size and end of all frames, if they are mono, 8 bits and easy to tell apart."""
    raw = np.frombuffer(data, np.uint8)
    found = np.flatnonzero((raw[at:-1] == 0xFF) & (raw[at + 1 :] == 0xF8)) + at if len(raw) > at + 1 else []
    out: list[tuple[int, int, int, int]] = []
    for place in map(int, found):
        try:
            head, size, layout, bits, number = _header(data, place, depth)
        except BadMedia:
            continue  # a sync code inside a frame
        if layout or bits != 8 or number != len(out):
            return None
        out.append((place, head, size, 0))
    if not out or out[0][0] != at:
        return None
    ends = [f[0] for f in out[1:]] + [len(data)]
    return [(a, h, s, e) for (a, h, s, _), e in zip(out, ends)]


def _joint(data: np.ndarray, frames: list[tuple[int, int, int, int]]) -> list[np.ndarray] | None:
    """Samples of many frames at once: fixed predictors, one Rice partition; else nothing.

    All frames walk side by side: where a code starts, a table of the next 1 gives its end.
    """
    place, head, size, end = (np.array(c) for c in zip(*frames))
    if not (crc16s(data, place, end - 2) == (data[end - 2].astype(np.uint16) << 8 | data[end - 1])).all():
        raise BadMedia("a frame's checksum does not hold")
    sub = place + head
    kind = data[sub]
    order = (kind >> 1).astype(np.int64) - 8
    if ((kind & 0x81) != 0).any() or (order < 0).any() or (order > 4).any() or (size <= order).any():
        return None
    field = sub + 1 + order
    rice = ((data[field] & 3).astype(np.int64) << 2) | data[field + 1] >> 6
    if (data[field] >> 2).any() or (rice > MOST_RICE).any():
        return None
    bits = np.unpackbits(data)
    nothing = len(bits)
    one = np.flatnonzero(bits)
    ahead = np.full(nothing + MOST_RICE + 2, nothing, np.int32)  # where a code of a frame that is done would go on
    ahead[one] = one
    np.minimum.accumulate(ahead[::-1], out=ahead[::-1])
    del one
    by_size = np.argsort(-size, kind="stable")
    n = (size - order)[by_size]
    steps = int((size - order).max())
    begin, k = (8 * field + 10)[by_size].astype(np.int32), rice[by_size].astype(np.int32)
    ones = np.zeros((steps, len(frames)), np.int32)
    # frames of fewer codes stop early; sizes fall, so the ones that go on are in front
    active = np.searchsorted(-size[by_size], -np.arange(steps), "left")
    at, more = begin.copy(), k + 1
    for t, m in enumerate(active.tolist()):
        row = ones[t, :m]
        np.take(ahead, at[:m], out=row, mode="clip")
        np.add(row, more[:m], out=at[:m])
    quotients = ones.copy()
    quotients[0] -= begin
    quotients[1:] -= ones[:-1] + more
    quotients[np.arange(steps)[:, None] >= n] = 0
    low = np.zeros_like(quotients)
    padded = np.append(bits, np.zeros(MOST_RICE + 2, np.uint8))
    for b in range(int(k.max(initial=0))):
        has = k > b
        low[:, has] = low[:, has] << 1 | padded[np.minimum(ones[:, has], nothing) + 1 + b]
    u = (quotients << k) | low
    residual = (u >> 1 ^ -(u & 1)).T
    out: list[np.ndarray | None] = [None] * len(frames)
    signed = data.astype(np.int8)
    for o in np.unique(order):
        for column in np.flatnonzero(order[by_size] == o):
            f = by_size[column]
            warm = signed[sub[f] + 1 : sub[f] + 1 + o].astype(np.int64)[None]
            out[f] = predict(warm, residual[column : column + 1, : n[column]], _FIXED[int(o)], 0)[0]
    return out


def decode(streams: list[bytes]) -> list[tuple[int, int, int, list[tuple[int, np.ndarray]]] | None]:
    """Per stream: sample rate, channels, sample bits, and blocks of (first sample, samples); None if it is bad.

    Streams of mono frames of 8 bits are read together, all others frame by frame. Checksums of frames
    and of all samples must hold.
    """
    out: list = [None] * len(streams)
    joint: list[tuple[int, list]] = []
    for i, data in enumerate(streams):
        try:
            rate, channels, depth, samples, at, _ = stream_info(data)
            frames = _frames(data, at, depth) if channels == 1 and depth == 8 else None
            if frames is not None:
                joint.append((i, frames))
            else:
                out[i] = _single(data)
        except BadMedia:
            pass
    # as many streams at once as have CHUNK bytes
    group: list[tuple[int, list]] = []
    held = 0
    for item in [*joint, None]:
        if item is None or (group and held + len(streams[item[0]]) > CHUNK):
            _together(streams, group, out)
            group, held = [], 0
        if item is not None:
            group.append(item)
            held += len(streams[item[0]])
    return out


def _single(data: bytes):
    rate, channels, depth, samples, at, digest = stream_info(data)
    blocks, first = [], 0
    while at < len(data):
        block, at = decode_frame(data, at, depth)
        blocks.append((first, block))
        first += len(block)
    return _checked(rate, channels, depth, samples, digest, blocks)


def _checked(rate, channels, depth, samples, digest, blocks):
    md5 = hashlib.md5()
    width = (depth + 7) // 8
    n = 0
    for _, block in blocks:
        n += len(block)
        md5.update(np.ascontiguousarray(block.astype("<i8")).view(np.uint8).reshape(block.size, 8)[:, :width].tobytes() if width > 1 else block.astype(np.int8).tobytes())
    if (samples and n != samples) or (any(digest) and md5.digest() != digest):
        raise BadMedia("the samples' digest does not hold")
    return rate, channels, depth, blocks


def _together(streams: list[bytes], group: list[tuple[int, list]], out: list) -> None:
    if not group:
        return
    data = np.frombuffer(b"".join(streams[i] for i, _ in group), np.uint8)
    frames, offset = [], 0
    for i, own in group:
        frames += [(a + offset, h, s, e + offset) for a, h, s, e in own]
        offset += len(streams[i])
    try:
        found = _joint(data, frames)
    except BadMedia:
        found = None
    at = 0
    for i, own in group:
        try:
            if found is None:
                out[i] = _single(streams[i])
            else:
                rate, channels, depth, samples, _, digest = stream_info(streams[i])
                starts = np.concatenate([[0], np.cumsum([f[2] for f in own])])
                blocks = [(int(a), b[:, None]) for a, b in zip(starts, found[at : at + len(own)])]
                out[i] = _checked(rate, channels, depth, samples, digest, blocks)
        except BadMedia:
            out[i] = None
        at += len(own)


def _portions(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive values of about ``CHUNK`` bytes."""
    start = held = 0
    for i, size in enumerate(sizes):
        held += size
        if held >= CHUNK:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _with_made(rows: DataFrame, column: str, made: pa.Schema, make: Callable[[list], list[tuple]]) -> DataFrame:
    """``rows`` with the fields of ``made`` in place of ``column``; other columns pass through unchanged.

    A task makes values of about ``CHUNK`` bytes at a time and hands them on, however large its batches are.
    """
    own = [c for c in rows.columns if c != column and c not in made.names]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0)
            for a, b in _portions(pc.fill_null(pc.binary_length(values), 0).to_pylist()):
                part = batch.slice(a, b - a)
                cells = list(zip(*make(part.column(0).to_pylist())))
                arrays = [*part.columns[1:], *[pa.array(c, t) for c, t in zip(cells, made.types)]]
                yield pa.RecordBatch.from_arrays(arrays, [*own, *made.names])

    schema = StructType([rows.schema[c] for c in own] + from_arrow_schema(made).fields)
    return rows.select(column, *own).mapInArrow(work, schema)


def pcm(block: np.ndarray, depth: int) -> bytes:
    """Little-endian PCM; samples of up to 8 bits are unsigned, as in WAVE files."""
    if depth <= 8:
        return (block + (1 << (depth - 1))).astype(np.uint8).tobytes()
    width = (depth + 7) // 8
    return np.ascontiguousarray(block.astype("<i8")).view(np.uint8).reshape(block.size, 8)[:, :width].tobytes()


def store(texts: DataFrame) -> DataFrame:
    """``texts`` with ``n_bytes`` of the text as UTF-8 and ``media``, its bytes as a FLAC stream, for the text.

    Bytes 32 pad the text to a positive multiple of ``UNIT``. Null text is empty. Rows are coded where
    they are read, many at a time but never more than about ``CHUNK`` bytes at once besides a longer
    text. Rows may repeat; an empty table gives no rows; columns named like the new ones are replaced.
    """

    def coded(values: list[str | None]) -> list[tuple]:
        raw = [(v or "").encode("utf-8", "surrogatepass") for v in values]
        media = encode([r.ljust(max(1, -(-len(r) // UNIT)) * UNIT, b" ") for r in raw])
        return [(len(r), m) for r, m in zip(raw, media)]

    return _with_made(texts, "text", pa.schema([("n_bytes", pa.int64()), ("media", pa.binary())]), coded)


def read_blocks(media: DataFrame, column: str = "media") -> DataFrame:
    """The rows of ``media`` with ``sample_rate``, ``channels``, ``sample_bits`` and ``blocks`` of PCM for the stream.

    Blocks are those of the stream's frames in order; ``first_sample`` makes them seekable. Frames
    must pass their header's and their own checksum, and the samples the stream's digest if it has
    one. A null, a stream that is none, is cut or changed gives nulls in the new columns. Rows may
    repeat; an empty table gives no rows.
    """
    block = pa.struct([("first_sample", pa.int64()), ("n_samples", pa.int32()), ("pcm", pa.binary())])
    made = pa.schema([("sample_rate", pa.int64()), ("channels", pa.int32()), ("sample_bits", pa.int32()), ("blocks", pa.list_(block))])

    def read(streams: list[bytes | None]) -> list[tuple]:
        rows = []
        for found in decode([s or b"" for s in streams]):
            if found is None:
                rows.append((None,) * 4)
            else:
                *head, own = found
                rows.append((*head, [{"first_sample": at, "n_samples": len(x), "pcm": pcm(x, head[2])} for at, x in own]))
        return rows

    return _with_made(media, column, made, read)


def features(media: DataFrame, column: str = "media") -> DataFrame:
    """The rows of ``media`` with size, digest, end checksum and features of the PCM read back, for the stream.

    ``feature`` states mean square, sign changes and largest step of the samples and the number of
    blocks, as whole numbers; it is meant for one channel of 8 bits. A stream that ``read_blocks`` gives
    nulls for has nulls here.
    """
    made = pa.schema([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("feature", pa.string())])

    def figures(streams: list[bytes | None]) -> list[tuple]:
        rows = []
        for found in decode([s or b"" for s in streams]):
            if found is None:
                rows.append((None,) * 4)
                continue
            whole = b"".join(pcm(x, found[2]) for _, x in found[3])
            x = np.frombuffer(whole, np.uint8).astype(np.int32) - 128
            power = int((x * x).sum(dtype=np.int64)) // max(1, len(x))
            turns = int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())
            step = int(np.abs(np.diff(x)).max(initial=0))
            feature = f"power={power};turns={turns};step={step};blocks={len(found[3])}"
            rows.append((len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-16:]), feature))
        return rows

    return _with_made(media, column, made, figures)


def query(documents: DataFrame) -> DataFrame:
    held = store(documents.select("doc_id", "text")).withColumns({"media_bytes": F.length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    return features(held)
