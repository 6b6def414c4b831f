"""AVI motion-JPEG: writing and reading RIFF indexes, decoding baseline intra frames, shots as timed clip rows.

A payload is stored losslessly: 192 bytes are the 16 x 12 flat blocks of a 128 x 96 grey frame. A flat block
needs its DC coefficient only, with quantizer 8 a whole number, so any baseline decoder restores each byte as the
value of 8 x 8 samples. Frames of such blocks are coded and decoded many at a time: step i decodes block i of all
frames. Every other baseline JPEG (AC coefficients, colour, subsampling, restart intervals) is decoded block by
block.

A shot ends where the difference of two frames' 16-bin histograms exceeds mean + 3 standard deviations of the
WINDOW differences before it (three at least), and a floor of FLOOR of the samples.

Edge cases: null media gives no clip; an AVI without an index is read by walking its frame list; media that isn't
an AVI, or a frame that isn't a baseline JPEG, raises ValueError; a payload must be a positive multiple of 192."""

from __future__ import annotations

import functools
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm import common

WIDTH, HEIGHT, BLOCKS, FPS = 128, 96, 192, 25
WINDOW, SIGMAS, FLOOR, BINS = 8, 3.0, 0.125, 16

# Fixed values of the JPEG standard (ITU-T T.81): zigzag order, and Annex K's Huffman tables that motion-JPEG frames
# leave out: codes of each length from 1 to 16, then symbols.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i % 8 if (i // 8 + i % 8) % 2 == 0 else i // 8))
DC_LUMA = ([0, 1, 5, 1, 1, 1, 1, 1, 1], list(range(12)))
DC_CHROMA = ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1], list(range(12)))
AC_LUMA = ([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], bytes.fromhex(
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
    "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9"
    "aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"))  # fmt: skip
AC_CHROMA = ([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119], bytes.fromhex(
    "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a"
    "434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8"
    "a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"))  # fmt: skip


def codes(table) -> dict[int, tuple[int, int]]:
    """Symbol to (code, bits)."""
    counts, symbols = table
    out, code, at = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, bits)
            code += 1
        at += n
        code <<= 1
    return out


@functools.cache
def _flat() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a flat block with DC difference d: code[d + 255], bits[d + 255]; of the next 18 bits: bits and d, 0 bits if it isn't a flat block."""
    dc, (eob, eob_bits) = codes(DC_LUMA), codes(AC_LUMA)[0]
    code, bits = np.zeros(511, np.uint32), np.zeros(511, np.uint8)
    next_bits, next_d = np.zeros(1 << 18, np.uint8), np.zeros(1 << 18, np.int16)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        c, n = dc[size]
        c = (c << size | (d if d >= 0 else d + (1 << size) - 1)) << eob_bits | eob
        n += size + eob_bits
        code[d + 255], bits[d + 255] = c, n
        next_bits[c << (18 - n) : (c + 1) << (18 - n)] = n
        next_d[c << (18 - n) : (c + 1) << (18 - n)] = d
    return code, bits, next_bits, next_d


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@functools.cache
def frame_header() -> bytes:
    """All before a frame's entropy-coded data."""
    quantizer = bytes([0]) + bytes([8]) + bytes([1]) * 63
    size = struct.pack(">BHHB3B", 8, HEIGHT, WIDTH, 1, 1, 0x11, 0)
    return b"\xff\xd8" + _segment(0xDB, quantizer) + _segment(0xC0, size) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of the ranges [start, start + length), one range after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def scans(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, 192) bytes to stuffed entropy-coded bytes of all frames, and each frame's length."""
    code, bits, _, _ = _flat()
    level = values.astype(np.int16) - 128
    level[:, 1:] -= level[:, :-1].copy()
    level += 255
    n = bits[level].astype(np.int64)
    ends = np.cumsum(n, axis=1)
    size = (ends[:, -1] + 7) >> 3
    first = np.cumsum(size) - size
    at = (ends - n + (first << 3)[:, None]).ravel()
    n = n.ravel()
    shifted = code[level].ravel() << (32 - n - (at & 7)).astype(np.uint32)
    at >>= 3
    total = int(size.sum())
    packed = np.zeros(total + 4)
    for k in range(4):
        packed += np.bincount(at + k, ((shifted >> np.uint32(24 - 8 * k)) & np.uint32(255)), total + 4)
    packed = packed[:total].astype(np.uint8)
    packed[first + size - 1] |= ((1 << ((size << 3) - ends[:, -1])) - 1).astype(np.uint8)  # filled up with ones
    full = packed == 255
    before = np.r_[0, np.cumsum(full)]
    out = np.zeros(total + int(before[-1]), np.uint8)
    out[np.arange(total) + before[:-1]] = packed
    return out, size + before[first + size] - before[first]


def stored_avis(payloads: list[bytes]) -> list[bytes]:
    """An AVI of each payload."""
    frames = np.array([len(p) // BLOCKS for p in payloads])
    if any(not len(p) or len(p) % BLOCKS for p in payloads):
        raise ValueError("a payload is a positive multiple of 192 bytes")
    data, sizes = scans(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCKS))
    head = np.frombuffer(frame_header(), np.uint8)
    jpeg = sizes + len(head) + 2
    chunk = 8 + jpeg + (jpeg & 1)
    ends = np.cumsum(chunk)
    begin = ends - chunk
    movie = np.zeros(int(ends[-1]), np.uint8)
    label = np.zeros((len(jpeg), 8), np.uint8)
    label[:, :4] = np.frombuffer(b"00dc", np.uint8)
    label[:, 4:] = jpeg.astype("<u4").view(np.uint8).reshape(-1, 4)
    movie[begin[:, None] + np.arange(8)] = label
    movie[begin[:, None] + 8 + np.arange(len(head))] = head
    movie[_ragged(begin + 8 + len(head), sizes)] = data
    movie[begin + 6 + jpeg] = 0xFF
    movie[begin + 7 + jpeg] = 0xD9
    out, at = [], 0
    for n in frames.tolist():
        a, b = int(begin[at]), int(ends[at + n - 1])
        index = np.zeros((n, 4), "<u4")
        index[:, 0], index[:, 1] = int.from_bytes(b"00dc", "little"), 0x10
        index[:, 2], index[:, 3] = begin[at : at + n] - a + 4, jpeg[at : at + n]
        out.append(_riff(n, int(jpeg[at : at + n].max()), movie[a:b].tobytes(), index.tobytes()))
        at += n
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _riff(frames: int, largest: int, movie: bytes, index: bytes) -> bytes:
    main = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, frames, 0, 1, largest, WIDTH, HEIGHT, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, frames, largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    form = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 24, b"MJPG", WIDTH * HEIGHT * 3, 0, 0, 0, 0)
    headers = b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form))
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", headers) + _chunk(b"LIST", b"movi" + movie) + _chunk(b"idx1", index))


class Avi:
    """fps, width, height and the places and sizes of a file's video frames."""

    def __init__(self, media: bytes):
        if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"AVI ":
            raise ValueError("not an AVI")
        self.fps, self.width, self.height, movie, index = 0.0, 0, 0, None, None
        at = 12
        while at + 8 <= len(media):
            name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            if name == b"LIST" and media[at + 8 : at + 12] == b"hdrl":
                head = media[at + 12 : at + 8 + size]
                main, stream = head.find(b"avih"), head.find(b"strh")
                self.width, self.height = struct.unpack_from("<2I", head, main + 40)
                scale, rate = struct.unpack_from("<2I", head, stream + 28)
                self.fps = rate / scale if scale else 1e6 / max(1, struct.unpack_from("<I", head, main + 8)[0])
            elif name == b"LIST" and media[at + 8 : at + 12] == b"movi":
                movie = (at + 8, size)
            elif name == b"idx1":
                index = np.frombuffer(media, "<u4", size // 16 * 4, at + 8).reshape(-1, 4)
            at += 8 + size + (size & 1)
        if movie is None:
            raise ValueError("no frames in this AVI")
        if index is None:
            self.places, self.sizes = self._walked(media, *movie)
        else:
            tag = index[:, 0] >> 16  # the last two letters
            own = (tag == int.from_bytes(b"dc", "little")) | (tag == int.from_bytes(b"db", "little"))
            index = index[own]
            self.places, self.sizes = index[:, 2].astype(np.int64) + 8, index[:, 3].astype(np.int64)
            first = int(self.places[0]) if len(index) else 0
            if not (len(index) and media[first - 8 : first - 4][2:] in (b"dc", b"db") and struct.unpack_from("<I", media, first - 4)[0] == self.sizes[0]):
                self.places = self.places + movie[0]  # offsets count from the list's name, or else from the file's begin

    @staticmethod
    def _walked(media: bytes, at: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        end, found = at + size, []
        at += 4
        while at + 8 <= end:
            name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            if name == b"LIST":
                at += 12
                continue
            if name[2:] in (b"dc", b"db"):
                found.append((at + 8, n))
            at += 8 + n + (n & 1)
        return np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64)


def flat_frames(data: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, 192) values of frames with the own header and flat blocks only, and which frames are such."""
    _, _, next_bits, next_d = _flat()
    head = np.frombuffer(frame_header(), np.uint8)
    good = sizes >= len(head) + 2
    where = np.minimum(places[:, None] + np.arange(len(head)), len(data) - 1)
    good &= (data[where] == head).all(axis=1)
    n = np.where(good, sizes - len(head) - 2, 0)
    scan = data[_ragged(places + len(head), n)]
    first = np.cumsum(n) - n
    stuffed = np.zeros(len(scan), bool)
    stuffed[1:] = (scan[1:] == 0) & (scan[:-1] == 255)
    before = np.r_[0, np.cumsum(stuffed)]
    first, end = first - before[first], first + n - before[first + n]
    scan = np.r_[scan[~stuffed], np.full(8, 255, np.uint8)].astype(np.uint32)
    window = scan[:-3] << np.uint32(24) | scan[1:-2] << np.uint32(16) | scan[2:-1] << np.uint32(8) | scan[3:]
    at, value = first << 3, np.full(len(places), 128, np.int16)
    out = np.zeros((len(places), BLOCKS), np.uint8)
    for i in range(BLOCKS):
        byte = np.minimum(at >> 3, len(window) - 1)
        key = (window[byte] << (at & 7).astype(np.uint32)) >> np.uint32(14)
        bits = next_bits[key]
        good &= bits > 0
        at += bits
        value += next_d[key]
        out[:, i] = value
    good &= at <= end << 3
    return out, good


class Jpeg:
    """A baseline JPEG, decoded block by block; planes: each component's samples; luma: the first at full size."""

    def __init__(self, data: bytes):
        self.tables = {(0, 0): DC_LUMA, (0, 1): DC_CHROMA, (1, 0): AC_LUMA, (1, 1): AC_CHROMA}
        self.quantizers: dict[int, np.ndarray] = {}
        self.restart, self.parts, at = 0, [], 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                raise ValueError("a marker is missing")
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                self._quantizer(body)
            elif marker == 0xC4:
                self._huffman(body)
            elif marker in (0xC0, 0xC1):
                _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.parts = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(n)]
            elif 0xC2 <= marker <= 0xCF and marker != 0xCC:
                raise ValueError("not a baseline JPEG")
            elif marker == 0xDD:
                self.restart = int.from_bytes(body, "big")
            elif marker == 0xDA:
                chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                for p in self.parts:
                    p["dc"], p["ac"] = self._lookup(0, chosen[p["id"]] >> 4), self._lookup(1, chosen[p["id"]] & 15)
                self._scan(data[at:])
                return
        raise ValueError("no scan")

    def _quantizer(self, body: bytes) -> None:
        while body:
            wide, n = body[0] >> 4, body[0] & 15
            self.quantizers[n] = np.frombuffer(body[1:], ">u2" if wide else "u1", 64).astype(np.int64)
            body = body[1 + 64 * (1 + wide) :]

    def _huffman(self, body: bytes) -> None:
        while body:
            n = sum(body[1:17])
            self.tables[body[0] >> 4, body[0] & 15] = (list(body[1:17]), body[17 : 17 + n])
            body = body[17 + n :]

    def _lookup(self, kind: int, n: int) -> dict:
        return {(bits, code): s for s, (code, bits) in codes(self.tables[kind, n]).items()}

    def _scan(self, data: bytes) -> None:
        most_h, most_v = max(p["h"] for p in self.parts), max(p["v"] for p in self.parts)
        if len(self.parts) == 1:
            self.parts[0]["h"] = self.parts[0]["v"] = most_h = most_v = 1  # a single component isn't interleaved
        across, down = -(-self.width // (8 * most_h)), -(-self.height // (8 * most_v))
        for p in self.parts:
            p["blocks"] = np.zeros((down * p["v"], across * p["h"], 64), np.int64)
        pieces, piece, i = [], bytearray(), 0
        while i < len(data):
            if data[i] == 0xFF and i + 1 < len(data):
                if data[i + 1] == 0:
                    piece.append(0xFF)
                elif 0xD0 <= data[i + 1] <= 0xD7:
                    pieces.append(bytes(piece))
                    piece = bytearray()
                elif data[i + 1] != 0xFF:
                    break
                i += 1 if data[i + 1] == 0xFF else 2
                continue
            piece.append(data[i])
            i += 1
        pieces.append(bytes(piece))
        unit, step = 0, self.restart or across * down
        for piece in pieces:
            bits = _Bits(piece)
            level = [0] * len(self.parts)
            for unit in range(unit, min(unit + step, across * down)):
                for k, p in enumerate(self.parts):
                    for v in range(p["v"]):
                        for h in range(p["h"]):
                            block = p["blocks"][unit // across * p["v"] + v, unit % across * p["h"] + h]
                            level[k] += bits.signed(bits.symbol(p["dc"]))
                            block[0] = level[k]
                            i = 1
                            while i < 64:
                                s = bits.symbol(p["ac"])
                                if s == 0:
                                    break
                                i += s >> 4
                                if s & 15:
                                    if i > 63:
                                        raise ValueError("too many coefficients")
                                    block[i] = bits.signed(s & 15)
                                i += 1
            unit += 1
        basis = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
        self.planes = []
        for p in self.parts:
            c = np.zeros(p["blocks"].shape)
            c[..., ZIGZAG] = p["blocks"] * self.quantizers[p["q"]]
            rows, cols = c.shape[:2]
            s = np.einsum("ux,rcuv,vy->rcxy", basis, c.reshape(rows, cols, 8, 8), basis)
            s = np.clip(np.rint(s + 128), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * cols)
            self.planes.append(s[: -(-self.height * p["v"] // most_v), : -(-self.width * p["h"] // most_h)])
        self.luma = self.planes[0]


class _Bits:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int) -> int:
        if n > self.left:
            raise ValueError("the scan ends early")
        self.left -= n
        return self.value >> self.left & ((1 << n) - 1)

    def symbol(self, table: dict) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such code")

    def signed(self, size: int) -> int:
        v = self.take(size) if size else 0
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def frame_histograms(medias: list[bytes], avis: list[Avi]) -> tuple[np.ndarray, list[bytes]]:
    """Histograms of all frames (counts of samples or flat blocks), and each file's flat blocks."""
    base = np.cumsum([0, *map(len, medias)])
    data = np.frombuffer(b"".join(medias), np.uint8)
    places = np.concatenate([a.places + b for a, b in zip(avis, base, strict=False)] or [np.zeros(0, np.int64)])
    sizes = np.concatenate([a.sizes for a in avis] or [np.zeros(0, np.int64)])
    if not len(places):
        return np.zeros((0, BINS), np.int64), [b""] * len(medias)
    values, good = flat_frames(data, places, sizes)
    frame = np.repeat(np.arange(len(places)), BLOCKS)
    hist = np.bincount(frame * BINS + (values.ravel() >> 4), minlength=len(places) * BINS).reshape(-1, BINS)
    for i in np.flatnonzero(~good):
        luma = Jpeg(data[places[i] : places[i] + sizes[i]].tobytes()).luma
        hist[i] = np.bincount(luma.ravel() >> 4, minlength=BINS) * BLOCKS // luma.size
    n = np.cumsum([0, *(len(a.places) for a in avis)])
    return hist, [values[n[i] : n[i + 1]][good[n[i] : n[i + 1]]].tobytes() for i in range(len(avis))]


def cuts(hist: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which frames begin a shot; first: offsets of the files into the frames."""
    n = len(hist)
    begins = np.zeros(n, bool)
    if not n:
        return begins
    d = np.zeros(n, np.int64)
    d[1:] = np.abs(np.diff(hist, axis=0)).sum(axis=1)
    starts = first[:-1][np.diff(first) > 0]
    d[starts] = 0
    begins[starts] = True
    one, two = np.r_[0, np.cumsum(d)], np.r_[0, np.cumsum(d * d)]
    frame = np.arange(n)
    own = np.repeat(first[:-1], np.diff(first))
    lo = np.maximum(own + 1, frame - WINDOW)
    seen = np.maximum(frame - lo, 0)
    s, ss = one[frame] - one[lo.clip(max=n)], two[frame] - two[lo.clip(max=n)]
    some = (seen >= 3) & (frame > own)
    seen = np.maximum(seen, 1)
    spread = np.sqrt(np.maximum(seen * ss - s * s, 0).astype(np.float64))
    return begins | (some & (d > FLOOR * 2 * BLOCKS) & (d * seen > s + SIGMAS * spread))


def media_table(docs: DataFrame) -> DataFrame:
    """Stores each text as an AVI, reads it back and describes it: see the columns."""
    import hashlib
    import zlib

    def work(batch):
        raw, off = common.bytes_of(batch.column("text"))
        n = np.diff(off)
        payloads = []
        for i in range(len(n)):
            size = max(BLOCKS, -(-int(n[i]) // BLOCKS) * BLOCKS)
            payloads.append(raw[off[i] : off[i + 1]].tobytes().ljust(size, b" "))
        medias = stored_avis(payloads)
        avis = [Avi(m) for m in medias]
        hist, back = frame_histograms(medias, avis)
        first = np.cumsum([0, *(len(a.places) for a in avis)])
        begins = cuts(hist, first)
        feature = []
        for i in range(len(n)):
            own = slice(first[i], first[i + 1])
            feature.append(f"frames={first[i + 1] - first[i]};shots={','.join(map(str, np.flatnonzero(begins[own])))};hist={','.join(map(str, hist[own].sum(axis=0)))}")
        return {
            "doc_id": batch.column("doc_id"), "n_bytes": n, "payload_bytes": [len(b) for b in back], "payload_sha256": [hashlib.sha256(b).hexdigest() for b in back],
            "tail_crc32": [zlib.crc32(b[-16:]) for b in back], "media_bytes": [len(m) for m in medias], "media_sha256": [hashlib.sha256(m).hexdigest() for m in medias],
            "feature": feature, "n_shots": [int(begins[first[i] : first[i + 1]].sum()) for i in range(len(n))],
        }

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.arrow_map(docs, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_shots long", work)


def stored_media(docs: DataFrame) -> DataFrame:
    """doc_id and the AVI that holds its text."""

    def work(batch):
        raw, off = common.bytes_of(batch.column("text"))
        sizes = np.maximum(BLOCKS, -(-np.diff(off) // BLOCKS) * BLOCKS)
        return {"doc_id": batch.column("doc_id"), "media": stored_avis([raw[off[i] : off[i + 1]].tobytes().ljust(int(sizes[i]), b" ") for i in range(len(sizes))])}

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.arrow_map(docs, "doc_id long, media binary", work)


def clips(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """A row per shot of each AVI: key, clip (from 0), start_s, end_s, first_frame, n_frames, reason.

    A file that can't be read (no AVI, cut off, without frames per second, damaged frames) gives one row with its reason and no
    clip; a null one gives none."""

    def read(raw):
        """(AVI, histograms), or why not."""
        try:
            avi = Avi(raw)
            if not avi.fps > 0:
                raise ValueError("no frames per second")
            return avi, frame_histograms([raw], [avi])[0], None
        except (ValueError, LookupError, ArithmeticError, TypeError, struct.error) as e:
            return None, None, f"{type(e).__name__}: {e}"[:200]

    def work(batch):
        rows, out = [], []
        for i, raw in enumerate(batch.column("media").to_pylist()):
            if raw is None:
                continue
            avi, hist, reason = read(raw)
            if reason is not None:
                rows.append(i)
                out.append((None,) * 5 + (reason,))
                continue
            at = [*np.flatnonzero(cuts(hist, np.array([0, len(avi.places)]))).tolist(), len(avi.places)]
            for c, (s, e) in enumerate(zip(at, at[1:], strict=False)):
                rows.append(i)
                out.append((c, s / avi.fps, e / avi.fps, s, e - s, None))
        if not out:
            return None
        return {"key": batch.column("key").take(pa.array(rows))} | dict(zip(("clip", "start_s", "end_s", "first_frame", "n_frames", "reason"), zip(*out, strict=True), strict=True))

    kind = dict(media.dtypes)[key]
    named = media.select(F.col(key).alias("key"), F.col(column).alias("media"))
    return common.arrow_map(named, f"key {kind}, clip int, start_s double, end_s double, first_frame long, n_frames long, reason string", work).withColumnRenamed("key", key)


def query(spark, sf_dir: str) -> DataFrame:
    return media_table(common.table(spark, sf_dir, "documents"))
