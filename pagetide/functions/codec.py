"""The binary log format: headers, page frames, page index, checksums, and the write-ahead log."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

FLAG = 1 << 63
M64, M32 = (1 << 64) - 1, (1 << 32) - 1
_HEADER = struct.Struct(">4sIIIQQqQqqIIQ")
_FIELDS = ["magic", "flags", "page_size", "commit", "min_txid", "max_txid", "ts_ms", "pre_apply", "wal_offset", "wal_size", "wal_salt1", "wal_salt2", "node_id"]
#: The magics, the polynomial, the flag for files without checksums.
MAGIC, WAL_VERSION, NO_CHECKSUM = b"LTX1", 3007000, 1 << 1
WAL_MAGIC_LE, WAL_MAGIC_BE = 0x377F0682, 0x377F0683
DB_MAGIC = b"SQLite format 3\x00"
POLY = 0xD800000000000000
#: LZ4 frame magic, version and flags (independent blocks, content checksum), blocks of 64 KB.
_LZ4_HEAD = bytes([0x04, 0x22, 0x4D, 0x18, 0x64, 0x40])
_LZ4_HEAD += bytes([xxhash.xxh32_intdigest(_LZ4_HEAD[4:]) >> 8 & 255])
_LZ4 = pa.Codec("lz4_raw")


class FormatError(ValueError):
    pass


class EmptyLog(FormatError):
    """A write-ahead log whose header is not whole: there is no log yet, which is no fault."""


def _crc_tables() -> np.ndarray:
    """Eight tables: what each byte of eight adds to the register, the last byte first."""
    first = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        first = first >> np.uint64(1) ^ np.where(first & np.uint64(1), np.uint64(POLY), np.uint64(0))
    out = [first]
    for _ in range(7):
        out.append(out[-1] >> np.uint64(8) ^ first[out[-1] & np.uint64(255)])
    return np.stack(out)


_CRC = _crc_tables()


def _eight(x: np.ndarray) -> np.ndarray:
    """The registers after eight more bytes, which were added to x."""
    out = _CRC[0][x >> np.uint64(56)]
    for i in range(1, 8):
        out ^= _CRC[i][x >> np.uint64(56 - 8 * i) & np.uint64(255)]
    return out


def crc64_rows(rows: np.ndarray, start: np.ndarray | int = 0) -> np.ndarray:
    """The CRC-64 of each row of a byte matrix, side by side; start: the CRC of what came before."""
    n, size = rows.shape
    crc = np.zeros(n, np.uint64) + np.asarray(start, np.uint64) ^ np.uint64(M64)
    whole = size - size % 8
    if whole:
        for word in np.ascontiguousarray(rows[:, :whole]).view("<u8").T:
            crc = _eight(crc ^ word)
    for byte in rows[:, whole:].T:
        crc = _CRC[0][(crc ^ byte) & np.uint64(255)] ^ crc >> np.uint64(8)
    return crc ^ np.uint64(M64)


def _applied(columns: list[int], x: int) -> int:
    out = 0
    for c in columns:
        if x & 1:
            out ^= c
        x >>= 1
    return out


@lru_cache(maxsize=256)
def _zeros(power: int) -> list[int]:
    """What 2^power zero bytes make of each bit of a register."""
    if power == 0:
        return [int(_CRC[0][1 << i & 255]) ^ (1 << i) >> 8 for i in range(64)]
    half = _zeros(power - 1)
    return [_applied(half, c) for c in half]


def crc64_joined(left: int, right: int, size: int) -> int:
    """The CRC of two texts one after the other; size: of the second."""
    power = 0
    while size:
        if size & 1:
            left = _applied(_zeros(power), left)
        size >>= 1
        power += 1
    return left ^ right


def crc64(data: bytes, crc: int = 0) -> int:
    """Long data are cut into pieces whose CRCs are found side by side and joined."""
    b = np.frombuffer(data, np.uint8)
    if len(b) >= 1 << 14:
        size = 8 * max(64, int((len(b) / 8) ** 0.5))
        n = len(b) // size
        for c in crc64_rows(b[: n * size].reshape(n, size)).tolist():
            crc = crc64_joined(crc, c, size)
        b = b[n * size :]
    return int(crc64_rows(b[None], crc)[0]) if len(b) else crc


def page_checksum(pgno: int, data: bytes) -> int:
    return FLAG | crc64(data, crc64(struct.pack(">I", pgno)))


def put_uvarint(x: int) -> bytes:
    out = bytearray()
    while x >= 0x80:
        out.append(x & 0x7F | 0x80)
        x >>= 7
    return bytes([*out, x])


def get_uvarint(b: bytes, at: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        if at >= len(b) or shift > 63:
            raise FormatError("bad uvarint")
        c = b[at]
        at += 1
        x |= (c & 0x7F) << shift
        if c < 0x80:
            if x > M64:
                raise FormatError("uvarint overflows")
            return x, at
        shift += 7


def encode_header(h: dict) -> bytes:
    return _HEADER.pack(MAGIC, *(h.get(k, 0) for k in _FIELDS[1:])).ljust(100, b"\0")


def decode_header(b: bytes) -> dict:
    if len(b) < 100 or b[:4] != MAGIC:
        raise FormatError("not a log file")
    h = dict(zip(_FIELDS, _HEADER.unpack(b[: _HEADER.size]), strict=True))
    validate_header(h)
    return h


def validate_header(h: dict) -> None:
    ps, low, high = h["page_size"], h["min_txid"], h["max_txid"]
    problems = {
        "flags": h["flags"] & ~NO_CHECKSUM,
        "page size": not 512 <= ps <= 65536 or ps & ps - 1,
        "txid": not 0 < low <= high < FLAG,
        "snapshot checksum": low == 1 and h["pre_apply"] and not h["flags"] & NO_CHECKSUM,
        "wal range": h["wal_offset"] < 0 or h["wal_size"] < 0,
    }
    for what, bad in problems.items():
        if bad:
            raise FormatError(f"bad {what}")


def compress_page(data: bytes) -> bytes:
    """One LZ4 frame with blocks of 64 KB, each on its own, and a checksum of the content."""
    out = [_LZ4_HEAD]
    for lo in range(0, len(data), 1 << 16):
        block = data[lo : lo + (1 << 16)]
        small = _LZ4.compress(block, asbytes=True)
        out.append(struct.pack("<I", len(small)) + small if len(small) < len(block) else struct.pack("<I", len(block) | 1 << 31) + block)
    return b"".join([*out, struct.pack("<II", 0, xxhash.xxh32_intdigest(data))])


def decompress_page(b: bytes, size: int) -> bytes:
    """The content of exactly one LZ4 frame, which is all of b."""
    if len(b) < 7 or b[:4] != _LZ4_HEAD[:4] or b[4] >> 6 != 1:
        raise FormatError("no LZ4 frame")
    flags, at = b[4], 6 + 8 * bool(b[4] & 8) + 4 * (b[4] & 1)
    if at >= len(b) or b[at] != xxhash.xxh32_intdigest(b[4:at]) >> 8 & 255:
        raise FormatError("LZ4 descriptor checksum mismatch")
    at, out, most = at + 1, [], 1 << (2 * (b[5] >> 4 & 7) + 8)
    while True:
        if at + 4 > len(b):
            raise FormatError("short LZ4 frame")
        (n,) = struct.unpack_from("<I", b, at)
        at += 4
        if not n:
            break
        block = b[at : at + (n & 0x7FFFFFFF)]
        at += len(block) + 4 * bool(flags & 16)
        if flags & 16 and struct.unpack_from("<I", b, at - 4)[0] != xxhash.xxh32_intdigest(block):
            raise FormatError("LZ4 block checksum mismatch")
        try:
            out.append(block if n >> 31 else _LZ4.decompress(block, min(size - sum(map(len, out)), most), asbytes=True))
        except OSError as e:
            raise FormatError(f"bad LZ4 block: {e}") from e
    data = b"".join(out)
    if flags & 4:
        if b[at : at + 4] != struct.pack("<I", xxhash.xxh32_intdigest(data)):
            raise FormatError("LZ4 content checksum mismatch")
        at += 4
    if at != len(b) or len(data) != size:
        raise FormatError("LZ4 frame of another size")
    return data


class FileWriter:
    """Writes a log file page by page to a stream; only the index is held. Pages ascend and leave the lock page out."""

    def __init__(self, out, h: dict):
        h = dict.fromkeys(_FIELDS[1:], 0) | h
        validate_header(h)
        self.out, self.h, self.last, self.index = out, h, 0, []
        self.lock = (1 << 30) // h["page_size"] + 1
        self.crc, self.at, self.state = 0, 0, FLAG
        self._put(encode_header(h))

    def _put(self, b: bytes) -> None:
        self.out.write(b)
        self.crc, self.at = crc64(b, self.crc), self.at + len(b)

    def page(self, pgno: int, frame: bytes, crc: int, size: int) -> None:
        """frame: the compressed page; crc and size: of the page itself."""
        if pgno <= self.last or pgno == self.lock or pgno > self.h["commit"] or size != self.h["page_size"]:
            raise FormatError(f"bad page {pgno}")
        self._in_order(pgno)
        at = self.at
        self._put(struct.pack(">IH", pgno, 0))
        self.out.write(frame)
        self.crc, self.at, self.last = crc64_joined(self.crc, crc, size), self.at + len(frame), pgno
        self.index.append((pgno, at, 6 + len(frame)))
        if self.h["min_txid"] == 1 and not self.h["flags"] & NO_CHECKSUM:
            self.state ^= crc64_joined(crc64(struct.pack(">I", pgno)), crc, size) | FLAG
            self.state |= FLAG

    def _in_order(self, pgno: int) -> None:
        if self.h["min_txid"] == 1 and pgno != self.last + 1 + (self.last + 1 == self.lock):
            raise FormatError(f"snapshot lacks page {self.last + 1}")

    def finish(self, post_apply: int | None = None) -> int:
        """Marker, index and trailer; gives the file's size. post_apply: by default a snapshot's checksum, or none where none is kept."""
        if self.h["min_txid"] == 1 and self.h["commit"]:
            self._in_order(self.h["commit"] + 1 + (self.h["commit"] + 1 == self.lock))
        if post_apply is None:
            post_apply = 0 if self.h["flags"] & NO_CHECKSUM or self.h["min_txid"] != 1 else self.state
        index = b"".join(b"".join(map(put_uvarint, entry)) for entry in self.index) + b"\0"
        self._put(bytes(6) + index + struct.pack(">Q", len(index)) + struct.pack(">Q", post_apply))
        self.out.write(struct.pack(">Q", FLAG | self.crc))
        return self.at + 8


def encode_file(h: dict, pages: list[tuple[int, bytes]], post_apply: int | None = None) -> bytes:
    out = io.BytesIO()
    w = FileWriter(out, h)
    for pgno, data in pages:
        w.page(pgno, compress_page(data), crc64(data), len(data))
    w.finish(post_apply)
    return out.getvalue()


def decode_index(b: bytes) -> dict[int, tuple[int, int]]:
    """pgno to (offset, size) of a whole file, from its end."""
    (size,) = struct.unpack(">Q", b[-24:-16])
    at, out = len(b) - 24 - size, {}
    while True:
        pgno, at = get_uvarint(b, at)
        if not pgno:
            return out
        offset, at = get_uvarint(b, at)
        n, at = get_uvarint(b, at)
        out[pgno] = (offset, n)


def decode_page(frame: bytes, page_size: int) -> tuple[int, bytes]:
    """One page from its frame alone."""
    return struct.unpack(">I", frame[:4])[0], decompress_page(bytes(frame[6:]), page_size)


def decode_file(b: bytes) -> tuple[dict, list[tuple[int, bytes, int, int]], int]:
    """Header, (pgno, data, offset, size) of each page, and post-apply checksum; all checksums are verified. FormatError if the file is broken anywhere."""
    try:
        return _decode_file(b)
    except (struct.error, IndexError) as e:
        raise FormatError(f"short file: {e}") from e


def _decode_file(b: bytes) -> tuple[dict, list[tuple[int, bytes, int, int]], int]:
    h = decode_header(b)
    if len(b) < 100 + 6 + 9 + 16:
        raise FormatError("short file")
    pages, end = [], 100
    for pgno, (offset, size) in sorted(decode_index(b).items()):
        if offset != end:
            raise FormatError("frames are not in page order")
        got, data = decode_page(b[offset : offset + size], h["page_size"])
        if got != pgno:
            raise FormatError("index and frame differ")
        pages.append((pgno, data, offset, size))
        end = offset + size
    if b[end : end + 6] != bytes(6):
        raise FormatError("no end of pages")
    crcs = crc64_rows(np.frombuffer(b"".join(p[1] for p in pages), np.uint8).reshape(len(pages), -1)).tolist() if pages else []
    crc, state = crc64(b[:100]), FLAG
    lock = (1 << 30) // h["page_size"] + 1
    for (pgno, _, offset, _), c in zip(pages, crcs, strict=True):
        crc = crc64_joined(crc64(b[offset : offset + 6], crc), c, h["page_size"])
        if pgno != lock:
            state = (state ^ crc64_joined(crc64(struct.pack(">I", pgno)), c, h["page_size"])) | FLAG
    if struct.unpack(">Q", b[-8:])[0] != FLAG | crc64(b[end:-8], crc):
        raise FormatError("file checksum mismatch")
    post = struct.unpack(">Q", b[-16:-8])[0]
    if h["min_txid"] == 1 and not h["flags"] & NO_CHECKSUM and post != state:
        raise FormatError("post-apply checksum mismatch")
    return h, pages, post


@lru_cache(maxsize=32)
def _wal_powers(n: int) -> np.ndarray:
    """How each of n pairs of words enters both sums, and how the sums before do: the rule is linear, so these are powers of one matrix."""
    out, m = np.empty((n + 1, 2, 2), np.uint32), [[1, 0], [0, 1]]
    for i in range(n + 1):
        out[n - i] = m
        (a, b), (c, d) = m
        m = [[a + b & M32, a + 2 * b & M32], [c + d & M32, c + 2 * d & M32]]
    return out


def wal_checksum(big: bool, s0: int, s1: int, b: bytes) -> tuple[int, int]:
    w = np.frombuffer(b, ">u4" if big else "<u4").astype(np.uint32).reshape(-1, 2)
    p = _wal_powers(len(w))
    # a pair (x, y) adds x to the first sum, and x + y to the second
    first, both = w[:, 0], w[:, 0] + w[:, 1]
    out = [int((p[1:, i, 0] * first + p[1:, i, 1] * both).sum(dtype=np.uint32)) + int(p[0, i, 0]) * s0 + int(p[0, i, 1]) * s1 & M32 for i in (0, 1)]
    return out[0], out[1]


def read_wal(b: bytes, offset: int | None = None, salts: tuple[int, int] | None = None) -> Iterator[dict]:
    """Frames until the first that is short or fails salt or checksum, which ends the log. With offset, from that frame on, seeded by the frame before."""
    if len(b) < 32:
        raise EmptyLog("short wal header")
    magic, version, page_size, _, salt1, salt2, c0, c1 = struct.unpack(">8I", b[:32])
    if magic not in (WAL_MAGIC_LE, WAL_MAGIC_BE):
        raise FormatError("bad wal magic")
    big = magic == WAL_MAGIC_BE
    ck = wal_checksum(big, 0, 0, b[:24])
    if ck != (c0, c1):
        raise EmptyLog("wal header checksum mismatch")
    if version != WAL_VERSION:
        raise FormatError("bad wal version")
    size, at = page_size + 24, 32
    if offset is not None:
        if offset <= 32 or (offset - 32) % size or offset > len(b):
            raise FormatError("offset is no frame's")
        before = struct.unpack(">6I", b[offset - size : offset - size + 24])
        if before[2:4] != salts:
            raise FormatError("salts differ")
        ck, at, (salt1, salt2) = before[4:], offset, salts
    n = (at - 32) // size
    while at + size <= len(b):
        pgno, commit, s1, s2, k0, k1 = struct.unpack(">6I", b[at : at + 24])
        if (s1, s2) != (salt1, salt2):
            return
        ck = wal_checksum(big, *wal_checksum(big, *ck, b[at : at + 8]), b[at + 24 : at + size])
        if ck != (k0, k1):
            return
        yield {"frame_n": n, "offset": at, "pgno": pgno, "commit": commit, "salt1": s1, "salt2": s2, "data": b[at + 24 : at + size]}
        at, n = at + size, n + 1


def db_header(b: bytes) -> dict:
    if len(b) < 100 or b[:16] != DB_MAGIC:
        raise FormatError("not a database")
    size, write, read = struct.unpack(">HBB", b[16:20])
    change, count = struct.unpack(">II", b[24:32])
    return {"page_size": 65536 if size == 1 else size, "write_version": write, "read_version": read, "change_counter": change, "page_count": count}
