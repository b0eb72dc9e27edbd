"""Containers inside files and disks: OLE2 compound files, LevelDB stores, sparse VMDK extents, dynamic VHDX."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

from evidencelake.functions.codecs import crc32c, snappy
from evidencelake.sources.artefacts import shortcut
from evidencelake.sources.filesystems import filetime

Read = Callable[[int, int], bytes]


class Ole2:
    """Streams of a compound file; every chain is followed once at most."""

    def __init__(self, data: bytes):
        if data[:8] != bytes.fromhex("d0cf11e0a1b11ae1"):
            raise ValueError("not a compound file")
        self.data, self.size = data, 1 << struct.unpack_from("<H", data, 30)[0]
        self.mini_size = 1 << struct.unpack_from("<H", data, 32)[0]
        if self.size not in (512, 4096) or self.mini_size != 64:
            raise ValueError("odd sector sizes")
        _, start, _, _, mini_fat, _, more, count = struct.unpack_from("<8I", data, 44)
        table = [s for s in struct.unpack_from("<109I", data, 76) if s < 0xFFFFFFFA]
        seen: set[int] = set()
        while more < 0xFFFFFFFA and more not in seen and len(seen) <= count:
            seen.add(more)
            entries = struct.unpack(f"<{self.size // 4}I", self.sector(more))
            table += [s for s in entries[:-1] if s < 0xFFFFFFFA]
            more = entries[-1]
        self.fat = [x for s in table for x in struct.unpack(f"<{self.size // 4}I", self.sector(s))]
        raw = self.chain(start, self.fat, self.sector)
        self.entries = [self._entry(raw[i : i + 128]) for i in range(0, len(raw) - 127, 128)]
        mini = self.chain(mini_fat, self.fat, self.sector) if mini_fat < 0xFFFFFFFA else b""
        self.mini_fat = [x for (x,) in struct.iter_unpack("<I", mini)]
        self.mini = self.chain(self.entries[0]["start"], self.fat, self.sector) if self.entries else b""

    def sector(self, n: int) -> bytes:
        return self.data[(n + 1) * self.size : (n + 2) * self.size].ljust(self.size, b"\0")

    @staticmethod
    def chain(at: int, table: list[int], read: Callable[[int], bytes]) -> bytes:
        out, seen = [], set()
        while at < len(table) and at not in seen:
            seen.add(at)
            out.append(read(at))
            at = table[at]
        return b"".join(out)

    @staticmethod
    def _entry(e: bytes) -> dict:
        n = struct.unpack_from("<H", e, 64)[0]
        made, changed, start = struct.unpack_from("<QQI", e, 100)
        return {"name": e[: max(0, min(64, n) - 2)].decode("utf-16-le", "replace"), "kind": e[66], "created": filetime(made), "modified": filetime(changed), "start": start, "size": struct.unpack_from("<I", e, 120)[0]}

    def streams(self) -> Iterator[tuple[str, bytes]]:
        for e in self.entries:
            if e["kind"] != 2:
                continue
            if e["size"] >= 4096:
                data = self.chain(e["start"], self.fat, self.sector)
            else:
                data = self.chain(e["start"], self.mini_fat, lambda n: self.mini[n * 64 : n * 64 + 64])
            yield e["name"], data[: e["size"]]


JUMPLIST = "entry long, host string, accessed string, path string, access_count long, pinned boolean, target string, orphan boolean"


def jump_list(data: bytes) -> Iterator[tuple]:
    """Entries of DestList, each with the link stream that its number names in hexadecimal; links nobody names are orphans."""
    streams = dict(Ole2(data).streams())
    listed = streams.pop("DestList", b"")
    links = {}
    for name, raw in streams.items():
        try:
            links[int(name, 16)] = next(shortcut(raw))[5]
        except (ValueError, struct.error, IndexError):
            continue
    version = struct.unpack_from("<I", listed)[0] if len(listed) >= 32 else 0
    at, used, fixed = 32, set(), 130 if version >= 3 else 114
    while at + fixed <= len(listed):
        number, accessed = struct.unpack_from("<Q", listed, at + 88)[0] & 0xFFFFFFFF, struct.unpack_from("<Q", listed, at + 100)[0]
        pinned = struct.unpack_from("<i", listed, at + 108)[0] >= 0
        count = struct.unpack_from("<I", listed, at + 116)[0] if version >= 3 else None
        n = struct.unpack_from("<H", listed, at + fixed - 2)[0]
        path = listed[at + fixed : at + fixed + 2 * n].decode("utf-16-le", "replace")
        used.add(number)
        yield (number, listed[at + 72 : at + 88].split(b"\0")[0].decode("latin-1"), filetime(accessed), path, count, pinned, links.get(number), False)
        at += fixed + 2 * n + (4 if version >= 3 else 0)
    for number in sorted(links.keys() - used):
        yield (number, None, None, None, None, None, links[number], True)


LEVELDB = "key binary, value binary, sequence long, deleted boolean, source string"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128 or shift > 63:
            return value, at


def _block(data: bytes, at: int, size: int) -> bytes:
    raw = data[at : at + size]
    return snappy(raw) if data[at + size] == 1 else raw


def _pairs(block: bytes) -> Iterator[tuple[bytes, bytes]]:
    end = len(block) - 4 - 4 * struct.unpack_from("<I", block, len(block) - 4)[0]
    at, key = 0, b""
    while at < end:
        shared, at = _varint(block, at)
        own, at = _varint(block, at)
        size, at = _varint(block, at)
        key = key[:shared] + block[at : at + own]
        yield key, block[at + own : at + own + size]
        at += own + size


def leveldb_table(data: bytes) -> Iterator[tuple]:
    """Every version and tombstone of a sorted table; none is resolved away."""
    if data[-8:] != bytes.fromhex("57fb808b247547db"):
        raise ValueError("not a sorted table")
    at = len(data) - 48
    _, at = _varint(data, at)
    _, at = _varint(data, at)
    place, at = _varint(data, at)
    size, _ = _varint(data, at)
    for _, handle in _pairs(_block(data, place, size)):
        place, at = _varint(handle, 0)
        size, _ = _varint(handle, at)
        for key, value in _pairs(_block(data, place, size)):
            mark = struct.unpack("<Q", key[-8:])[0]
            yield (key[:-8], value, mark >> 8, not mark & 1, "table")


def leveldb_log(data: bytes) -> Iterator[tuple]:
    """Batches of a write-ahead log; records are joined over their 32 KiB blocks."""
    at, whole = 0, b""
    while at + 7 <= len(data):
        if 32768 - at % 32768 < 7:
            at += 32768 - at % 32768
            continue
        size, kind = struct.unpack_from("<HB", data, at + 4)
        if not kind:
            at += 32768 - at % 32768
            continue
        whole = (b"" if kind in (1, 2) else whole) + data[at + 7 : at + 7 + size]
        at += 7 + size
        if kind in (1, 4) and len(whole) >= 12:
            sequence, count = struct.unpack_from("<QI", whole)
            p = 12
            for n in range(count):
                if p >= len(whole):
                    break
                put = whole[p]
                length, p = _varint(whole, p + 1)
                key, p = whole[p : p + length], p + length
                value = None
                if put:
                    length, p = _varint(whole, p)
                    value, p = whole[p : p + length], p + length
                yield (key, value, sequence + n, not put, "log")


class SparseVmdk:
    """A hosted sparse extent: grains through a directory of tables, deflated in stream-optimised ones."""

    def __init__(self, read: Read):
        self.read = read
        h = read(0, 512)
        if h[:4] != b"KDMV":
            raise ValueError("not a sparse extent")
        self.flags, capacity, self.grain = struct.unpack_from("<IQQ", h, 8)
        at, size, self.per_table = struct.unpack_from("<QQI", h, 28)
        directory = struct.unpack_from("<Q", h, 56)[0]
        if b"parentFileNameHint" in read(at * 512, min(size * 512, 1 << 16)):
            raise ValueError("a differencing disk needs its parent")
        self.size = capacity * 512
        tables = -(-capacity // (self.grain * self.per_table))
        self.tables = [x for (x,) in struct.iter_unpack("<I", read(directory * 512, 4 * tables))]

    def read_at(self, offset: int, length: int) -> bytes:
        out, end = bytearray(), min(self.size, offset + length)
        while offset < end:
            number, inside = divmod(offset, self.grain * 512)
            part = min(end - offset, self.grain * 512 - inside)
            table = self.tables[number // self.per_table]
            place = struct.unpack("<I", self.read(table * 512 + 4 * (number % self.per_table), 4))[0] if table else 0
            if place < 2:
                out += bytes(part)
            elif self.flags & 0x10000:
                size = struct.unpack_from("<QI", self.read(place * 512, 12))[1]
                data = zlib.decompressobj().decompress(self.read(place * 512 + 12, size), self.grain * 512)
                out += data[inside : inside + part].ljust(part, b"\0")
            else:
                out += self.read(place * 512 + inside, part).ljust(part, b"\0")
            offset += part
        return bytes(out)


class Vhdx:
    """A fixed or dynamic disk by its region table, metadata and block table."""

    def __init__(self, read: Read):
        self.read = read
        if read(0, 8) != b"vhdxfile":
            raise ValueError("not a VHDX")
        regions = None
        for place in (192 << 10, 256 << 10):
            raw = bytearray(read(place, 65536))
            stated = struct.unpack_from("<I", raw, 4)[0]
            raw[4:8] = bytes(4)
            if raw[:4] == b"regi" and crc32c(bytes(raw)) == stated:
                regions = {bytes(raw[16 + 32 * i : 32 + 32 * i]): struct.unpack_from("<QI", raw, 32 + 32 * i) for i in range(min(2047, struct.unpack_from("<I", raw, 8)[0]))}
                break
        if regions is None:
            raise ValueError("no valid region table")
        table = regions[bytes.fromhex("6677c22d23f600429d64115e9bfd4a08")][0]
        at = regions[bytes.fromhex("06a27c8b90479a4bb8fe575f050f886e")][0]
        meta = read(at, 65536)
        items = {}
        for i in range(min(2047, struct.unpack_from("<H", meta, 10)[0])):
            place, size = struct.unpack_from("<II", meta, 48 + 32 * i)
            items[meta[32 + 32 * i : 48 + 32 * i]] = read(at + place, min(size, 4096))
        self.block, flags = struct.unpack_from("<II", items[bytes.fromhex("3767a1ca36fa434db3b633f0aa44e76b")])
        if flags & 2:
            raise ValueError("a differencing disk needs its parent")
        self.size = struct.unpack("<Q", items[bytes.fromhex("2442a52f1bcd7648b2115dbed83bf4b8")][:8])[0]
        sector = struct.unpack("<I", items[bytes.fromhex("1dbf41816fa90947ba47f233a8faab5f")][:4])[0]
        self.ratio = (1 << 23) * sector // self.block
        count = -(-self.size // self.block)
        self.table = [x for (x,) in struct.iter_unpack("<Q", read(table, 8 * (count + count // self.ratio + 1)))]

    def read_at(self, offset: int, length: int) -> bytes:
        out, end = bytearray(), min(self.size, offset + length)
        while offset < end:
            number, inside = divmod(offset, self.block)
            part = min(end - offset, self.block - inside)
            entry = self.table[number + number // self.ratio]
            out += self.read((entry >> 20 << 20) + inside, part).ljust(part, b"\0") if entry & 7 in (6, 7) else bytes(part)
            offset += part
        return bytes(out)
