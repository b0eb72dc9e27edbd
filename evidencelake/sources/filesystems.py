"""Directory entries out of file-system structures: NTFS file records, FAT directories.

File records of NTFS are independent of each other, so a table of them is parsed in parallel, chunk by chunk.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Epoch of FILETIME, preference of file-name spaces (Win32+DOS, Win32, POSIX, DOS).
_1601 = datetime(1601, 1, 1, tzinfo=UTC)
SPACES = (3, 1, 0, 2)
ENTRY = "part long, node string, parent string, name string, is_dir boolean, deleted boolean, size long, resident boolean, created string, modified string, accessed string, mft_modified string, fn_created string, fn_modified string, streams array<string>"


def filetime(value: int) -> str | None:
    if not value:
        return None
    try:
        return (_1601 + timedelta(microseconds=value // 10)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    except OverflowError:
        return None


def fixed_up(record: bytes, sector: int = 512) -> bytes | None:
    """A record with its sectors' last bytes put back; None if they are torn."""
    at, count = struct.unpack_from("<HH", record, 4)
    if count < 1 or at + 2 * count > len(record) or (count - 1) * sector > len(record):
        return None
    out = bytearray(record)
    for i in range(1, count):
        end = i * sector - 2
        if out[end : end + 2] != record[at : at + 2]:
            return None
        out[end : end + 2] = record[at + 2 * i : at + 2 * i + 2]
    return bytes(out)


def file_record(record: bytes, number: int) -> dict | None:
    """An entry of a FILE record; None if it is none or is an extension of another."""
    if record[:4] != b"FILE" or (raw := fixed_up(record)) is None:
        return None
    at, flags = struct.unpack_from("<HH", raw, 20)
    if struct.unpack_from("<Q", raw, 32)[0] & 0xFFFFFFFFFFFF:
        return None
    entry = {"node": str(number), "is_dir": bool(flags & 2), "deleted": not flags & 1, "size": 0, "resident": None, "streams": []}
    names = {}
    while at + 16 <= len(raw):
        kind, size = struct.unpack_from("<II", raw, at)
        if kind == 0xFFFFFFFF or size < 16 or at + size > len(raw):
            break
        resident, name_size, name_at = raw[at + 8] == 0, raw[at + 9], struct.unpack_from("<H", raw, at + 10)[0]
        label = raw[at + name_at : at + name_at + 2 * name_size].decode("utf-16-le", "replace")
        length, start = struct.unpack_from("<IH", raw, at + 16) if resident else (0, 0)
        body = raw[at + start : at + start + length] if resident else b""
        if kind == 0x10 and len(body) >= 32:
            times = struct.unpack_from("<4Q", body)
            entry |= dict(zip(("created", "modified", "mft_modified", "accessed"), map(filetime, times), strict=True))
        elif kind == 0x30 and len(body) >= 66:
            name = body[66 : 66 + 2 * body[64]].decode("utf-16-le", "replace")
            names[body[65]] = (name, struct.unpack_from("<Q", body)[0] & 0xFFFFFFFFFFFF, struct.unpack_from("<2Q", body, 8))
        elif kind == 0x80:
            real = length if resident else struct.unpack_from("<Q", raw, at + 48)[0] if at + 56 <= len(raw) else 0
            if label:
                entry["streams"].append(f"{label}:{real}")
            else:
                entry |= {"size": real, "resident": resident}
        at += size
    for space in SPACES:
        if space in names:
            name, parent, (made, changed) = names[space]
            return entry | {"name": name, "parent": str(parent), "fn_created": filetime(made), "fn_modified": filetime(changed)}
    return entry | {"name": None, "parent": None}


def runs(data: bytes) -> list[tuple[int | None, int]]:
    """(cluster or None where sparse, clusters) of a run list; bounded by its bytes."""
    out, at, cluster = [], 0, 0
    while at < len(data) and data[at]:
        size, place = data[at] & 15, data[at] >> 4
        length = int.from_bytes(data[at + 1 : at + 1 + size], "little")
        if not size or at + 1 + size + place > len(data):
            break
        if place:
            cluster += int.from_bytes(data[at + 1 + size : at + 1 + size + place], "little", signed=True)
        out.append((cluster if place else None, length))
        at += 1 + size + place
    return out


def mft_entries(chunks: DataFrame, part: int = 0, record: int = 1024) -> DataFrame:
    """Entries of a master file table given as chunks (offset, data) of whole records: each task parses its own."""
    names = [c.split()[0] for c in ENTRY.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for offset, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for at in range(0, len(data) - record + 1, record):
                    try:
                        found = file_record(data[at : at + record], (offset + at) // record)
                    except struct.error:
                        found = None
                    if found:
                        rows.append([part, *(found.get(n) for n in names[1:])])
            kinds = [pa.int64(), *[pa.string()] * 3, pa.bool_(), pa.bool_(), pa.int64(), pa.bool_(), *[pa.string()] * 6, pa.list_(pa.string())]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return chunks.select("offset", "data").where(F.length("data") >= record).mapInArrow(parse, ENTRY)


def dos_time(date: int, time: int) -> str | None:
    """Zoneless, as FAT records it."""
    try:
        return datetime(1980 + (date >> 9), date >> 5 & 15, date & 31, time >> 11, time >> 5 & 63, (time & 31) * 2).strftime("%Y-%m-%dT%H:%M:%S")
    except ValueError:
        return None


class Fat:
    """FAT12/16/32: directories, deleted entries, long names; chains are bounded and never followed twice."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        b = read(0, 512)
        self.sector, per, reserved, copies, roots, small = struct.unpack_from("<HBHBHH", b, 11)
        fat16, large, fat32 = struct.unpack_from("<H", b, 22)[0], struct.unpack_from("<I", b, 32)[0], struct.unpack_from("<I", b, 36)[0]
        if self.sector not in (512, 1024, 2048, 4096) or not per or per & (per - 1) or not copies:
            raise ValueError("not a FAT volume")
        size, total = fat16 or fat32, small or large
        root_sectors = -(-roots * 32 // self.sector)
        self.data = (reserved + copies * size + root_sectors) * self.sector
        self.cluster, self.root_at, self.root_size = per * self.sector, (reserved + copies * size) * self.sector, roots * 32
        self.count = max(0, (total - self.data // self.sector) // per)
        self.bits = 12 if self.count < 4085 else 16 if self.count < 65525 else 32
        self.fat = read(reserved * self.sector, min(size * self.sector, 64 << 20))
        self.root = struct.unpack_from("<I", b, 44)[0] if self.bits == 32 else 0

    def next(self, cluster: int) -> int:
        if self.bits == 12:
            pair = int.from_bytes(self.fat[cluster * 3 // 2 : cluster * 3 // 2 + 2], "little")
            return pair >> 4 if cluster & 1 else pair & 0xFFF
        width = self.bits // 8
        return int.from_bytes(self.fat[cluster * width : cluster * width + width], "little") & 0x0FFFFFFF

    def chain(self, cluster: int) -> list[int]:
        out, seen, last = [], set(), (1 << min(self.bits, 28)) - 8
        while 2 <= cluster < self.count + 2 and cluster < last and cluster not in seen:
            seen.add(cluster)
            out.append(cluster)
            cluster = self.next(cluster)
        return out

    def content(self, cluster: int, size: int | None = None, deleted: bool = False) -> bytes:
        if deleted and size:
            return self.read(self.data + (cluster - 2) * self.cluster, size)  # taken to be contiguous
        whole = b"".join(self.read(self.data + (c - 2) * self.cluster, self.cluster) for c in self.chain(cluster))
        return whole if size is None else whole[:size]

    def entries(self, raw: bytes, parent: str) -> Iterator[dict]:
        long: list[tuple[int, str]] = []
        for at in range(0, len(raw) - 31, 32):
            e = raw[at : at + 32]
            if not e[0]:
                return
            if e[11] & 0x3F == 0x0F:
                long.append((e[0] & 0x3F, (e[1:11] + e[14:26] + e[28:32]).decode("utf-16-le", "replace").split("\0")[0].rstrip("￿")))
                continue
            deleted = e[0] == 0xE5
            stem = ("_" if deleted else "\xe5" if e[0] == 5 else chr(e[0])) + e[1:8].decode("cp437")
            short = stem.rstrip() + (f".{e[8:11].decode('cp437').rstrip()}" if e[8:11].strip() else "")
            pieces = long if deleted else sorted(long)
            name = "".join(x for _, x in (reversed(pieces) if deleted else pieces)) or short
            long = []
            if e[11] & 8 or short in (".", ".."):
                continue
            cluster = struct.unpack_from("<H", e, 26)[0] | (struct.unpack_from("<H", e, 20)[0] << 16 if self.bits == 32 else 0)
            made_t, made_d, seen_d = struct.unpack_from("<HHH", e, 14)
            changed_t, changed_d = struct.unpack_from("<HH", e, 22)
            yield {
                "node": str(cluster), "parent": parent, "name": name, "short_name": short, "is_dir": bool(e[11] & 16), "deleted": deleted, "size": struct.unpack_from("<I", e, 28)[0],
                "created": dos_time(made_d, made_t), "modified": dos_time(changed_d, changed_t), "accessed": dos_time(seen_d, 0),
            }

    def walk(self, depth: int = 64, budget: int = 5_000_000) -> Iterator[dict]:
        root = self.content(self.root) if self.bits == 32 else self.read(self.root_at, self.root_size)
        stack, seen = [(root, "0", "", 1)], {self.root}
        while stack and budget > 0:
            raw, parent, path, level = stack.pop()
            for e in self.entries(raw, parent):
                budget -= 1
                e["path"] = f"{path}/{e['name']}"
                yield e
                cluster = int(e["node"])
                if e["is_dir"] and not e["deleted"] and level < depth and cluster not in seen:
                    seen.add(cluster)
                    stack.append((self.content(cluster), e["node"], e["path"], level + 1))
