"""Partition tables: MBR with extended chains, GPT with its backup, and the gaps between."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable

Read = Callable[[int, int], bytes]
# Partition types.
MBR_TYPES = {0x01: "FAT12", 0x04: "FAT16", 0x06: "FAT16", 0x07: "NTFS/exFAT", 0x0B: "FAT32", 0x0C: "FAT32", 0x0E: "FAT16", 0x82: "Linux swap", 0x83: "Linux", 0xAF: "HFS+", 0xEE: "GPT protective"}
GPT_TYPES = {
    "ebd0a0a2-b9e5-4433-87c0-68b6b72699c7": "Basic data", "c12a7328-f81f-11d2-ba4b-00a0c93ec93b": "EFI system", "0fc63daf-8483-4772-8e79-3d69d8477de4": "Linux",
    "e3c9e316-0b5c-4db8-817d-f92df00215ae": "Microsoft reserved", "48465300-0000-11aa-aa11-00306543ecac": "HFS+", "7c3457ef-0000-11aa-aa11-00306543ecac": "APFS",
}
EXTENDED = (0x05, 0x0F, 0x85)


def identify(read: Read, offset: int) -> str | None:
    """The file system that the first sectors of a volume name."""
    head = read(offset, 1536)
    if head[3:11] == b"NTFS    ":
        return "NTFS"
    if head[3:11] == b"EXFAT   ":
        return "exFAT"
    if head[3:11] == b"-FVE-FS-":
        return "BitLocker"
    if head[:4] == b"LUKS":
        return "LUKS"
    if head[82:87] == b"FAT32":
        return "FAT32"
    if head[54:59] in (b"FAT12", b"FAT16"):
        return head[54:59].decode()
    if head[1024:1026] in (b"H+", b"HX"):
        return "HFS+"
    if head[32:36] == b"NXSB":
        return "APFS"
    return "ext" if head[1080:1082] == b"\x53\xef" else None


def scan(read: Read, size: int, sector: int = 512) -> list[dict]:
    """Partitions and gaps in order, as rows: scheme, slot, type, detected, label, offset, size, allocated, note."""
    first = read(0, sector)
    rows: list[dict] = []
    if len(first) >= 512 and first[510:512] == b"\x55\xaa":
        table = _mbr(first, 0)
        if any(t == 0xEE for _, t, _, _ in table):
            rows = _gpt(read, size, sector)
        if not rows:
            rows = _mbr_rows(read, table, sector)
    if not rows and size and (kind := identify(read, 0)):
        rows = [_row("none", 0, kind, "", 0, size, "")]
    for r in rows:
        r["detected"] = identify(read, r["offset"])
        if r["offset"] + r["size"] > size:
            r["note"] = "ends after the source"
    rows.sort(key=lambda r: r["offset"])
    out, at = [], 0
    for r in rows:
        if r["offset"] > at:
            out.append(_row(r["scheme"], None, "gap", "", at, r["offset"] - at, "", False))
        out.append(r)
        at = max(at, r["offset"] + r["size"])
    if rows and at < size:
        out.append(_row(rows[0]["scheme"], None, "gap", "", at, size - at, "", False))
    return out


def _row(scheme, slot, kind, label, offset, size, note, allocated=True) -> dict:
    return {"scheme": scheme, "slot": slot, "type": kind, "detected": None, "label": label, "offset": offset, "size": size, "allocated": allocated, "note": note}


def _mbr(block: bytes, base: int) -> list[tuple[int, int, int, int]]:
    found = []
    for slot in range(4):
        entry = block[446 + 16 * slot : 462 + 16 * slot]
        start, count = struct.unpack_from("<II", entry, 8)
        if entry[4] and count:
            found.append((slot, entry[4], base + start, count))
    return found


def _mbr_rows(read: Read, table: list, sector: int) -> list[dict]:
    rows, number = [], 4
    for slot, kind, start, count in table:
        if kind not in EXTENDED:
            rows.append(_row("MBR", slot, MBR_TYPES.get(kind, f"type {kind:#04x}"), "", start * sector, count * sector, ""))
            continue
        link, seen = start, set()
        while link not in seen and len(seen) < 128:
            seen.add(link)
            block = read(link * sector, 512)
            if block[510:512] != b"\x55\xaa":
                break
            onward = None
            for _, t, at, n in _mbr(block, 0):
                if t in EXTENDED:
                    onward = start + at
                else:
                    rows.append(_row("MBR", number, MBR_TYPES.get(t, f"type {t:#04x}"), "", (link + at) * sector, n * sector, "logical"))
                    number += 1
            if onward is None:
                break
            link = onward
    return rows


def _gpt(read: Read, size: int, sector: int) -> list[dict]:
    for place, note in ((sector, ""), (size // sector * sector - sector, "from the backup table")):
        head = read(place, 92)
        if head[:8] != b"EFI PART":
            continue
        length, stated = struct.unpack_from("<II", head, 12)
        if not 92 <= length <= sector or zlib.crc32(read(place, length)[:16] + bytes(4) + read(place, length)[20:length]) != stated:
            continue
        at, count, width = struct.unpack_from("<QII", head, 72)
        if not 128 <= width <= 4096 or count > 1024:
            continue
        entries = read(at * sector, count * width)
        if zlib.crc32(entries) != struct.unpack_from("<I", head, 88)[0]:
            continue
        rows = []
        for slot in range(count):
            e = entries[slot * width : slot * width + 128]
            kind = str(uuid.UUID(bytes_le=e[:16]))
            if e[:16] == bytes(16):
                continue
            start, end = struct.unpack_from("<QQ", e, 32)
            rows.append(_row("GPT", slot, GPT_TYPES.get(kind, kind), e[56:128].decode("utf-16-le", "replace").split("\0")[0], start * sector, (end - start + 1) * sector, note))
        return rows
    return []
