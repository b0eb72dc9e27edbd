"""Directory entries of exFAT and of ext2, ext3 and ext4 volumes."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

from evidencelake.sources.filesystems import dos_time

Read = Callable[[int, int], bytes]


def exfat_time(stamp: int, tenths: int, offset: int) -> str | None:
    """Zoneless, unless the entry says its offset from UTC, in quarters of an hour."""
    text = dos_time(stamp >> 16, stamp & 0xFFFF)
    if text is None or not offset & 0x80:
        return text
    quarters = offset & 0x7F
    quarters -= 128 if quarters >= 64 else 0
    moment = datetime.strptime(text, "%Y-%m-%dT%H:%M:%S").replace(tzinfo=UTC).timestamp() - quarters * 900 + tenths / 100
    return datetime.fromtimestamp(moment, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


class ExFat:
    def __init__(self, read: Read):
        self.read = read
        b = read(0, 512)
        if b[3:11] != b"EXFAT   ":
            raise ValueError("not an exFAT volume")
        fat, size, heap, self.count, self.root = struct.unpack_from("<5I", b, 80)
        sector, cluster = 1 << min(b[108], 12), min(b[109], 25)
        self.heap, self.cluster = heap * sector, sector << cluster
        self.fat = read(fat * sector, min(size * sector, 64 << 20))

    def chain(self, first: int, size: int | None, whole: bool) -> list[int]:
        if whole and size is not None:
            return list(range(first, min(first + -(-size // self.cluster), self.count + 2)))
        out, seen = [], set()
        while 2 <= first < self.count + 2 and first not in seen and 4 * first + 4 <= len(self.fat):
            seen.add(first)
            out.append(first)
            first = struct.unpack_from("<I", self.fat, 4 * first)[0]
        return out

    def content(self, first: int, size: int | None, whole: bool) -> bytes:
        data = b"".join(self.read(self.heap + (c - 2) * self.cluster, self.cluster) for c in self.chain(first, size, whole))
        return data if size is None else data[:size]

    def entries(self, raw: bytes, parent: str) -> Iterator[dict]:
        at = 0
        while at + 32 <= len(raw):
            kind = raw[at]
            if kind == 0:
                return
            count = raw[at + 1]
            if kind & 0x7F != 0x05 or not 2 <= count <= 18 or at + 32 * (count + 1) > len(raw):
                at += 32
                continue
            e, stream = raw[at : at + 32], raw[at + 32 : at + 64]
            made, changed, seen = struct.unpack_from("<III", e, 8)
            flags, length = stream[1], stream[3]
            first, size = struct.unpack_from("<IQ", stream, 20)
            name = b"".join(raw[at + 32 * i + 2 : at + 32 * i + 32] for i in range(2, count + 1)).decode("utf-16-le", "replace")[:length]
            yield {
                "node": str(first), "parent": parent, "name": name, "is_dir": bool(struct.unpack_from("<H", e, 4)[0] & 16), "deleted": kind == 0x05, "size": size, "contiguous": bool(flags & 2),
                "created": exfat_time(made, e[20], e[22]), "modified": exfat_time(changed, e[21], e[23]), "accessed": exfat_time(seen, 0, e[24]),
            }
            at += 32 * (count + 1)

    def walk(self, depth: int = 64, budget: int = 5_000_000) -> Iterator[dict]:
        stack, seen = [(self.content(self.root, None, False), "root", "", 1)], {self.root}
        while stack and budget > 0:
            raw, parent, path, level = stack.pop()
            for e in self.entries(raw, parent):
                budget -= 1
                e["path"] = f"{path}/{e['name']}"
                yield e
                first = int(e["node"])
                if e["is_dir"] and not e["deleted"] and level < depth and first not in seen:
                    seen.add(first)
                    stack.append((self.content(first, e["size"], e["contiguous"]), e["node"], e["path"], level + 1))


def _unix(seconds: int, extra: int = 0) -> str | None:
    if not seconds and not extra:
        return None
    return datetime.fromtimestamp(seconds + ((extra & 3) << 32), UTC).strftime("%Y-%m-%dT%H:%M:%S") + (f".{extra >> 2:09d}" if extra >> 2 else "") + "Z"


class Ext:
    """Inodes by extents or block maps, inline data not followed; directories linear, as hashed ones are in their leaves."""

    def __init__(self, read: Read):
        self.read = read
        s = read(1024, 1024)
        if s[56:58] != b"\x53\xef":
            raise ValueError("not an ext volume")
        log = struct.unpack_from("<I", s, 24)[0]
        if log > 6:
            raise ValueError("blocks are too large")
        self.block, self.per_group = 1024 << log, struct.unpack_from("<I", s, 40)[0]
        self.inodes, self.inode_size = struct.unpack_from("<I", s)[0], struct.unpack_from("<H", s, 88)[0] if struct.unpack_from("<I", s, 76)[0] else 128
        self.incompat = struct.unpack_from("<I", s, 96)[0]
        self.wide = struct.unpack_from("<H", s, 254)[0] if self.incompat & 0x80 else 32
        first = struct.unpack_from("<I", s, 20)[0]
        self.groups = (first + 1) * self.block
        if not self.per_group or self.inode_size < 128:
            raise ValueError("a broken super block")

    def inode(self, number: int) -> bytes:
        group, index = divmod(number - 1, self.per_group)
        d = self.read(self.groups + group * self.wide, self.wide)
        table = struct.unpack_from("<I", d, 8)[0] | (struct.unpack_from("<I", d, 40)[0] << 32 if self.wide >= 64 else 0)
        return self.read(table * self.block + index * self.inode_size, self.inode_size)

    def runs(self, inode: bytes) -> Iterator[tuple[int, int, int]]:
        """(logical block, physical block, blocks)."""
        if struct.unpack_from("<I", inode, 32)[0] & 0x80000:
            yield from self._extents(inode[40:100], 0)
            return
        pointers = struct.unpack_from("<15I", inode, 40)
        for i in range(12):
            if pointers[i]:
                yield i, pointers[i], 1
        width, at = self.block // 4, 12
        for level in (1, 2, 3):
            if pointers[11 + level]:
                yield from self._map(pointers[11 + level], level, at)
            at += width**level

    def _map(self, block: int, level: int, at: int) -> Iterator[tuple[int, int, int]]:
        width = self.block // 4
        for i, (p,) in enumerate(struct.iter_unpack("<I", self.read(block * self.block, self.block))):
            if p and level == 1:
                yield at + i, p, 1
            elif p:
                yield from self._map(p, level - 1, at + i * width ** (level - 1))

    def _extents(self, node: bytes, depth: int) -> Iterator[tuple[int, int, int]]:
        magic, count, _, level = struct.unpack_from("<HHHH", node)
        if magic != 0xF30A or depth > 5:
            return
        for i in range(min(count, (len(node) - 12) // 12)):
            e = node[12 + 12 * i : 24 + 12 * i]
            if level:
                low, high = struct.unpack_from("<IH", e, 4)
                yield from self._extents(self.read((low | high << 32) * self.block, self.block), depth + 1)
            else:
                logical, length, high, low = struct.unpack("<IHHI", e)
                if length <= 32768:
                    yield logical, low | high << 32, length

    def size(self, inode: bytes) -> int:
        return struct.unpack_from("<I", inode, 4)[0] | struct.unpack_from("<I", inode, 108)[0] << 32

    def content(self, inode: bytes, most: int = 256 << 20) -> bytes:
        size = min(self.size(inode), most)
        out = bytearray(size)
        for logical, physical, length in self.runs(inode):
            at = logical * self.block
            if at < size:
                part = self.read(physical * self.block, min(length * self.block, size - at))
                out[at : at + len(part)] = part
        return bytes(out)

    def walk(self, depth: int = 64, budget: int = 5_000_000) -> Iterator[dict]:
        stack, seen = [(2, "", 1)], {2}
        while stack and budget > 0:
            number, path, level = stack.pop()
            raw, at = self.content(self.inode(number)), 0
            while at + 8 <= len(raw) and budget > 0:
                child, size, n, kind = struct.unpack_from("<IHBB", raw, at)
                if size < 8:
                    break
                name = raw[at + 8 : at + 8 + n].decode("utf-8", "replace")
                at += size
                if not child or child > self.inodes or name in (".", ".."):
                    continue
                budget -= 1
                i = self.inode(child)
                if len(i) < 128:
                    continue
                mode, uid = struct.unpack_from("<HH", i)
                accessed, changed, modified, gone = struct.unpack_from("<4I", i, 8)
                extra = lambda o: struct.unpack_from("<I", i, o)[0] if len(i) >= o + 4 else 0  # noqa: B023, E731
                is_dir = mode & 0xF000 == 0x4000
                yield {
                    "node": str(child), "parent": str(number), "name": name, "path": f"{path}/{name}", "is_dir": is_dir, "deleted": bool(gone), "size": self.size(i), "mode": f"{mode & 0o7777:04o}", "uid": uid,
                    "links": struct.unpack_from("<H", i, 26)[0], "accessed": _unix(accessed, extra(140)), "changed": _unix(changed, extra(132)), "modified": _unix(modified, extra(136)),
                    "created": _unix(extra(144), extra(148)), "deleted_at": _unix(gone),
                }
                if is_dir and child not in seen and level < depth:
                    seen.add(child)
                    stack.append((child, f"{path}/{name}", level + 1))
