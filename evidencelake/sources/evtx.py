"""Event records out of binary XML: the header and every field as text, by chunks of 64 KiB that stand alone."""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

from evidencelake.sources.filesystems import filetime

EVTX = "record_id long, written_at string, event_id string, level string, provider string, channel string, computer string, security_sid string, created string, fields map<string,string>, unsupported string"
CHUNK, MOST_DEPTH = 65536, 32


def _sid(raw: bytes) -> str:
    if len(raw) < 8:
        return raw.hex()
    parts = struct.unpack_from(f"<{min(raw[1], (len(raw) - 8) // 4)}I", raw, 8)
    return "-".join(["S", str(raw[0]), str(int.from_bytes(raw[2:8], "big")), *map(str, parts)])


def value_text(kind: int, raw: bytes) -> str:
    """A typed value as text; arrays are joined by commas."""
    if kind & 0x80:
        inner, width = kind & 0x7F, {3: 1, 4: 1, 5: 2, 6: 2, 7: 4, 8: 4, 9: 8, 10: 8, 11: 4, 12: 8, 13: 4, 15: 16, 17: 8, 20: 4, 21: 8}.get(kind & 0x7F)
        if inner == 1:
            return ", ".join(x for x in raw.decode("utf-16-le", "replace").split("\0") if x)
        return ", ".join(value_text(inner, raw[i : i + width]) for i in range(0, len(raw) - width + 1, width)) if width else raw.hex()
    if kind == 1:
        return raw.decode("utf-16-le", "replace").rstrip("\0")
    if kind == 2:
        return raw.decode("cp1252", "replace").rstrip("\0")
    if kind in (3, 5, 7, 9):
        return str(int.from_bytes(raw, "little", signed=True))
    if kind in (4, 6, 8, 10):
        return str(int.from_bytes(raw, "little"))
    if kind in (11, 12):
        return repr(struct.unpack("<f" if kind == 11 else "<d", raw)[0])
    if kind == 13:
        return "true" if any(raw) else "false"
    if kind == 15:
        return "{" + str(uuid.UUID(bytes_le=raw)).upper() + "}"
    if kind == 17:
        return filetime(int.from_bytes(raw, "little")) or ""
    if kind == 18:
        y, m, _, d, h, n, s, ms = struct.unpack("<8H", raw)
        return f"{y:04d}-{m:02d}-{d:02d}T{h:02d}:{n:02d}:{s:02d}.{ms:03d}Z"
    if kind == 19:
        return _sid(raw)
    if kind in (20, 21):
        return f"0x{int.from_bytes(raw, 'little'):x}"
    return raw.hex()


class _Node:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str):
        self.name, self.attributes, self.children = name, [], []


class _Place:
    """A value that a template leaves open."""

    __slots__ = ("number", "optional")

    def __init__(self, number: int, optional: bool):
        self.number, self.optional = number, optional


class Chunk:
    def __init__(self, data: bytes):
        self.data = data
        self.templates: dict[int, list] = {}

    def name(self, at: int) -> tuple[str, int]:
        """A name at a place of the chunk, and how many bytes it takes there."""
        n = struct.unpack_from("<H", self.data, at + 6)[0]
        return self.data[at + 8 : at + 8 + 2 * n].decode("utf-16-le", "replace"), 10 + 2 * n

    def _named(self, at: int) -> tuple[str, int]:
        place = struct.unpack_from("<I", self.data, at)[0]
        text, size = self.name(place)
        return text, at + 4 + (size if place == at + 4 else 0)

    def fragment(self, at: int, end: int, depth: int = 0) -> tuple[list, int]:
        """Nodes, texts and places of a token stream, up to its end token."""
        root = _Node("")
        stack = [root]
        pending: str | None = None
        while at < end:
            token = self.data[at]
            kind = token & 0x0F if token not in (0x0C,) else 0x0C
            if token == 0:
                return root.children, at + 1
            if token == 0x0F:
                at += 4
            elif kind == 0x01:
                name, after = self._named(at + 7)
                node = _Node(name)
                stack[-1].children.append(node)
                stack.append(node)
                at = after + (4 if token & 0x40 else 0)
                pending = None
                if len(stack) > MOST_DEPTH:
                    raise ValueError("elements are too deep")
            elif kind == 0x06:
                pending, at = self._named(at + 1)
            elif kind == 0x02:
                pending, at = None, at + 1
            elif token in (0x03, 0x04):
                if len(stack) > 1:
                    stack.pop()
                pending, at = None, at + 1
            else:
                if kind == 0x05:
                    n = struct.unpack_from("<H", self.data, at + 2)[0]
                    item, at = self.data[at + 4 : at + 4 + 2 * n].decode("utf-16-le", "replace"), at + 4 + 2 * n
                elif token in (0x0D, 0x0E):
                    item, at = _Place(struct.unpack_from("<H", self.data, at + 1)[0], token == 0x0E), at + 4
                elif token == 0x0C:
                    made, at = self.instance(at, depth + 1)
                    stack[-1].children += made
                    continue
                elif kind == 0x08:
                    item, at = f"&#{struct.unpack_from('<H', self.data, at + 1)[0]};", at + 3
                elif kind == 0x09:
                    text, at = self._named(at + 1)
                    item = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}.get(text, f"&{text};")
                elif kind == 0x07:
                    n = struct.unpack_from("<H", self.data, at + 1)[0]
                    item, at = self.data[at + 3 : at + 3 + 2 * n].decode("utf-16-le", "replace"), at + 3 + 2 * n
                else:
                    raise ValueError(f"token {token:#x}")
                if pending is not None:
                    stack[-1].attributes.append((pending, item))
                else:
                    stack[-1].children.append(item)
        return root.children, at

    def instance(self, at: int, depth: int) -> tuple[list, int]:
        """A template with its values put in."""
        if depth > 8:
            raise ValueError("templates are too deep")
        place = struct.unpack_from("<I", self.data, at + 6)[0]
        size = struct.unpack_from("<I", self.data, place + 20)[0]
        if place not in self.templates:
            self.templates[place] = self.fragment(place + 24, place + 24 + size, depth)[0]
        at = at + 10 if place != at + 10 else place + 24 + size
        count = struct.unpack_from("<I", self.data, at)[0]
        if count > 4096:
            raise ValueError("too many values")
        heads = [struct.unpack_from("<HBB", self.data, at + 4 + 4 * i) for i in range(count)]
        at += 4 + 4 * count
        values: list = []
        for n, kind, _ in heads:
            if kind == 0x21:
                values.append(self.fragment(at, at + n, depth + 1)[0])
            else:
                values.append(None if kind == 0 else value_text(kind, self.data[at : at + n]))
            at += n
        return [f for node in self.templates[place] for f in _filled(node, values)], at


def _filled(item, values: list) -> list:
    if isinstance(item, _Place):
        value = values[item.number] if item.number < len(values) else None
        return [] if value is None else value if isinstance(value, list) else [value]
    if isinstance(item, str):
        return [item]
    node = _Node(item.name)
    for name, value in item.attributes:
        got = "".join(x for x in _filled(value, values) if isinstance(x, str))
        if got:
            node.attributes.append((name, got))
    node.children = [f for child in item.children for f in _filled(child, values)]
    return [node]


def flatten(nodes: list, path: str = "", out: dict[str, str] | None = None) -> dict[str, str]:
    """Paths to texts; Data elements go by their Name, and a path that comes again gets a number."""
    out = {} if out is None else out

    def put(key: str, text: str) -> None:
        n, own = 2, key
        while own in out:
            own, n = f"{key}#{n}", n + 1
        out[own] = text

    for node in nodes:
        if not isinstance(node, _Node):
            continue
        here = f"{path}/{node.name}" if path else node.name
        names = dict(node.attributes)
        if node.name == "Data" and "Name" in names:
            here = f"{path}/{names.pop('Name')}"
        for name, value in names.items():
            if name != "xmlns":
                put(f"{here}@{name}", value)
        text = "".join(c for c in node.children if isinstance(c, str)).strip()
        if text:
            put(here, text)
        flatten(node.children, here, out)
    return out


def events(data: bytes) -> Iterator[tuple]:
    """Records of a whole log or of chunks of one; a record that can't be read says why."""
    start = 4096 if data[:8] == b"ElfFile\0" else 0
    for base in range(start, len(data) - 512, CHUNK):
        raw = data[base : base + CHUNK]
        if raw[:8] != b"ElfChnk\0":
            continue
        chunk = Chunk(raw)
        at, end = 512, min(len(raw), struct.unpack_from("<I", raw, 48)[0] or len(raw))
        while at + 28 <= end and raw[at : at + 4] == b"\x2a\x2a\0\0":
            size, number, when = struct.unpack_from("<IQQ", raw, at + 4)
            if size < 28 or at + size > len(raw):
                break
            fields, problem = {}, None
            try:
                fields = flatten(chunk.fragment(at + 24, at + size - 4)[0])
            except (ValueError, struct.error, IndexError, RecursionError) as found:
                problem = f"{type(found).__name__}: {found}"[:120]
            ends = lambda suffix: next((v for k, v in fields.items() if k.endswith(suffix)), None)  # noqa: B023, E731
            yield (number, filetime(when), ends("System/EventID"), ends("System/Level"), ends("Provider@Name"), ends("System/Channel"), ends("System/Computer"), ends("Security@UserID"), ends("TimeCreated@SystemTime"), list(fields.items()), problem)
            at += size


def count_records(data: bytes) -> int:
    return len(re.findall(rb"\x2a\x2a\x00\x00", data))
