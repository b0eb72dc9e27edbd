"""Byte sources: raw images, split sets and EWF segments, read as rows of chunks.

``register(spark)`` adds the format ``evidence``: ``spark.read.format("evidence").option("path", uri)`` gives
(source, offset, data, finding). Only tables of chunk offsets are read where partitions are planned; each task then reads
its own chunks, from any store that pyarrow's file systems know. A damaged chunk is zeros and a finding, never a shift.
"""

from __future__ import annotations

import posixpath
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "source string, offset long, data binary, finding string"
CHUNK, CHUNKS_PER_TASK = 1 << 20, 64
# First bytes of containers.
EWF = b"EVF\x09\x0d\x0a\xff\x00"
REFUSED = {b"EVF2\r\n\x81\x00": "EWF version 2", b"LVF\x09\x0d\x0a\xff\x00": "logical evidence file", b"AFF": "AFF", b"QFI\xfb": "QCOW", b"conectix": "VHD", b"<<< ": "VDI"}


class UnsupportedContainer(ValueError):
    """A container that is known and can't be read."""


def located(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


@dataclass
class Piece:
    """``size`` bytes at ``at`` of a file are the source's from ``offset``; ``stored`` bytes if compressed."""

    path: str
    at: int
    offset: int
    size: int
    stored: int = 0
    packed: bool = False
    summed: bool = False


def segments(uri: str) -> list[str]:
    """The files of a set, by the first one's name: .001 .002 ... or .E01 ... .E99 .EAA ...; a gap ends it with an error."""
    found = re.search(r"\.(\d{3}|[EeSs]\d{2})$", uri)
    if not found:
        return [uri]
    where, _ = located(uri)
    out, number, stem = [], int(found[1][-3:] if found[1].isdigit() else found[1][1:]), uri[: found.start()]

    def name(n: int) -> str:
        if found[1].isdigit():
            return f"{n:03d}"
        if n < 100:
            return f"{found[1][0]}{n:02d}"
        n, letters = n - 100, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        made = chr(ord(found[1][0].upper()) + n // 676) + letters[n // 26 % 26] + letters[n % 26]
        return made if found[1][0].isupper() else made.lower()

    while where.get_file_info(located(f"{stem}.{name(number)}")[1]).type == fs.FileType.File:
        out.append(f"{stem}.{name(number)}")
        number += 1
    folder, last = posixpath.split(located(f"{stem}.x")[1])
    pattern = r"\d{3}" if found[1].isdigit() else r"[A-Za-z][0-9A-Za-z]{2}"
    own = re.compile(re.escape(last[:-1]) + f"({pattern})")
    there = {m[1] for f in where.get_file_info(fs.FileSelector(folder or ".", allow_not_found=True)) if (m := own.fullmatch(f.base_name))}
    if not found[1].isdigit():
        there = {x for x in there if x[0].upper() >= found[1][0].upper() and x[0].isupper() == found[1][0].isupper() and (x[1:].isdigit() or x[1:].isalpha())}
    known = {x[-3:] for x in out}
    if later := sorted(there - known - {f"{n:03d}" for n in range(int(found[1]))} if found[1].isdigit() else there - known):
        raise ValueError(f"piece {name(number)} of {stem} is missing, though {later[0]} is there")
    return out


def pieces(uri: str) -> tuple[list[Piece], dict]:
    """The chunk table of a source and what its headers say."""
    where, path = located(uri)
    with where.open_input_file(path) as file:
        head = file.read(16)
    for magic, name in REFUSED.items():
        if head.startswith(magic):
            raise UnsupportedContainer(name)
    files = segments(uri)
    return _ewf(files) if head.startswith(EWF) else _raw(files)


def _raw(files: list[str]) -> tuple[list[Piece], dict]:
    out, offset = [], 0
    for uri in files:
        where, path = located(uri)
        size = where.get_file_info(path).size
        out += [Piece(uri, at, offset + at, min(CHUNK, size - at)) for at in range(0, size, CHUNK)]
        offset += size
    return out, {"format": "raw" if len(files) == 1 else "split", "size": offset, "segments": len(files)}


def _ewf(files: list[str]) -> tuple[list[Piece], dict]:
    out: list[Piece] = []
    info: dict = {"format": "ewf", "segments": len(files), "size": 0, "chunk": 32768}
    for number, uri in enumerate(files, 1):
        where, path = located(uri)
        with where.open_input_file(path) as file:
            total = file.size()
            head = file.read(13)
            if not head.startswith(EWF) or struct.unpack_from("<H", head, 9)[0] != number:
                raise ValueError(f"{uri} is not segment {number}")
            at, sectors_end, seen = 13, 0, set()
            while 0 < at < total and at not in seen:
                seen.add(at)
                file.seek(at)
                section = file.read(76)
                if len(section) < 76:
                    break
                kind = section[:16].rstrip(b"\0").decode("ascii", "replace")
                following, size = struct.unpack_from("<QQ", section, 16)
                if kind in ("volume", "disk"):
                    body = file.read(94)
                    _, _, per, width, sectors = struct.unpack_from("<IIIIQ", body)
                    info |= {"chunk": per * width, "size": sectors * width}
                elif kind == "sectors":
                    sectors_end = at + size
                elif kind == "table":
                    body = file.read(24)
                    count, base = struct.unpack_from("<I", body)[0], struct.unpack_from("<Q", body, 8)[0]
                    raw = file.read(min(4 * count, max(0, size - 100) or 4 * count))
                    entries = struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])
                    places = [base + (e & 0x7FFFFFFF) for e in entries]
                    for e, place, end in zip(entries, places, [*places[1:], sectors_end or at], strict=True):
                        offset = len(out) * info["chunk"]
                        out.append(Piece(uri, place, offset, min(info["chunk"], info["size"] - offset), end - place, bool(e >> 31), True))
                elif kind == "hash":
                    info["md5"] = file.read(16).hex()
                elif kind == "digest":
                    body = file.read(36)
                    info |= {"md5": body[:16].hex(), "sha1": body[16:36].hex()}
                if kind in ("next", "done") or following <= at:
                    break
                at = following
    return [p for p in out if p.size > 0], info


def read_piece(file, piece: Piece) -> tuple[bytes, str | None]:
    """The bytes of a chunk; zeros and a finding where it is damaged."""
    try:
        file.seek(piece.at)
        if not piece.summed:
            data = file.read(piece.size)
        elif piece.packed:
            inflate = zlib.decompressobj()
            data = inflate.decompress(file.read(min(piece.stored, 2 * piece.size + 4096)), piece.size)
        else:
            raw = file.read(piece.size + 4)
            data = raw[: piece.size]
            if zlib.adler32(data) != struct.unpack_from("<I", raw, piece.size)[0]:
                return bytes(piece.size), "checksum"
        if len(data) == piece.size:
            return data, None
        return data + bytes(piece.size - len(data)), "short"
    except (zlib.error, struct.error, OSError):
        return bytes(piece.size), "damaged"


@dataclass
class _Part(InputPartition):
    source: str
    parts: list[Piece]

    def __init__(self, source: str, parts: list[Piece]):
        super().__init__((source, parts[0].offset if parts else 0))
        self.source, self.parts = source, parts


class EvidenceReader(DataSourceReader):
    def __init__(self, uris: list[str]):
        self.uris = uris

    def partitions(self) -> list[_Part]:
        out = []
        for uri in self.uris:
            found, _ = pieces(uri)
            step = max(1, CHUNKS_PER_TASK * CHUNK // max(1, found[0].size if found else 1))
            out += [_Part(uri, found[at : at + step]) for at in range(0, len(found), step)]
        return out or [_Part("", [])]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("source", pa.string()), ("offset", pa.int64()), ("data", pa.binary()), ("finding", pa.string())])
        rows, size, path, file = [], 0, None, None
        for piece in partition.parts:
            if piece.path != path:
                where, place = located(piece.path)
                path, file = piece.path, where.open_input_file(place)
            data, finding = read_piece(file, piece)
            rows.append((partition.source, piece.offset, data, finding))
            size += len(data)
            if size >= 8 * CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class EvidenceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "evidence"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EvidenceReader:
        return EvidenceReader([u for u in self.options["path"].split(",") if u])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EvidenceSource)


def read(spark: SparkSession, *uris: str) -> DataFrame:
    register(spark)
    return spark.read.format("evidence").option("path", ",".join(uris)).load()


def folder(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as (path, size, modified, content); columns that aren't used aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).selectExpr("path", "length AS size", "modificationTime AS modified", "content")
