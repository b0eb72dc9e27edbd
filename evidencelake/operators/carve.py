"""Signature carving over chunks of a byte source."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Extension, header (hex digits, ?? any byte), footer, most bytes.
SIGNATURES = [
    ("png", "89504e470d0a1a0a", "49454e44ae426082", 32 << 20), ("gif", "47494638??61", "003b", 16 << 20), ("jpg", "ffd8ff", "ffd9", 32 << 20),
    ("pdf", "255044462d", "2525454f46", 64 << 20), ("zip", "504b0304", "504b0506", 128 << 20), ("bmp", "424d????????00000000", "", 32 << 20),
    ("sqlite", "53514c69746520666f726d6174203300", "", 128 << 20), ("evtx", "456c6646696c6500", "", 64 << 20), ("regf", "72656766", "", 64 << 20), ("rtf", "7b5c727466", "7d", 8 << 20),
]
SCHEMA = "source long, offset long, length long, ext string, method string, bounded boolean, aligned boolean"


def pattern(text: str) -> re.Pattern:
    """Bytes of hex digits, ``??`` for any byte, and quoted ASCII."""
    out = b""
    for quoted, pair in re.findall(r'"([^"]*)"|([0-9A-Fa-f?]{2})', text):
        out += re.escape(quoted.encode("ascii")) if quoted else b"." if pair == "??" else re.escape(bytes.fromhex(pair))
    return re.compile(out, re.DOTALL)


def custom(spec: dict) -> tuple[str, str, str, int]:
    """A signature of a user, held to limits."""
    ext, header, footer, most = str(spec["ext"]).lower(), str(spec["header"]), str(spec.get("footer", "")), int(spec.get("max", 16 << 20))
    if not re.fullmatch(r"[a-z0-9]{1,10}", ext):
        raise ValueError("an extension has 1 to 10 letters or digits")
    if len(re.sub(r"\?\?|\s", "", header)) < 4:
        raise ValueError("a header has at least two fixed bytes")
    if not 16 <= most <= 128 << 20:
        raise ValueError("the most bytes lie between 16 and 128 MiB")
    return ext, header, footer, most


def structure_length(ext: str, data: bytes, at: int) -> int | None:
    """The length that a file's own fields give, if they make sense."""
    try:
        if ext == "png":
            p = at + 8
            while p + 8 <= len(data):
                size, kind = struct.unpack_from(">I4s", data, p)
                p += 12 + size
                if kind == b"IEND":
                    return p - at
            return None
        if ext == "bmp":
            size = struct.unpack_from("<I", data, at + 2)[0]
            return size if size > 54 else None
        if ext == "sqlite":
            page, pages = struct.unpack_from(">H", data, at + 16)[0], struct.unpack_from(">I", data, at + 28)[0]
            page = 65536 if page == 1 else page
            return page * pages if page >= 512 and page & (page - 1) == 0 and pages else None
        if ext == "regf":
            size = struct.unpack_from("<I", data, at + 40)[0]
            return size + 4096 if size and size % 4096 == 0 else None
    except struct.error:
        return None
    return None


def hits(chunks: DataFrame, signatures: list[tuple] | None = None, alignment: int = 512) -> DataFrame:
    """Hits of chunks (source, offset, data): by structure, else footer, else what is left up to the next header."""
    known = [(e, h, f, m) for e, h, f, m in (signatures or SIGNATURES)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(e, pattern(h), pattern(f) if f else None, m) for e, h, f, m in known]
        for frame in frames:
            rows = []
            for source, offset, data in zip(frame["source"], frame["offset"], frame["data"], strict=True):
                starts = sorted((found.start(), ext, footer, most) for ext, header, footer, most in compiled for found in header.finditer(data) if (offset + found.start()) % alignment == 0)
                places = [s[0] for s in starts]
                for n, (at, ext, footer, most) in enumerate(starts):
                    length, method = structure_length(ext, data, at), "structure"
                    if length is None and footer and (found := footer.search(data, at + 4, at + most)):
                        length, method = found.end() - at, "footer"
                    if length is None:
                        following = next((p for p in places[n + 1 :] if p > at), len(data))
                        length, method = min(most, following - at), "estimate"
                    rows.append((source, offset + at, min(length, most), ext, method, method != "estimate", (offset + at) % 512 == 0))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return chunks.select("source", "offset", "data").mapInPandas(run, SCHEMA)
