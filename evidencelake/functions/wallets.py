"""Addresses of wallets in text: candidates by pattern, kept where their checksum holds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Alphabets and the Bech32 generator.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
BECH32M = 0x2BC830A3
PATTERN = r"\b(?:[13][1-9A-HJ-NP-Za-km-z]{25,34}|bc1[02-9ac-hj-np-z]{11,71}|0x[0-9a-fA-F]{40})\b"


def base58check(text: str) -> bytes | None:
    """The payload, if the four bytes at the end are its double SHA-256's first."""
    number = 0
    for letter in text:
        at = BASE58.find(letter)
        if at < 0:
            return None
        number = number * 58 + at
    raw = b"\0" * (len(text) - len(text.lstrip("1"))) + number.to_bytes((number.bit_length() + 7) // 8, "big")
    body, check = raw[:-4], raw[-4:]
    return body if len(body) > 1 and hashlib.sha256(hashlib.sha256(body).digest()).digest()[:4] == check else None


def bech32(text: str) -> str | None:
    """``bech32`` or ``bech32m``, whichever checksum holds."""
    if text.lower() != text and text.upper() != text:
        return None
    human, _, data = text.lower().rpartition("1")
    if not human or len(data) < 6 or any(c not in BECH32 for c in data):
        return None
    sum_ = 1
    for value in [*(ord(c) >> 5 for c in human), 0, *(ord(c) & 31 for c in human), *(BECH32.index(c) for c in data)]:
        top, sum_ = sum_ >> 25, (sum_ & 0x1FFFFFF) << 5 ^ value
        for i, g in enumerate(GENERATOR):
            sum_ ^= g if top >> i & 1 else 0
    return {1: "bech32", BECH32M: "bech32m"}.get(sum_)


def verify(text: str) -> tuple[str, bool] | None:
    """(kind, unverified) of a candidate that stands; hexadecimal addresses of one case have no checksum to test."""
    if text.startswith("0x"):
        return ("eth", True)
    if text.lower().startswith("bc1"):
        kind = bech32(text)
        return (kind, False) if kind else None
    body = base58check(text)
    return ({0: "p2pkh", 5: "p2sh", 128: "key"}.get(body[0], "base58check"), False) if body else None


def candidates(docs: DataFrame) -> DataFrame:
    """(node, candidate) of (node, text)."""
    return docs.where(F.col("text").rlike(PATTERN)).select("node", F.explode(F.regexp_extract_all("text", F.lit(f"({PATTERN})"), F.lit(1))).alias("candidate"))


def addresses(docs: DataFrame) -> DataFrame:
    """(node, value, kind, unverified): only candidates reach Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, c, *found) for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (found := verify(c))]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.bool_()), strict=True)], ["node", "value", "kind", "unverified"])

    return candidates(docs).mapInArrow(run, "node long, value string, kind string, unverified boolean")




def mnemonic_runs(words: list[str], listed: dict[str, int], lengths: tuple[int, ...] = (24, 21, 18, 15, 12)) -> list[tuple[int, int, bool]]:
    """(start, length, valid) of seed phrases: the longest first, valid if the checksum bits are the entropy's hash."""
    out, at = [], 0
    while at < len(words):
        run = 0
        while at + run < len(words) and words[at + run] in listed:
            run += 1
        for n in lengths:
            if run >= n:
                bits = "".join(f"{listed[w]:011b}" for w in words[at : at + n])
                size = n * 11 * 32 // 33
                entropy = int(bits[:size], 2).to_bytes(size // 8, "big")
                valid = f"{hashlib.sha256(entropy).digest()[0]:08b}"[: n * 11 - size] == bits[size:]
                out.append((at, n, valid))
                at += n - 1
                break
        at += 1
    return out
