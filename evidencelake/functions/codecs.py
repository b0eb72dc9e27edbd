"""Decompressors and checksums of evidence formats, all bounded by what the caller allows."""

from __future__ import annotations

import struct


def lznt1(data: bytes, most: int = 64 << 20) -> bytes:
    """NTFS compression: chunks of 4 KiB, whose back references widen as the chunk grows."""
    out, at = bytearray(), 0
    while at + 2 <= len(data) and len(out) < most:
        head = struct.unpack_from("<H", data, at)[0]
        if not head:
            break
        at += 2
        end = min(len(data), at + (head & 0xFFF) + 1)
        if not head & 0x8000:
            out += data[at:end]
            at = end
            continue
        start = len(out)
        while at < end:
            flags = data[at]
            at += 1
            for bit in range(8):
                if at >= end:
                    break
                if not flags >> bit & 1:
                    out.append(data[at])
                    at += 1
                    continue
                if at + 2 > end:
                    return bytes(out)
                token = struct.unpack_from("<H", data, at)[0]
                at += 2
                done = len(out) - start
                if not done:
                    return bytes(out)
                bits = max(4, (done - 1).bit_length())
                distance, length = (token >> (16 - bits)) + 1, (token & (1 << (16 - bits)) - 1) + 3
                if distance > done:
                    return bytes(out)
                for _ in range(length):
                    out.append(out[-distance])
    return bytes(out[:most])


def snappy(data: bytes, most: int = 64 << 20) -> bytes:
    """The raw Snappy block format."""
    size, at, shift = 0, 0, 0
    while True:
        byte = data[at]
        at += 1
        size |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            break
        if shift > 35:
            raise ValueError("a broken length")
    if size > most:
        raise ValueError("a block is larger than allowed")
    out = bytearray()
    while at < len(data) and len(out) < size:
        tag = data[at]
        at += 1
        kind, n = tag & 3, tag >> 2
        if kind == 0:
            if n >= 60:
                width = n - 59
                n = int.from_bytes(data[at : at + width], "little")
                at += width
            out += data[at : at + n + 1]
            at += n + 1
            continue
        if kind == 1:
            length, distance = (n & 7) + 4, (tag >> 5) << 8 | data[at]
            at += 1
        else:
            width = 2 if kind == 2 else 4
            length, distance = n + 1, int.from_bytes(data[at : at + width], "little")
            at += width
        if not 0 < distance <= len(out):
            raise ValueError("a reference before the start")
        for _ in range(length):
            out.append(out[-distance])
    if len(out) != size:
        raise ValueError("a block ends early")
    return bytes(out)


def xpress_huffman(data: bytes, size: int) -> bytes:
    """LZ77 with Huffman codes: 64 KiB blocks, each with a table of 512 code lengths of four bits."""
    out, at = bytearray(), 0
    while len(out) < size:
        table = data[at : at + 256]
        if len(table) < 256:
            raise ValueError("a table is cut")
        lengths = [n for byte in table for n in (byte & 15, byte >> 4)]
        code, decode = 0, {}
        for bits in range(1, 16):
            for symbol in (s for s in range(512) if lengths[s] == bits):
                decode[bits, code] = symbol
                code += 1
            code <<= 1
        at += 256
        word = lambda p: struct.unpack_from("<H", data, p)[0] if p + 2 <= len(data) else 0
        hold, left, at = word(at) << 16 | word(at + 2), 32, at + 4
        end = min(size, len(out) + 65536)

        def take(n: int) -> int:
            nonlocal hold, left, at
            value = hold >> (left - n) & (1 << n) - 1 if n else 0
            left -= n
            hold &= (1 << left) - 1
            if left < 16:
                hold, left = hold << 16 | word(at), left + 16
                at += 2
            return value

        while len(out) < end:
            value = bits = 0
            while True:
                bits += 1
                if bits > 15:
                    raise ValueError("no such code")
                symbol = decode.get((bits, hold >> (left - bits) & (1 << bits) - 1))
                if symbol is not None:
                    break
            take(bits)
            if symbol < 256:
                out.append(symbol)
                continue
            length, wide = symbol & 15, symbol - 256 >> 4
            if length == 15:
                length = data[at] if at < len(data) else 0
                at += 1
                if length == 255:
                    length, at = word(at), at + 2
                    if not length:
                        length, at = word(at) | word(at + 2) << 16, at + 4
                    length -= 15
                    if length < 0:
                        raise ValueError("a length under the least")
                length += 15
            value = take(wide)
            distance, length = (1 << wide) + value, length + 3
            if distance > len(out):
                raise ValueError("a reference before the start")
            for _ in range(length):
                out.append(out[-distance])
    return bytes(out[:size])


def crc32c(data: bytes) -> int:
    value = 0xFFFFFFFF
    for byte in data:
        value = _CRC32C[(value ^ byte) & 255] ^ value >> 8
    return value ^ 0xFFFFFFFF


def _table(polynomial: int) -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (polynomial if n & 1 else 0)
        out.append(n)
    return out


_CRC32C = _table(0x82F63B78)


def fletcher64(data: bytes) -> int:
    """Over 32-bit words, as volume structures carry it; the first eight bytes are the sum's own place."""
    low = high = 0
    for (word,) in struct.iter_unpack("<I", data[8:]):
        low = (low + word) % 0xFFFFFFFF
        high = (high + low) % 0xFFFFFFFF
    first = 0xFFFFFFFF - (low + high) % 0xFFFFFFFF
    return (0xFFFFFFFF - (low + first) % 0xFFFFFFFF) << 32 | first
