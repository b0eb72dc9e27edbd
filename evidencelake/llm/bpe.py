"""Byte-level BPE encoding and decoding in two tiers.

A minimal perfect hash resolves pre-tokens that are whole vocabulary entries; every other pre-token is merged by
a heap over linked bytes. Null texts are empty: no ids, the digests of nothing. Repeated rows give repeated
results; extra columns are not read. Ids are little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame

from evidencelake.llm.common import map_rows, worker_cache

#: Entries of the two memos of a worker; a full one takes no more.
CHUNKS, WORDS = 300_000, 400_000
#: Where the standard library's classes and those of the pattern agree: no other numerals, no separators of old.
_PLAIN = re.compile(r"[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]*\Z")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file) if token}


class PerfectHash:
    """Minimal perfect hash by displacement: ``n`` keys in ``n`` slots, two keys a bucket on average.

    Large buckets go first; each takes the first displacement that puts its keys into free slots. The last,
    single-key buckets name their slot directly, as a negative displacement.
    """

    def __init__(self, keys: list[bytes]):
        n = max(1, len(keys))
        self.n, self.buckets = n, max(1, n // 2)
        self.slots: list[bytes | None] = [None] * n
        self.shift = [0] * self.buckets
        members: dict[int, list[tuple[int, int, bytes]]] = {}
        for key in keys:
            h = xxhash.xxh3_128_intdigest(key)
            members.setdefault(h % self.buckets, []).append(((h >> 24) & 0xFFFFFFFF, (h >> 64) | 1, key))
        free = n - 1
        for bucket in sorted(members, key=lambda b: (-len(members[b]), b)):
            own = members[bucket]
            if len(own) == 1:
                while self.slots[free] is not None:
                    free -= 1
                self.slots[free], self.shift[bucket] = own[0][2], -free - 1
                continue
            d = 0
            while True:
                at = [(a + d * b) % n for a, b, _ in own]
                if len(set(at)) == len(at) and all(self.slots[x] is None for x in at):
                    break
                d += 1
            self.shift[bucket] = d
            for x, (_, _, key) in zip(at, own, strict=True):
                self.slots[x] = key

    def slot(self, key: bytes) -> int:
        """The key's slot, or -1 for a stranger."""
        h = xxhash.xxh3_128_intdigest(key)
        d = self.shift[h % self.buckets]
        at = -d - 1 if d < 0 else (((h >> 24) & 0xFFFFFFFF) + d * ((h >> 64) | 1)) % self.n
        return at if self.slots[at] == key else -1


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE of one pre-token: the lowest rank first, the leftmost of equals, by a heap over a linked list of parts."""
    n = len(word)
    if n < 2:
        return [ranks[word]] if n else []
    none = 1 << 30
    get, push, pop = ranks.get, heapq.heappush, heapq.heappop
    bits = n.bit_length()
    low = (1 << bits) - 1
    pair = [get(word[i : i + 2], none) for i in range(n - 1)]  # rank of the part that begins here with the next
    pair.append(none)
    end = list(range(1, n + 1))  # of the part that begins here
    back = list(range(-1, n))  # beginning of the part before
    heap = [r << bits | i for i, r in enumerate(pair) if r < none]
    heapq.heapify(heap)
    while heap:
        key = pop(heap)
        i = key & low
        if pair[i] != key >> bits:
            continue  # its parts have been merged otherwise
        j = end[i]
        stop = end[i] = end[j]
        pair[j] = none
        if stop < n:
            back[stop] = i
            r = pair[i] = get(word[i : end[stop]], none)
            if r < none:
                push(heap, r << bits | i)
        else:
            pair[i] = none
        if (b := back[i]) >= 0:
            r = pair[b] = get(word[b:stop], none)
            if r < none:
                push(heap, r << bits | b)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder of one vocabulary; built once on the driver and shipped: its size is the vocabulary's."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.key = (pattern, hashlib.sha256(b"".join(b"%d %d " % (len(k), i) + k for k, i in sorted(ranks.items()))).hexdigest())
        self.hash = PerfectHash(sorted(ranks))
        self.ids = [ranks.get(k, 0) if k is not None else 0 for k in self.hash.slots]
        self.tokens = {i: k for k, i in ranks.items()}
        self._start()

    def _start(self) -> None:
        self._words: dict[str, bytes] = worker_cache(("bpe words", self.key), dict)
        self._exact = regex.compile(self.pattern)
        self._fast = re.compile(self.pattern.replace(r"\p{L}\p{N}", r"\w").replace(r"[^\s\w]+", r"(?:[^\s\w]|_)+").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d"))
        self._chunks = worker_cache(("bpe chunks", self.key), _Chunks)
        self._chunks.codec = self

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def word(self, word: str) -> bytes:
        """Ids of one pre-token."""
        found = self._words.get(word)
        if found is None:
            raw = word.encode("utf-8", "surrogatepass")
            slot = self.hash.slot(raw)
            ids = [self.ids[slot]] if slot >= 0 else merge(raw, self.ranks)
            found = np.array(ids, "<u4").tobytes()
            if len(word) <= 64:
                if len(self._words) < WORDS:
                    self._words[word] = found
        return found

    def split(self, text: str) -> list[str]:
        return (self._fast if _PLAIN.match(text) else self._exact).findall(text)

    def encode(self, text: str) -> bytes:
        """Without runs of spaces no pre-token crosses a space, other than that it begins with: the text is then
        encoded by the pieces between spaces, most of which the memo holds."""
        if "  " in text:
            return b"".join(map(self.word, self.split(text)))
        first, *rest = text.split(" ")
        return b"".join((*map(self.word, self.split(first)), *map(self._chunks.__getitem__, rest)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Chunks(dict):
    codec: Codec

    def __missing__(self, chunk: str) -> bytes:
        value = b"".join(map(self.codec.word, self.codec.split(" " + chunk)))
        if len(chunk) <= 64:
            if len(self) < CHUNKS:
                self[chunk] = value
        return value


def encode_documents(docs: DataFrame, codec: Codec, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of each row of ``docs``: encoded, then decoded
    from the ids alone."""

    def rows(source: Iterator[dict]) -> Iterator[tuple]:
        for r in source:
            ids = codec.encode(r["text"] or "")
            decoded = codec.decode(ids)
            yield (r["doc_id"], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), *((ids, decoded) if with_ids else ()))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded binary" * with_ids
    return map_rows(docs.select("doc_id", "text"), schema, rows)
