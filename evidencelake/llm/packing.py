"""Best-fit packing of tokenised documents by bin completion.

Documents become ids of a word-level BPE and an end id; only those longer than a sequence are cut. Pieces are
dealt by a hash into groups of a bounded size, each packed by itself; the sequences that a group leaves poorly
filled are packed again in a second round over far fewer pieces. A group's search is bounded by a number of steps; where they
don't suffice to prove its packing the best, the best one found stands, never worse than best fit. Null texts are empty: one piece, the end id.
Repeated rows are packed each; pieces of one length are taken in order of doc_id and piece; very long texts are cut
into pieces as they are encoded; extra columns are not read; an empty table has no piece.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidencelake.llm.common import cut, map_rows, worker_cache

#: Sequence length, id that ends a document, pieces a group holds about, fill under which a sequence is packed again.
LIMIT, END, GROUP, FULL = 4096, 1, 4_000, 0.995
#: Steps of the search in one group, of which each looks at one filling in the making.
STEPS = 300_000
CHUNKS, WORDS = 250_000, 400_000
#: Characters for which the pieces between spaces, lower case and classes of the standard library are the tokenizer's.
_PLAIN = re.compile(r"[\n\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ÿ]*\Z")
_SPLIT = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


class Memo(dict):
    """What ``make`` gives for a text; the first ``most`` of up to 64 characters are kept."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        found = self.make(key)
        if len(self) < self.most and len(key) <= 64:
            self[key] = found
        return found


class WordTokenizer:
    """The tokenizer of a file. Plain texts go by memos of what it gives for pieces between blanks and for words,
    with the library's merges for words that are new; all other texts go through the library whole."""

    def __init__(self, spec: str):
        self.spec = spec
        self._start()

    def __getstate__(self):
        return {"spec": self.spec}

    def __setstate__(self, state):
        self.spec = state["spec"]
        self._start()

    def _start(self):
        self.full, self.chunks = worker_cache(("word tokenizer", zlib.crc32(self.spec.encode())), lambda: _load(self.spec))

    def encode(self, text: str) -> bytes:
        if not _PLAIN.match(text):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.chunks.__getitem__, text.lower().split()))


def _load(spec: str) -> tuple[Tokenizer, Memo]:
    full = Tokenizer.from_str(spec)
    full.encode_special_tokens = True
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}  # bytes that stand for themselves
    names = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in kept)}
    written = {c: "".join(names[b] for b in chr(c).encode()) for c in range(256)}
    tokenize = full.model.tokenize

    def word(text: str) -> bytes:
        ids = [token.id for token in tokenize(text.translate(written))]
        return struct.pack(f"<{len(ids)}I", *ids)

    words = Memo(word, WORDS)
    return full, Memo(lambda chunk: b"".join(map(words.__getitem__, _SPLIT.findall(chunk))), CHUNKS)


def pieces(docs: DataFrame, spec: str, limit: int = LIMIT, end_id: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document's ids, cut only where over ``limit``."""
    tokenizer = WordTokenizer(spec)
    last = np.array([end_id], "<u4").tobytes()

    def rows(source: Iterator[dict]) -> Iterator[tuple]:
        for r in source:
            ids = tokenizer.encode(unicodedata.normalize("NFC", r["text"] or "")) + last
            for piece, at in enumerate(range(0, len(ids), 4 * limit)):
                part = ids[at : at + 4 * limit]
                yield (r["doc_id"], piece, at // 4, len(part) // 4, zlib.crc32(part), *((part,) if with_ids else ()))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return map_rows(docs.select("doc_id", "text"), schema, rows)


class Spent(Exception):
    """The steps of a search are used up; the incumbent stands."""


class Completion:
    """Bin completion by branch and bound over the sequences of one group.

    A sequence is built around the largest piece left: a node of the search branches over the undominated fillings
    of the room beside it. A filling is dominated where a piece that it leaves out fits into its waste, or can take
    the place of one or two of its pieces that are together no longer: any packing with the dominated filling can then be
    turned into one with the other. The first incumbent is the whole best-fit-decreasing packing. A branch ends
    where the waste of its closed sequences leaves no way to use fewer sequences than the incumbent, and the
    search ends where the incumbent meets the lower bound.

    Passes look at ever more fillings a node and take ever more of them, those of least waste first, from one
    alone to all; a pass that left none out has proved its incumbent the best. ``steps`` bounds all passes together. The order of the search doesn't
    depend on it, so more steps never give more sequences.
    """

    def __init__(self, lengths: list[int], limit: int = LIMIT, steps: int = STEPS):
        self.limit, self.left, self.total = limit, steps, sum(lengths)
        self.items: dict[int, list[int]] = defaultdict(list)
        for i in sorted(range(len(lengths)), key=lambda i: -i):
            self.items[lengths[i]].append(i)
        self.have = {size: len(own) for size, own in self.items.items()}
        self.sizes = sorted(self.have)  # distinct lengths that are left

    def take(self, size: int, n: int = 1) -> None:
        self.have[size] -= n
        if not self.have[size]:
            del self.sizes[bisect_right(self.sizes, size) - 1]

    def give(self, size: int, n: int = 1) -> None:
        if not self.have[size]:
            insort(self.sizes, size)
        self.have[size] += n

    def best_fit(self) -> list[list[int]]:
        """Each length, from the longest, goes where it leaves the least room."""
        bins: list[list[int]] = []
        rooms: list[int] = []  # sorted, with the sequences that have them
        of: dict[int, list[int]] = defaultdict(list)
        for size in reversed(self.sizes):
            for _ in range(self.have[size]):
                at = bisect_left(rooms, size)
                if at == len(rooms):
                    room, b = self.limit, len(bins)
                    bins.append([])
                else:
                    room = rooms[at]
                    b = of[room].pop()
                    if not of[room]:
                        del rooms[at]
                bins[b].append(size)
                room -= size
                if room:
                    if not of[room]:
                        insort(rooms, room)
                    of[room].append(b)
        return bins

    def bound(self) -> int:
        """The fewest sequences by their sum, and by pieces of which no two go together with what must go beside them."""
        least = -(-self.total // self.limit)
        half = self.limit // 2
        large = [(s, self.have[s]) for s in reversed(self.sizes) if s > half]
        n_large = sum(n for _, n in large)
        for k in [0, *(s for s in self.sizes if s <= half)]:
            alone = sum(n for s, n in large if s > self.limit - k)
            room = sum((self.limit - s) * n for s, n in large if s <= self.limit - k)
            rest = sum(s * self.have[s] for s in self.sizes if k <= s <= half)
            least = max(least, n_large + max(0, -(-(rest - room) // self.limit)))
            if alone == n_large or len(self.sizes) > 400 and k:
                break
        return least

    def dominated(self, chosen: list[tuple[int, int]], room: int) -> bool:
        """Whether a piece left out fits into ``room``, or for one or two of the ``chosen`` (length, how many)."""
        used = dict(chosen)
        sizes, have = self.sizes, self.have

        def out(low: int, high: int) -> bool:
            for at in range(bisect_left(sizes, low), bisect_right(sizes, high)):
                if have[sizes[at]] > used.get(sizes[at], 0):
                    return True
            return False

        if out(0, room):
            return True
        if not room and len(chosen) > 8:
            return False
        for i, (a, n) in enumerate(chosen):
            if room and out(a + 1, a + room):
                return True
            if i < 8:
                for b, _ in chosen[i + (n < 2) : 8]:
                    if out(a + b, a + b + room):
                        return True
        return False

    def fillings(self, gap: int, waste: int, width: int, cap: int) -> tuple[list[tuple[int, list[tuple[int, int]]]], bool]:
        """At most ``width`` undominated fillings (waste, [(length, how many)]) that waste no more than ``waste``,
        the least waste first, of those that ``cap`` steps find; and whether that is all there are."""
        found: list[tuple[int, list[tuple[int, int]]]] = []
        left, whole, exact = cap, True, 0

        def search(at: int, room: int, chosen: list[tuple[int, int]]) -> bool:
            nonlocal left, whole, exact
            if self.left <= 0:
                raise Spent
            self.left -= 1
            left -= 1
            if room <= waste and not self.dominated(chosen, room):
                found.append((room, chosen))
                exact += not room
            if left <= 0 or exact >= width:
                whole = False
                return False
            at = bisect_right(self.sizes, room, 0, at)
            while at:
                at -= 1
                size = self.sizes[at]
                most = min(self.have[size], room // size)
                if not at and room - size * most > waste:
                    return True  # nothing shorter is left: too much waste whatever is taken
                for n in range(most, 0, -1):
                    if not search(at, room - n * size, [*chosen, (size, n)]):
                        return False
                at = bisect_right(self.sizes, room, 0, at)
            return True

        search(len(self.sizes), gap, [])
        found.sort(key=lambda f: (f[0], sum(n for _, n in f[1])))
        return found[:width], whole and len(found) <= width

    def deepen(self, best: list[list[int]], least: int, width: int, cap: int) -> tuple[list[list[int]], bool]:
        """The best packing of one pass, and whether it branched over all fillings."""
        whole = True
        closed: list[tuple[int, int, list[tuple[int, int]]]] = []  # waste so far, largest piece, filling
        waiting: list[tuple[int, int, list]] = []  # waste before, largest piece, fillings to try (last first)
        wasted = 0

        def undo() -> bool:
            """Back to the last sequence with a filling to try, which is then taken."""
            nonlocal wasted
            while waiting:
                before, largest, rest = waiting[-1]
                if len(closed) == len(waiting):
                    _, _, filling = closed.pop()
                    for size, n in filling:
                        self.give(size, n)
                if rest and before + rest[-1][0] <= (len(best) - 1) * self.limit - self.total:
                    room, filling = rest.pop()
                    for size, n in filling:
                        self.take(size, n)
                    wasted = before + room
                    closed.append((wasted, largest, filling))
                    return True
                waiting.pop()
                self.give(largest)
                wasted = before
            return False

        try:
            while True:
                if not self.sizes:
                    best = [[largest, *(s for s, n in filling for _ in range(n))] for _, largest, filling in closed]
                    if len(best) <= least or not undo():
                        return best, whole
                    continue
                spare = (len(best) - 1) * self.limit - self.total - wasted
                largest = self.sizes[-1]
                self.take(largest)
                options, every = self.fillings(self.limit - largest, spare, width, cap) if spare >= 0 else ([], True)
                whole &= every
                waiting.append((wasted, largest, options[::-1]))
                if not undo():
                    return best, whole
        except Spent:
            return best, False
        finally:
            for _, _, filling in closed:
                for size, n in filling:
                    self.give(size, n)
            for _, largest, _ in waiting:
                self.give(largest)

    def pack(self) -> list[list[int]]:
        """The pieces' numbers by sequence."""
        best, least = self.best_fit(), self.bound()
        width, cap, whole = 1, 25, False
        while len(best) > least and self.left > 0 and not whole:
            best, whole = self.deepen(best, least, width, cap)
            width, cap = width if cap < 400 else 4 * width, 4 * cap
        own = {size: items.copy() for size, items in self.items.items()}
        return [[own[size].pop() for size in b] for b in best]


def pack_group(frame: pd.DataFrame, limit: int, name: int) -> pd.DataFrame:
    """``bin`` (unique for the group's ``name``), ``offset`` and ``filled`` of each piece."""
    frame = frame.sort_values(["doc_id", "piece", "start", "ids_crc32"], kind="stable", na_position="first").reset_index(drop=True)
    lengths = frame["length"].astype(int).tolist()
    where, offset, filled = [0] * len(lengths), [0] * len(lengths), [0] * len(lengths)
    for b, members in enumerate(Completion(lengths, limit).pack()):
        at = 0
        for m in members:
            where[m], offset[m] = name + b, at
            at += lengths[m]
        for m in members:
            filled[m] = at
    return frame.assign(sequence_id=where, offset=offset, filled=filled)


def pack(found: DataFrame, limit: int = LIMIT, group: int = GROUP, full: float = FULL) -> DataFrame:
    """``found`` with sequence_id and offset: two rounds of groups, so that no task gets more than a few thousand
    pieces however many there are, nor depends on any key of the data."""
    total = found.count()
    columns = [c for c in found.columns if c in ("doc_id", "piece", "start", "length", "ids_crc32")]
    schema = ", ".join(f"{c} {t}" for c, t in found.select(columns).dtypes) + ", sequence_id long, offset long, filled long"

    def packed(df: DataFrame, groups: int, first: int) -> DataFrame:
        def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            return pack_group(frame, limit, (first + int(key[0])) << 32)[out]

        out = [*columns, "sequence_id", "offset", "filled"]
        dealt = df.select(*columns, F.pmod(F.xxhash64("doc_id", "piece", F.lit(first)), F.lit(groups)).cast("int").alias("g"))
        return dealt.groupBy("g").applyInPandas(one, schema)

    groups = max(1, -(-total // group))
    once = cut(packed(found, groups, 0))
    poor = once.where(F.col("filled") < full * limit)
    n_poor = poor.count()
    again = packed(poor, max(1, -(-n_poor // group)), groups)
    return once.where(F.col("filled") >= full * limit).unionByName(again).drop("filled")
