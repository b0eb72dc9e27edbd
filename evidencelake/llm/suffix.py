"""Suffix-array deduplication: every byte under a repeat of at least ``LEAST`` bytes goes, but in its first place.

1. Each window of ``LEAST`` bytes has an anchor, its least gram by hash; neighbouring windows mostly share one. A run
   of windows with one anchor is a row: hash of the gram, hash of the run's bytes, place. Equal runs collapse to a class
   (in the task that reads them, then where they meet by gram): all but the first are repeats throughout.
2. Where classes of one gram differ, their first runs' bytes are fetched. For each gram an enhanced suffix array is
   built: of the suffixes that begin where left contexts part, in order, with the lengths of their common prefixes.
   A stack scan walks the tree of common-prefix intervals, tests whether an interval's members differ to the left, and so
   gives maximal repeats with all occurrences; the first stays, the others are covered by the longest of theirs.
3. Grams with more than ``CROWD`` classes (the rim of a passage that very many documents hold) are dealt out by single
   windows instead, each to the task of its own hash: exact, and no task gets the whole group.

Matches never cross documents, and all are judged on the input. Null texts are empty. Documents are in order of doc_id;
where ids repeat or are null, in order of (id, nulls first; text), and repeated rows are separate documents of which
the first stays. Extra columns are not read; an empty table gives no row. Hashes of runs have 48 bits beside the
64 of their gram, those of windows 64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.llm.common import arrow_limits, cut, map_rows, worker_cache

LEAST, GRAM = 100, 24
SPAN = LEAST - GRAM + 1  # grams in a window of LEAST bytes
SEGMENT = 1 << 19
#: Classes of a gram up to which its suffix array is built in one task, and rows of one gram that are held at once.
CROWD, HELD = 512, 200_000
WIDE = LEAST + SPAN - 1  # bytes of a run at most
_LOW = np.uint64((1 << 20) - 1)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _power(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Anchors:
    """Finds the windows' anchors of a text; its tables have the size of a segment."""

    def __init__(self):
        n = SEGMENT + LEAST
        self.up, self.down = _power(int(_MUL), n + 1), _power(pow(int(_MUL), -1, 1 << 64), n + 1)
        self.byte = _mix(np.arange(1, 257, dtype=np.uint64) * _MUL)

    def of(self, data: np.ndarray) -> tuple[np.ndarray, ...]:
        """(gram, context, start, length) of each run of windows with one anchor.

        The anchor of a window is its least gram by hash, the leftmost of equals, so equal windows have it at the same
        place. Windows ``start`` to ``start + length - LEAST`` share an anchor whose gram has the hash ``gram``;
        ``context`` is the hash of all their bytes and of the anchor's place in them.
        """
        parts = [self._segment(data[at : at + SEGMENT + LEAST - 1], at) for at in range(0, max(1, len(data) - LEAST + 1), SEGMENT)] if len(data) >= LEAST else []
        if not parts:
            return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _segment(self, data: np.ndarray, at: int) -> tuple[np.ndarray, ...]:
        n = len(data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.byte[data] * self.up[:n], out=total[1:])
        grams = _mix((total[GRAM:] - total[:-GRAM]) * self.down[: n - GRAM + 1])
        least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        done = 1
        while 2 * done <= SPAN:
            least = np.minimum(least[:-done], least[done:])
            done *= 2
        if done < SPAN:
            least = np.minimum(least[: len(least) - (SPAN - done)], least[SPAN - done :])
        anchor = (least & _LOW).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        lengths = np.diff(np.append(starts, len(anchor))) + LEAST - 1
        anchor = anchor[starts]
        whole = (total[starts + lengths] - total[starts]) * self.down[starts]
        context = _mix(whole ^ _mix(((anchor - starts).astype(np.uint64) << np.uint64(32) | lengths.astype(np.uint64)) * _MUL))
        return grams[anchor], context, starts + at, lengths


def _anchors() -> Anchors:
    return worker_cache(("suffix anchors", SEGMENT, LEAST, GRAM), Anchors)


RUNS = "h long, c long, key long, at long"  # at: start << 8 | length - LEAST, or the complement of it where covered already


def _batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names)


def collapse(h: np.ndarray, c: np.ndarray, key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Marks all but the first of equal rows as covered, and gives those a gram of their own, so that they spread."""
    order = np.lexsort((at, key, c, h))
    same = np.zeros(len(h), bool)
    same[order[1:]] = (h[order][1:] == h[order][:-1]) & (c[order][1:] == c[order][:-1])
    h[same] = _mix((key[same].astype(np.uint64) * _MUL) ^ at[same].astype(np.uint64))
    at[same] = ~at[same]
    return same


def joined(h: np.ndarray, c: np.ndarray, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(h, key, at) of single windows: those that repeat in the batch are covered already, and neighbours among them
    become one row, so that a passage isn't a row for each of its bytes."""
    same = collapse(h, c, key, at)
    k, start = key[same], ~at[same] >> 8
    order = np.lexsort((start, k))
    k, start = k[order], start[order]
    first = np.concatenate((np.ones(min(1, len(k)), bool), (k[1:] != k[:-1]) | (start[1:] != start[:-1] + 1)))
    head = np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))
    first |= (np.arange(len(k)) - head) % 256 == 0  # as many as a row's length can say
    at_first = np.flatnonzero(first)
    count = np.diff(np.append(at_first, len(k)))
    k, span = k[at_first], ~(start[at_first] << 8 | (count - 1))
    own = _mix((k.astype(np.uint64) * _MUL) ^ span.astype(np.uint64))
    return np.concatenate((h[~same], own)), np.concatenate((key[~same], k)), np.concatenate((at[~same], span))


def runs(docs: DataFrame) -> DataFrame:
    """The runs of (key, text), those that repeat within an Arrow batch already marked."""
    arrow_limits(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = _anchors()
        for batch in batches:
            parts = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer()
                if raw is None or raw.size < LEAST:
                    continue
                gram, context, start, length = anchors.of(np.frombuffer(raw, np.uint8))
                parts.append((gram, context & np.uint64((1 << 48) - 1), np.full(len(gram), key), start << 8 | (length - LEAST)))
            if parts:
                h, c, key, at = (np.concatenate(x) for x in zip(*parts, strict=True))
                collapse(h, c, key, at)
                yield _batch([h, c, key, at], ["h", "c", "key", "at"])

    return docs.select("key", "text").mapInArrow(find, RUNS)


def meet(found: DataFrame) -> DataFrame:
    """(kind, h, key, at): 0 a covered run, 1 the first of a class among others of its gram, 2 the same in a crowd."""
    dealt = found.repartition("h").sortWithinPartitions("h", "c", "key", "at")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tuple(np.zeros(0, np.int64) for _ in range(4))
        crowd, last = None, None  # the gram that is being passed on in pieces, and its last class

        def judge(h: np.ndarray, c: np.ndarray, key: np.ndarray, at: np.ndarray, whole: bool) -> pa.RecordBatch:
            nonlocal crowd, last
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            size = np.diff(np.append(starts, len(h)))
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
            going_on = crowd is not None and crowd == h[0]
            if going_on and last == c[0]:
                new[0] = False
            classes = np.add.reduceat(new.astype(np.int64), starts)
            if going_on:
                classes[0] += CROWD
            if not whole:
                classes[-1] += CROWD
                crowd, last = h[-1], c[-1]
            many = np.repeat(classes, size)
            kind = np.where(new, np.where(many > CROWD, 2, 1), 0).astype(np.int32)
            done = at < 0
            kind[done] = 0
            out = (kind == 0) | (many > 1)
            out &= ~(new & ~done & (many <= 1))
            return pa.RecordBatch.from_arrays([pa.array(kind[out]), *(pa.array(x[out]) for x in (h, key, np.where(done, ~at, at)))], ["kind", "h", "key", "at"])

        for batch in batches:
            rows = [np.concatenate((x, batch.column(i).to_numpy(zero_copy_only=False))) for i, x in enumerate(held)]
            if not len(rows[0]):
                continue
            end = int(np.searchsorted(rows[0], rows[0][-1]))
            if end:
                yield judge(*(x[:end] for x in rows), True)
            held = tuple(x[end:] for x in rows)
            if len(held[0]) > HELD:
                yield judge(*held, False)
                held = tuple(np.zeros(0, np.int64) for _ in range(4))
        if len(held[0]):
            yield judge(*held, True)

    return dealt.mapInArrow(walk, "kind int, h long, key long, at long")


def contexts(docs: DataFrame, first: DataFrame) -> DataFrame:
    """(h, key, at, bytes) of the runs ``first`` (kinds 1 and 2); those of a crowd as windows, by their own hash and bare."""
    wanted = first.groupBy("key").agg(F.collect_list(F.struct("kind", "h", "at")).alias("runs"))
    both = docs.select("key", "text").join(wanted, "key")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = _anchors()

        def windows(data: np.ndarray, key: int, start: np.ndarray, number: np.ndarray) -> list[np.ndarray]:
            at = np.repeat(start, number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
            grid = anchors.byte[data[at[:, None] + np.arange(LEAST)]] * anchors.up[:LEAST]
            h = _mix(grid.sum(axis=1, dtype=np.uint64))
            return [h, h.copy(), np.full(len(at), key), at << 8]

        for batch in batches:
            bare: list[list[np.ndarray]] = []
            out: tuple[list, ...] = ([], [], [], [])
            for key, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw = text.as_buffer()
                data = np.frombuffer(raw, np.uint8)
                kind, h, at = (own.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                crowd = kind == 2
                if crowd.any():
                    for some in np.array_split(np.flatnonzero(crowd), 1 + int(crowd.sum()) // 500):
                        bare.append(windows(data, key, at[some] >> 8, (at[some] & 255) + 1))
                view = memoryview(raw)
                for gram, place in zip(h[~crowd].tolist(), at[~crowd].tolist(), strict=True):
                    start = place >> 8
                    for column, value in zip(out, (gram, key, place, bytes(view[start : start + LEAST + (place & 255)])), strict=True):
                        column.append(value)
            if bare:
                w, k, p = joined(*(np.concatenate(x) for x in zip(*bare, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(k), pa.array(p), pa.nulls(len(w), pa.binary())], ["h", "key", "at", "bytes"])
            if out[0]:
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary())], ["h", "key", "at", "bytes"])

    return both.select("key", "text", "runs").mapInArrow(fetch, "h long, key long, at long, bytes binary")


def suffix_array(group: np.ndarray, text: np.ndarray, size: np.ndarray, gram_at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(run, depth, prefix, before): the suffixes in order, the bytes each shares with the one before it, if at
    least ``LEAST``, else 0, and the byte to the left (-1: none).

    Runs of one ``group`` (rows together) are lined up at their anchors, ``gram_at`` bytes from the start of each row of
    ``text``. Suffixes begin ``depth`` bytes before the anchor, at the depths at which some run begins or two
    neighbours in the order of left contexts part: only there can an interval be diverse to the left.
    """
    n = len(group)
    place = gram_at[:, None] - 1 - np.arange(SPAN - 1)[None, :]
    left = np.where(place >= 0, np.take_along_axis(text, np.maximum(place, 0), axis=1), 0)
    there = place >= 0
    named = np.concatenate((group.astype(">u4").view(np.uint8).reshape(n, 4), left), axis=1)
    order = np.argsort(np.ascontiguousarray(named).view(f"S{named.shape[1]}").ravel(), kind="stable")
    a, b = order[:-1], order[1:]
    parted = ~((left[a] == left[b]) & there[a] & there[b])
    depth = np.where(parted.any(axis=1), parted.argmax(axis=1), SPAN - 1)
    chosen = np.zeros((int(group.max()) + 1, SPAN), bool)
    same = group[a] == group[b]
    chosen[group[a][same], depth[same]] = True
    chosen[group, gram_at] = True
    depths = np.arange(SPAN)
    run, depth = np.nonzero(chosen[group] & (depths <= gram_at[:, None]) & (depths >= (gram_at - (size - LEAST))[:, None]))
    begin = gram_at[run] - depth
    span = np.minimum(begin[:, None] + np.arange(WIDE)[None, :], WIDE - 1)
    length = size[run] - begin
    body = np.take_along_axis(text[run], span, axis=1) * (np.arange(WIDE)[None, :] < length[:, None])
    named = np.concatenate((group[run].astype(">u4").view(np.uint8).reshape(-1, 4), (depth + 1).astype(np.uint8)[:, None], body), axis=1)
    order = np.argsort(np.ascontiguousarray(named).view(f"S{named.shape[1]}").ravel(), kind="stable")
    run, depth, begin, length, body = (x[order] for x in (run, depth, begin, length, body))
    other = body[1:] != body[:-1]
    shared = np.where(other.any(axis=1), other.argmax(axis=1), WIDE)
    shared = np.minimum(shared, np.minimum(length[1:], length[:-1]))
    shared[(group[run][1:] != group[run][:-1]) | (depth[1:] != depth[:-1]) | (shared < LEAST)] = 0
    before = np.where(begin > 0, text[run, np.maximum(begin - 1, 0)].astype(np.int64), -1)
    return run, depth, np.concatenate(([0], shared)), before


def intervals(prefix: list[int], before: list[int]) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the maximal repeats: a stack scan gives the common-prefix intervals, children before
    parents; one is a maximal repeat if its members differ in the byte to the left (or one has none)."""
    stack: list[list[int]] = []  # length, first, byte to the left (-1 none, -2 diverse)
    join = lambda x, y: x if x == y and x >= 0 else -2
    for i in range(1, len(prefix) + 1):
        now = prefix[i] if i < len(prefix) else 0
        first, left = i - 1, before[i - 1]
        while stack and stack[-1][0] > now:
            length, first, own = stack.pop()
            left = join(own, left)
            if left == -2:
                yield length, first, i - 1
        if now:
            if stack and stack[-1][0] == now:
                stack[-1][2] = join(stack[-1][2], left)
            else:
                stack.append([now, first, left])


def maximal_repeats(group: np.ndarray, text: np.ndarray, size: np.ndarray, gram_at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, runs, depths) of each maximal repeat with all its occurrences among the runs."""
    run, depth, prefix, before = suffix_array(group, text, size, gram_at)
    edge = np.flatnonzero(prefix == 0)
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(prefix)], strict=True):
        if b - a > 1:
            for length, first, last in intervals(prefix[a:b].tolist(), before[a:b].tolist()):
                yield length, run[a + first : a + last + 1], depth[a + first : a + last + 1]


def covers(bare: DataFrame) -> DataFrame:
    """(key, start, length) of what repeats an earlier place, from ``contexts``."""
    dealt = bare.repartition("h").sortWithinPartitions("h", "key", "at")

    def judge(h: np.ndarray, key: np.ndarray, at: np.ndarray, raw: list[bytes | None]) -> tuple[list, list, list]:
        out: tuple[list, list, list] = ([], [], [])
        first = np.concatenate(([True], h[1:] != h[:-1]))
        window = np.array([x is None for x in raw])
        late = window & (~first | (at < 0))
        place = np.where(at < 0, ~at, at)
        for column, values in zip(out, (key[late], place[late] >> 8, (place[late] & 255) + LEAST), strict=True):
            column += values.tolist()
        rest = np.flatnonzero(~window)
        if len(rest):
            group = np.cumsum(first)[rest]
            text = np.frombuffer(b"".join(raw[i].ljust(WIDE, b"\0") for i in rest), np.uint8).reshape(-1, WIDE)
            size = (at[rest] & 255) + LEAST
            key, start, gram_at = key[rest], at[rest] >> 8, _gram_place(text, size)
            best: dict[tuple[int, int], int] = {}
            for length, runs_, depths in maximal_repeats(group - group[0], text, size, gram_at):
                begin = start[runs_] + gram_at[runs_] - depths
                stays = np.lexsort((begin, key[runs_]))[0]
                for j, (k, s) in enumerate(zip(key[runs_].tolist(), begin.tolist(), strict=True)):
                    if j != stays and best.get((k, s), 0) < length:
                        best[k, s] = length
            for (k, s), length in best.items():
                for column, value in zip(out, (k, s, length), strict=True):
                    column.append(value)
        return out

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [np.zeros(0, np.int64)] * 3 + [[]]

        def given(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in judge(*rows)], ["key", "start", "length"])

        for batch in batches:
            rows = [np.concatenate((held[i], batch.column(i).to_numpy(zero_copy_only=False))) for i in range(3)] + [held[3] + batch.column(3).to_pylist()]
            if not len(rows[0]):
                continue
            end = int(np.searchsorted(rows[0], rows[0][-1]))
            held = [x[end:] for x in rows]
            if end:
                yield given([x[:end] for x in rows])
            elif held[3][0] is None and len(held[3]) > HELD:  # one window's rows: the first of them is all that must be kept
                yield given(held)
                held = [x[:1] for x in held]
        if len(held[0]):
            yield given(held)

    return dealt.mapInArrow(walk, "key long, start long, length long")


def _gram_place(text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where the anchor of each run begins: the least gram of its first window."""
    anchors = _anchors()
    part = np.zeros((len(text), LEAST + 1), np.uint64)
    np.cumsum(anchors.byte[text[:, :LEAST]] * anchors.up[:LEAST], axis=1, out=part[:, 1:])
    grams = _mix((part[:, GRAM:] - part[:, :-GRAM]) * anchors.down[:SPAN])
    return (((grams & ~_LOW) | np.arange(SPAN, dtype=np.uint64)).min(axis=1) & _LOW).astype(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``key``, a long that orders documents and differs between any two: doc_id where that does."""
    own = docs.withColumn("text", F.coalesce("text", F.lit("")))
    rows, ids = own.agg(F.count("*"), F.count("doc_id")).first()
    if rows == ids and own.groupBy("doc_id").count().where("count > 1").isEmpty():
        return own.withColumn("key", F.col("doc_id").cast("long"))
    return cut(own.orderBy(F.col("doc_id").asc_nulls_first(), "text").withColumn("key", F.monotonically_increasing_id()))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint (start, end) of (start, length) pairs; what touches is one."""
    out: list[list[int]] = []
    for start, length in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + length)
        else:
            out.append([start, start + length])
    return [(a, b) for a, b in out]


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(key, spans) of the documents of ``keyed`` that hold repeats: (start, length) in bytes, not yet merged."""
    met = cut(meet(runs(docs)))
    again = covers(contexts(docs, met.where("kind > 0")))
    whole = met.where("kind = 0").select("key", F.shiftright("at", 8).alias("start"), (F.col("at").bitwiseAND(255) + LEAST).alias("length"))
    return whole.unionByName(again).groupBy("key").agg(F.collect_list(F.struct("start", "length")).alias("spans"))


def deduplicate(docs: DataFrame, columns: str, keep: list[str], outcome) -> DataFrame:
    """``outcome(row, kept bytes, spans)`` of each document, typed by ``columns``."""
    own = keyed(docs)
    both = own.select("key", "text", *[c for c in keep if c not in ("key", "text")]).join(repeated_spans(own), "key", "left")

    def rows(source: Iterator[dict]) -> Iterator[tuple]:
        for r in source:
            raw = r["text"].encode()
            spans = merged([(s["start"], s["length"]) for s in r["spans"] or ()])
            ends = [0, *(x for span in spans for x in span), len(raw)]
            yield outcome(r, b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)), spans)

    return map_rows(both, columns, rows)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of ``docs``."""

    def outcome(r: dict, kept: bytes, spans: list) -> tuple:
        removed = sum(b - a for a, b in spans)
        return (r["doc_id"], len(kept) + removed, removed, len(spans), hashlib.sha256(kept).hexdigest())

    return deduplicate(docs, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", ["doc_id"], outcome)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeats cut out of ``text``, shrunk to whole characters; ``n_chars``, where there is one, is counted anew."""
    own = keyed(docs)
    spans = repeated_spans(own)

    def edit(source: Iterator[dict]) -> Iterator[tuple]:
        for r in source:
            raw = r["text"].encode()
            ends = [0]
            for a, b in merged([(s["start"], s["length"]) for s in r["spans"]]):
                while a < b and raw[a] & 0xC0 == 0x80:
                    a += 1
                while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                    b -= 1
                ends += [a, b]
            ends.append(len(raw))
            yield (r["key"], b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)).decode())

    cleaned = map_rows(own.select("key", "text").join(spans, "key"), "key long, cleaned string", edit)
    out = own.join(cleaned, "key", "left").withColumn("text", F.coalesce("cleaned", "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("cleaned").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
