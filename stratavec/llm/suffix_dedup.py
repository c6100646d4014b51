"""Exact removal of repeated substrings by blockwise suffix sorting with a difference cover.

Every string of `length` bytes (a window) has an anchor, the least-hashed gram of GRAM bytes in it, so equal windows
have equal anchors at equal places, and suffixes are sorted in buckets of one anchor. Consecutive windows with the same
anchor are a run; its context is the bytes from its first window's start to its last one's end.

1. A task compares its own runs before anything is shuffled: of those whose contexts are equal, byte by byte, the earliest
   stays, and the bytes of the others go, as all of their windows start earlier. So a passage shared by any number of
   documents sends a run per task and not per document. The runs that stay are sent by anchor, without their bytes; those
   whose anchor no other has can't be repeated and are done.
2. The contexts of all others are fetched and their suffixes sorted, bucket after bucket. A bucket is narrowed first: windows
   that reach far to the left of the anchor hold the same bytes there, the others to its right, and only suffixes of
   contexts that agree on these are sorted together. Contexts that are equal as a whole, byte by byte, are one suffix of
   the bucket, of which the earliest stays. The others' windows are sorted: by their first PERIOD bytes, longer ties by
   ranks of sample suffixes, whose offsets are a difference cover modulo PERIOD; the ranks come from doubling. Neighbours in
   suffix order that agree on `length` bytes are equal windows.

Hashes only choose what is compared: no byte goes whose window wasn't compared with an earlier one byte by byte. Memory is
bounded by the bucket size, whose number follows the bytes of all texts. Positions are in UTF-8 bytes.

Null texts count as empty and lose nothing, as do texts shorter than `length`; long texts are taken in overlapping parts.
Ids are taken as longs, a null one as larger than all others. Rows that share a doc_id are one document for "earlier":
identical ones don't remove each other. No rows give no rows. `removed` reads doc_id and text only; `shortened` returns all
columns, whatever their names."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

LENGTH, GRAM, PERIOD = 100, 32, 32
#: Bytes hashed at once, at most 2 ** POSITION_BITS; longer texts are taken in overlapping parts.
SEGMENT, POSITION_BITS = 1 << 18, 20
#: Runs that a task gathers before it sends them, and runs in a bucket on average.
LOT, BUCKET_RUNS = 300_000, 300_000
#: Runs whose contexts are cut at once, and halves of contexts that a task gathers before it sends them.
CUT_RUNS, CUT_LOT = 4096, 30_000
NO_ID = (1 << 63) - 1
#: A run as it is sent, and as a task compares it: with the hash of its context, and where its bytes are.
SENT = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("lo", "<i4"), ("more", "<u2"), ("rel", "<u2")])
RUN = np.dtype([*SENT.descr, ("ctx", "<u8"), ("part", "<i4"), ("at", "<i4")])
SPAN = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("start", "<i4"), ("stop", "<i4")])


@functools.cache
def _constants():
    """Two random values for each byte, odd multipliers for doubling, powers of a base and of its inverse."""
    rng = np.random.default_rng(8)
    table = rng.integers(0, 1 << 64, (2, 256), np.uint64)
    odd = rng.integers(0, 1 << 64, 8, np.uint64) | np.uint64(1)
    base = int(odd[7])
    def raised(number: int) -> np.ndarray:
        factors = np.full(SEGMENT + 2, number, np.uint64)
        factors[0] = 1
        return np.cumprod(factors)

    powers, inverse = raised(base), raised(pow(base, -1, 1 << 64))
    return table, odd, powers, inverse


@functools.cache
def cover(period: int) -> tuple[int, ...]:
    """A difference cover: every remainder is a difference of two of its members. Greedy: each next member is the one
    that adds most differences."""
    found, have = [0], {0}
    while len(have) < period:
        best = max(range(1, period), key=lambda c: len({(c - f) % period for f in found} | {(f - c) % period for f in found} | have))
        found.append(best)
        have |= {(best - f) % period for f in found} | {(f - best) % period for f in found}
    return tuple(sorted(found))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def runs(data: bytes, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Over texts joined in data, at most SEGMENT bytes, that end at ends: (text, start in data, windows - 1, anchor's
    place from the start, anchor, context hash) of each run."""
    table, odd, powers, inverse = _constants()
    b = np.frombuffer(data, np.uint8)
    n = len(b) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    h, size = table[0][b], 1
    while size < GRAM:
        h = h[:-size] * odd[size.bit_length()] + h[size:]
        size *= 2
    low = np.uint64((1 << POSITION_BITS) - 1)
    least = (_mix(h) & ~low) | np.arange(len(h), dtype=np.uint64)
    window, size = length - GRAM + 1, 1
    while size * 2 <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < window:
        least = np.minimum(least[: n], least[window - size : window - size + n])
    text = np.searchsorted(ends, np.arange(n), "right")
    valid = np.arange(n) + length <= ends[text]
    at = np.where(valid, (least & low).astype(np.int64), -1)
    first = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]) | (text[1:] != text[:-1])) + 1])
    last = np.concatenate([first[1:], [n]]) - 1
    real = at[first] >= 0
    first, last = first[real], last[real]
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(table[1][b] * powers[: len(b)], out=sums[1:])
    more, rel = last - first, at[first] - first
    ctx = _mix((sums[last + length] - sums[first]) * inverse[first] + (more * 1024 + rel).astype(np.uint64) * odd[0])
    return text[first], first, more, rel, least[first] & ~low, ctx


def _segments(texts: list[bytes], length: int):
    """(texts' numbers, their offsets in themselves, joined bytes, ends); only texts of at least length bytes."""
    own, offsets, parts, size = [], [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 0), SEGMENT - length + 1):
            part = text[at : at + SEGMENT]
            if size + len(part) > SEGMENT:
                yield own, offsets, b"".join(parts), np.cumsum([len(p) for p in parts])
                own, offsets, parts, size = [], [], [], 0
            own.append(k)
            offsets.append(at)
            parts.append(part)
            size += len(part)
    if parts:
        yield own, offsets, b"".join(parts), np.cumsum([len(p) for p in parts])


def _split(found: np.ndarray, parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs that stay, and those whose bytes go as an earlier run has the same context. Hashes bring runs together, their
    bytes are compared. Runs at the same place of the same document's rows don't remove each other."""
    order = np.lexsort((found["lo"], found["doc"], found["ctx"], found["anchor"]))
    new = np.ones(len(found), bool)
    new[1:] = (found["anchor"][order[1:]] != found["anchor"][order[:-1]]) | (found["ctx"][order[1:]] != found["ctx"][order[:-1]])
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(found)), 0))]
    again = (found["doc"][order] != found["doc"][first]) | (found["lo"][order] != found["lo"][first])
    order, first = order[again], first[again]
    gone = np.zeros(len(found), bool)
    for at in range(0, len(order), 50_000):
        run, head = found[order[at : at + 50_000]], found[first[at : at + 50_000]]
        size = run["more"].astype(np.int64) + length
        sides = [x.tolist() for side in (run, head) for x in (side["part"], side["at"], side["at"] + size)]
        gone[order[at : at + 50_000]] = [parts[p][a:b] == parts[q][c:d] for p, a, b, q, c, d in zip(*sides, strict=True)]
    return found[~gone], found[gone]


def _spans(gone: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(gone), SPAN)
    for name in ("doc", "tag"):
        out[name] = gone[name]
    out["start"], out["stop"] = gone["lo"], gone["lo"] + gone["more"].astype(np.int32) + length
    return _merged(out)


def _merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping and touching spans of one row as one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["tag"], spans["doc"]))]
    row = np.ones(len(spans), bool)
    row[1:] = (spans["doc"][1:] != spans["doc"][:-1]) | (spans["tag"][1:] != spans["tag"][:-1])
    number = np.cumsum(row)
    reach = np.maximum.accumulate(spans["stop"] + number * (1 << 32))  # rows one after the other on one line
    start = spans["start"] + number * (1 << 32)
    new = np.ones(len(spans), bool)
    new[1:] = start[1:] > reach[:-1]
    head = np.flatnonzero(new)
    out = spans[head].copy()
    out["stop"] = reach[np.concatenate([head[1:], [len(spans)]]) - 1] - number[head] * (1 << 32)
    return out


def _bucketed(rows: np.ndarray, key: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    bucket = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    own, first = np.unique(bucket, return_index=True)
    return [(int(k), rows[a:b].tobytes()) for k, a, b in zip(own, first, [*first[1:], len(rows)], strict=True)]


def _first_pass(docs: DataFrame, buckets: int, length: int) -> DataFrame:
    """(bucket, runs, spans): the runs that stay in their task, by anchor, and spans that go already."""

    def scan(batches):
        tokens.alone()
        waiting: list[np.ndarray] = []
        parts: list[bytes] = []
        sent = 0

        def send():
            nonlocal sent
            stay, gone = _split(np.concatenate(waiting), parts, length)
            waiting.clear()
            parts.clear()
            rows = [(k, data, b"") for k, data in _bucketed(np.array(stay[list(SENT.names)], SENT), stay["anchor"], buckets)]
            sent += 1
            spans = _spans(gone, length)
            rows += [((int(spans["doc"][a]) + a + sent) % buckets, b"", spans[a : a + 50_000].tobytes()) for a in range(0, len(spans), 50_000)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "runs", "spans"])

        for batch in batches:
            doc, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for own, offsets, data, ends in _segments(common.byte_texts(batch.column(2)), length):
                text, first, more, rel, anchor, ctx = runs(data, ends, length)
                out = np.zeros(len(text), RUN)
                which = np.array(own)[text]
                out["doc"], out["tag"], out["anchor"], out["ctx"] = doc[which], tag[which], anchor, ctx
                out["part"], out["at"] = len(parts), first
                parts.append(data)
                out["lo"] = first - np.concatenate([[0], ends[:-1]])[text] + np.array(offsets)[text]
                out["more"], out["rel"] = more, rel
                waiting.append(out)
                if sum(map(len, waiting)) >= LOT:
                    yield send()
        if waiting:
            yield send()
        common.settle()

    return docs.select("doc", "tag", "text").mapInArrow(scan, "bucket int, runs binary, spans binary")


def _second_pass(packed: DataFrame, length: int) -> DataFrame:
    """(doc, tag, start, stop, anchor, rel): spans that go, anchor null; runs that share an anchor with other ones."""

    def compare(table: pa.Table) -> pa.Table:
        stay = np.frombuffer(b"".join(table.column("runs").to_pylist()), SENT)
        spans = _merged(np.frombuffer(b"".join(table.column("spans").to_pylist()), SPAN))
        _, back, count = np.unique(stay["anchor"], return_inverse=True, return_counts=True)
        open_ = stay[count[back] > 1]
        stop = open_["lo"] + open_["more"].astype(np.int32) + length
        columns = [np.concatenate([spans[a], b]) for a, b in (("doc", open_["doc"]), ("tag", open_["tag"]), ("start", open_["lo"]), ("stop", stop))]
        none = np.concatenate([np.ones(len(spans), bool), np.zeros(len(open_), bool)])
        anchor = np.concatenate([np.zeros(len(spans), np.int64), open_["anchor"].view(np.int64)])
        rel = np.concatenate([np.zeros(len(spans), np.int32), open_["rel"].astype(np.int32)])
        return pa.table([*[pa.array(c) for c in columns], pa.array(anchor, mask=none), pa.array(rel, mask=none)], ["doc", "tag", "start", "stop", "anchor", "rel"])

    return packed.groupBy("bucket").applyInArrow(compare, "doc long, tag long, start int, stop int, anchor long, rel int")


def _context_type(length: int) -> np.dtype:
    """A context in two halves of windows: those with their anchor far from the start, and the others. room is a whole
    number of periods, so that equal offsets have equal remainders, and leaves sample suffixes beyond the end."""
    windows = length - GRAM + 1
    room = -(-(windows // 2 + 1 + length) // PERIOD) * PERIOD
    return np.dtype([("key", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("start", "<i4"), ("shift", "<i4"), ("windows", "<i4"), ("bytes", "u1", (room,))])


def contexts(text: bytes, doc: int, tag: int, start: np.ndarray, stop: np.ndarray, anchor: np.ndarray, rel: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Halves of the contexts of a text's runs. In its half, a context is placed so that its anchor has the same offset
    in all of them; shift is the place of the first window. key is a hash of anchor and of the bytes common to all
    windows that the half can have."""
    kind, windows = _context_type(length), length - GRAM + 1
    half = windows // 2  # windows whose anchor is up to half from the start, and those where it is farther
    room = kind["bytes"].shape[0]
    place, last = start.astype(np.int64) + rel, stop.astype(np.int64) - length
    margin = room + length
    padded = np.concatenate([np.zeros(margin, np.uint8), np.frombuffer(text, np.uint8), np.zeros(margin, np.uint8)])
    out = []
    lots = [slice(at, at + CUT_RUNS) for at in range(0, len(place), CUT_RUNS)]
    for lot, far in ((lot, far) for lot in lots for far in (0, 1)):
        p = place[lot]
        least, most, begin = (p - windows + 1, p - half - 1, p - half - 1) if far else (p - half, p, p)
        origin, end = least, least + length
        a, b = np.maximum(start[lot], least), np.minimum(last[lot], most)
        some = np.flatnonzero(a <= b)
        a, b, origin, begin, end = a[some], b[some], origin[some], begin[some], end[some]
        rows = np.zeros(len(some), kind)
        rows["doc"], rows["tag"], rows["start"], rows["shift"], rows["windows"] = doc, tag, a, a - origin, b - a + 1
        at = origin[:, None] + np.arange(room)
        rows["bytes"] = np.where((at >= a[:, None]) & (at < b[:, None] + length), padded[at + margin], 0)
        size = int(end[0] - begin[0]) if len(some) else 0
        same = np.zeros((len(some), -(-size // 8) * 8), np.uint8)
        same[:, :size] = padded[begin[:, None] + np.arange(size) + margin]
        key = anchor[lot][some].view(np.uint64) + np.uint64(far)
        for word in np.ascontiguousarray(same).view("<u8").T:
            key = _mix((key ^ word) * np.uint64(0x9FB21C651E98DF25))
        rows["key"] = key
        out.append(rows)
    return np.concatenate(out) if out else np.zeros(0, kind)


def _whole(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts that stay, sorted by key, and those that go as an earlier one of their key is the same, byte by byte."""
    h = rows["key"].copy()
    for word in np.ascontiguousarray(rows["bytes"]).view("<u8").T:
        h = _mix((h ^ word) * np.uint64(0x9FB21C651E98DF25))
    rows = rows[np.lexsort((rows["start"], rows["doc"], rows["windows"], rows["shift"], h, rows["key"]))]
    new = np.ones(len(rows), bool)
    for name in ("key", "shift", "windows"):
        new[1:] &= rows[name][1:] == rows[name][:-1]
    new[1:] = ~(new[1:] & (rows["bytes"][1:] == rows["bytes"][:-1]).all(1))
    head = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
    gone = (rows["doc"] != head["doc"]) | (rows["start"] != head["start"])
    return rows[~gone], rows[gone]


def _words(block: np.ndarray, at: np.ndarray, count: int) -> list[np.ndarray]:
    """Big-endian words of eight bytes from each place."""
    padded = np.concatenate([block, np.zeros(8 * count, np.uint8)])
    word = np.zeros(len(block), np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | padded[k : k + len(block)]
    word = np.concatenate([word, np.zeros(8 * count, np.uint64)])
    return [word[at + 8 * k] for k in range(count)]


def _dense(keys: list[np.ndarray]) -> np.ndarray:
    """Ranks from 1 of rows by several keys, the first most significant; equal rows share one."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    if len(order):
        new[0] = 1
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def cover_ranks(block: np.ndarray, room: int, length: int) -> np.ndarray:
    """For texts of room bytes, one after the other: ranks of the sample suffixes by their first bytes, at least length
    of them or up to the text's end, by doubling; 0 elsewhere. A sample place plus PERIOD is a sample place."""
    inside = np.isin(np.arange(room) % PERIOD, cover(PERIOD))
    at = np.flatnonzero(np.tile(inside, len(block) // room))
    rank = np.zeros(len(block) + 8 * PERIOD, np.int64)
    rank[at] = _dense(_words(block, at, PERIOD // 8))
    reach = PERIOD
    while reach < length:
        beyond = np.where(at % room + reach < room, rank[at + reach], 0)
        rank[at] = _dense([rank[at], beyond])
        reach *= 2
    return rank[: len(block)]


def equal_windows(rows: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Spans that go, of contexts sorted by key: windows that start earlier in another context of the same key."""
    room = rows["bytes"].shape[1]
    rows, gone = _whole(rows)
    whole = np.zeros(len(gone), SPAN)
    for name in ("doc", "tag", "start"):
        whole[name] = gone[name]
    whole["stop"] = gone["start"] + gone["windows"] - 1 + length
    group = np.cumsum(np.concatenate([[0], rows["key"][1:] != rows["key"][:-1]]))
    many = np.bincount(group)[group] > 1
    rows, group = rows[many], group[many]
    if not len(rows):
        return _merged(whole)
    block = np.ascontiguousarray(rows["bytes"]).reshape(-1)
    rank = cover_ranks(block, room, length)
    row = np.repeat(np.arange(len(rows)), rows["windows"])
    step = np.arange(len(row)) - np.repeat(np.cumsum(rows["windows"]) - rows["windows"], rows["windows"])
    offset = rows["shift"][row] + step
    at = row * room + offset
    # Suffixes of one bucket have one offset, so one shift leads from all of them to sample suffixes.
    members = np.array(cover(PERIOD))
    lead = np.array([min((members - o) % PERIOD) for o in range(PERIOD)])[offset % PERIOD]
    beyond = np.where(offset + lead < room, rank[np.minimum(at + lead, len(block) - 1)], 0)
    keys = [group[row], offset, *_words(block, at, PERIOD // 8), beyond]
    order = np.lexsort(keys[::-1])
    same = np.ones(len(order), bool)
    same[0] = False
    for k in keys[:2]:
        same[1:] &= k[order][1:] == k[order][:-1]
    close = np.flatnonzero(same)
    for w in range(-(-length // 8)):
        here = _words(block, np.minimum(at + 8 * w, len(block)), 1)[0]
        if 8 * (w + 1) > length:
            here = here >> np.uint64(8 * (8 * (w + 1) - length))
        agree = here[order[close]] == here[order[close - 1]]
        same[close[~agree]] = False
        close = close[agree]
    run = np.cumsum(~same)
    doc, start = rows["doc"][row][order], (rows["start"][row] + step)[order]
    first = np.lexsort((start, doc, run))
    head = first[np.searchsorted(run[first], run, "left")]
    gone = order[(doc != doc[head]) | (start != start[head])]
    out = np.zeros(len(gone), SPAN)
    out["doc"], out["tag"] = rows["doc"][row[gone]], rows["tag"][row[gone]]
    out["start"] = rows["start"][row[gone]] + step[gone]
    out["stop"] = out["start"] + length
    return _merged(np.concatenate([whole, out]))


def _packed(data: bytes) -> bytes:
    """Contexts overlap and are padded, so they take far less compressed; the length goes before."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _by_row(found: DataFrame, fields: list[str]) -> DataFrame:
    """One list for each row of the documents; it is no longer than the text."""
    return found.groupBy("doc", "tag").agg(F.collect_list(F.struct(*fields)).alias("found"))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, tag, start, stop): the bytes that go, for documents (doc, tag, text)."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = common.parts_for(spark, total * 2 // (length - GRAM + 2), BUCKET_RUNS)
    second = common.keep(_second_pass(_first_pass(docs, buckets, length), length), "runs")
    open_ = second.where("anchor IS NOT NULL")
    kind = _context_type(length)
    deep = common.parts_for(spark, open_.count() * 2, 60_000)

    def cut(batches):
        out: list[np.ndarray] = []

        def send():
            rows = np.concatenate(out)
            out.clear()
            parts = _bucketed(rows, rows["key"], deep)
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([_packed(p[1]) for p in parts], pa.binary())], ["bucket", "rows"])

        for batch in batches:
            doc, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            flat = batch.column(3).flatten()
            columns = [flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "stop", "anchor", "rel")]
            ends = np.cumsum(batch.column(3).value_lengths().to_numpy(zero_copy_only=False))
            for k, text in enumerate(common.byte_texts(batch.column(2))):
                own = slice(ends[k - 1] if k else 0, ends[k])
                out.append(contexts(text, doc[k], tag[k], *[c[own] for c in columns], length))
                if sum(map(len, out)) >= CUT_LOT:
                    yield send()
        if out:
            yield send()
        common.settle()

    def sort(table: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(map(_unpacked, table.column("rows").to_pylist())), kind)
        rows = rows[np.argsort(rows["key"], kind="stable")]
        cuts, spans = [0], []
        edge = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]]))
        for e in [*edge[1:], len(rows)]:  # one lot of whole buckets at a time
            if e - cuts[-1] >= 5_000 or e == len(rows):
                spans.append(equal_windows(rows[cuts[-1] : e], length))
                cuts.append(e)
        spans = _merged(np.concatenate(spans))
        return pa.table([pa.array(spans[c]) for c in SPAN.names], SPAN.names)

    lists = _by_row(open_, ["start", "stop", "anchor", "rel"])
    fetched = docs.join(lists, ["doc", "tag"]).select("doc", "tag", "text", "found").mapInArrow(cut, "bucket int, rows binary")
    more = fetched.groupBy("bucket").applyInArrow(sort, "doc long, tag long, start int, stop int")
    third = common.keep(more, "spans")
    return second.where("anchor IS NULL").select("doc", "tag", "start", "stop").unionByName(third)


def _merge(found: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in found or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "tag": F.xxhash64(text), "text": text})


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per document."""
    keyed = _keyed(docs.select("doc_id", "text"))
    spans = _by_row(repeated_spans(keyed.select("doc", "tag", "text"), length), ["start", "stop"])

    def apply(batches):
        for batch in batches:
            out = []
            for doc_id, text, found in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                data, gone = text.encode(), _merge(found)
                kept = hashlib.sha256()
                at = 0
                for a, b in [*gone, (len(data), len(data))]:
                    kept.update(data[at:a])
                    at = b
                out.append((doc_id, len(data), sum(b - a for a, b in gone), len(gone), kept.hexdigest()))
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = keyed.join(spans, ["doc", "tag"], "left").select("doc_id", "text", "found")
    return common.bounded(joined).mapInArrow(apply, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def shortened(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents, with their own columns, without the repeated bytes; a character that loses a byte goes whole.
    n_chars, where there is one, is counted anew."""
    keyed = _keyed(common.wrapped(docs, "doc_id", "text"))
    spans = _by_row(repeated_spans(keyed.select("doc", "tag", "text"), length), ["start", "stop"])

    def apply(batches):
        for batch in batches:
            out = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
                data, at, kept = text.encode(), 0, []
                for a, b in [*_merge(found), (len(data), len(data))]:
                    kept.append(data[at:a].decode(errors="ignore"))
                    at = b
                out.append("".join(kept))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(out, pa.string())], schema=pa.schema([batch.schema.field("_row"), pa.field("_text", pa.string())]))

    joined = keyed.join(spans, ["doc", "tag"], "left").select("_row", "text", "found")
    done = common.bounded(joined).mapInArrow(apply, common.with_fields(joined.select("_row"), ("_text", "string")))
    new = {"text": F.when(F.col("_row.text").isNotNull(), F.col("_text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_row.n_chars").isNotNull(), F.length("_text")).cast(dict(docs.dtypes)["n_chars"])
    return done.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
