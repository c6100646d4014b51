"""Best-fit packing by minimum bin slack.

Each bin takes the longest piece left and the fullest combination that fits beside it, found by subset sums held as
bits of one integer over the lengths still available. Pieces are planned by length: the histogram of lengths has no
more rows than the bin has tokens, and a combination is used as often as its lengths last before the next is looked
for, so the plan on the driver is as small for any number of documents. Executors then number the pieces of one length
and look up their bin in the plan.

Null texts count as empty. Empty documents are one piece, the closing id. The string of a special token in a text is that
token, as the library gives it. Documents longer than a sequence, however long, are cut into pieces of its length and a
rest. Repeated rows are packed each; among pieces of one length doc_id, piece and checksum decide the order. No rows give
no rows. Only doc_id and text are read, so other columns of any name don't matter."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens


def encoded_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Cut each document's ids, end_id after them, into pieces of at most capacity ids."""

    def cut(batches):
        known = tokens.word_ids(tokenizer)
        tokens.alone(known)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), common.byte_texts(batch.column(1)), strict=True):
                ids = b"".join(map(known.__getitem__, text.split())) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
            columns = zip(*out, strict=True) if out else [()] * (5 + with_ids)
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    kind = dict(docs.dtypes)["doc_id"]
    return common.bounded(docs.select("doc_id", "text")).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Times each length is used in a fullest combination of total at most room; longer lengths first among equals.

    Bit s of a step's integer says that the items so far can fill s; a length's copies enter as 1, 2, 4, ... of it."""
    items, reach, seen = [], 1, [1]
    mask = (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        copies, lot = min(counts[length], room // length), 1
        while copies > 0:
            lot = min(lot, copies)
            items.append((length, lot))
            reach |= (reach << (length * lot)) & mask
            seen.append(reach)
            copies, lot = copies - lot, lot * 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    left, used = reach.bit_length() - 1, {}
    for k in range(len(items), 0, -1):
        if not seen[k - 1] >> left & 1:
            length, lot = items[k - 1]
            used[length] = used.get(length, 0) + lot
            left -= length * lot
    return used


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: copies}) for each combination, in order. Every piece of the histogram is used once."""
    left, out = dict(histogram), []
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        used = fullest({k: n for k, n in rest.items() if n and k <= capacity - longest}, capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        out.append((times, used))
        for k, n in used.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
    return out


def places(steps: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """By length, rows (first number, first sequence, copies, offset): which pieces of that length go where."""
    out: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for times, used in steps:
        offset = 0
        for length in sorted(used, reverse=True):
            out.setdefault(length, []).append((taken.get(length, 0), sequence, used[length], offset))
            taken[length] = taken.get(length, 0) + times * used[length]
            offset += length * used[length]
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def numbered(pieces: DataFrame) -> DataFrame:
    """Add number: 0, 1, ... among the pieces of one length. n pieces of a length are numbered in about root n groups,
    whose first numbers are sums over the counts of as many groups, so neither step holds a frequent length whole."""
    many = pieces.groupBy("length").agg(F.ceil(F.sqrt(F.count("*"))).cast("long").alias("groups"))
    many = F.broadcast(many)  # a row for each length that occurs, no more than the capacity
    pieces = pieces.join(many, "length").withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "groups")).drop("groups")
    before = Window.partitionBy("length").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    first = pieces.groupBy("length", "grp").agg(F.count("*").alias("n")).select("length", "grp", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("length", "grp").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("within", F.row_number().over(order) - 1)
    return ranked.join(first, ["length", "grp"]).withColumn("number", F.col("first") + F.col("within")).drop("first", "within", "grp")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Give each piece (doc_id, piece, start, length, ids_crc32, ...) a sequence_id and an offset in it."""
    pieces = common.keep(pieces, "pieces")
    # No more rows than capacity.
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = places(plan(histogram, capacity))

    def put(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length):
                rows = np.flatnonzero(length == k)
                table = where[k]
                step = table[np.searchsorted(table[:, 0], number[rows], side="right") - 1]
                within = number[rows] - step[:, 0]
                sequence[rows] = step[:, 1] + within // step[:, 2]
                offset[rows] = step[:, 3] + within % step[:, 2] * k
            kept = [batch.column(n) for n in names]
            yield pa.record_batch([*kept, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = pieces.columns
    return numbered(pieces).select(*names, "number").mapInArrow(put, common.with_fields(pieces, ("sequence_id", "long"), ("offset", "long")))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pack whole documents into sequences of at most capacity ids; with_ids adds each piece's ids (little-endian)."""
    return pack(encoded_pieces(docs, tokenizer, capacity, end_id, with_ids), capacity)
