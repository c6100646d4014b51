"""SimHash near-dedup by anchor-point covering.

Anchors are the codewords of a covering code on chosen fingerprint bits, made of the binary perfect code of 23 bits, whose
balls of radius 3 cover everything once. A fingerprint is at home with the anchor whose ball holds it and is replicated to
every anchor within the covering radius plus the threshold, the excess over the radii of both halves counted together. If
x and y differ in at most that many of the chosen bits, y is a guest at x's home, so comparing homes with guests anchor by
anchor finds every such pair. Only a spanning forest of each comparison leaves a task. An anchor with more homes than a
task should hold is split: its homes into parts, its guests into parts, and each part of one meets each part of the other.

Two uses. `linked_by_distance` is exact for small distances on one 64-bit fingerprint: a word of the code on either half of
46 bits. `linked_by_similarity` takes wider fingerprints and several tables of chosen bits, as a similarity of 0.8 is far
more differing bits than any single covering could allow for: 23 bits covered with threshold 1, and some that must be equal.
How many of these, and how many tables, follow from the number of documents and the recall that is asked for. There
fingerprints only propose; documents are linked if their sets of shingles are found to be that similar.

Null and empty texts have no shingle and fingerprint zero; one shingle makes up a text of fewer words. Texts of any length
are read whole. Equal fingerprints, or sets, are collapsed before anything is compared, so groups of copies, however large,
cost one row; repeated rows are copies. Rows with a null doc_id take part; where all of a component have none, its id is
null. No documents give no rows. Only doc_id and text are read; filters return all columns, whatever their names."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

SEED = 42
HALF, RADIUS = 23, 3
#: Fixed value: generator polynomial of the perfect code of 23 bits, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Shingles hashed at once; longer texts are counted in such lots.
LOT = 1 << 15


def _remainder(words: np.ndarray) -> np.ndarray:
    words = words.copy()
    for bit in range(HALF - 1, 10, -1):
        words ^= (words >> bit & 1) * (GENERATOR << (bit - 11))
    return words


@functools.cache
def _shifts(e: int) -> tuple[np.ndarray, np.ndarray]:
    """Error patterns e beyond the covering radius (up to it for 0), ordered by remainder, and where each remainder begins.
    x and a pattern of x's remainder differ by a codeword."""
    import itertools

    weights = range(RADIUS + 1) if e == 0 else [RADIUS + e]
    patterns = np.array([sum(1 << i for i in c) for w in weights for c in itertools.combinations(range(HALF), w)], np.int64)
    rest = _remainder(patterns)
    order = np.argsort(rest, kind="stable")
    return patterns[order], np.searchsorted(rest[order], np.arange((1 << 11) + 1))


def _around(words: np.ndarray, e: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword): those e beyond the covering radius from each word; the one within it for 0."""
    patterns, at = _shifts(e)
    rest = _remainder(words)
    n = np.diff(at)[rest]
    row = np.repeat(np.arange(len(words)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, (words[row] ^ patterns[at[rest[row]] + k]) >> 11


def anchors(high: np.ndarray, low: np.ndarray, excess: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) for each anchor within the radii plus excess altogether. Both halves have 23 bits; with exact
    the code of the second one is all words, its radius 0 and no excess left for it."""
    rows, keys, home = [], [], []
    for a in range(excess + 1):
        outer, first = _around(high, a)
        for b in range(1 if exact else excess + 1 - a):
            inner, second = (np.arange(len(outer)), low[outer]) if exact else _around(low[outer], b)
            rows.append(outer[inner])
            keys.append(first[inner] << 24 | second)
            home.append(np.full(len(inner), a + b == 0))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(home)


@functools.cache
def meeting_odds(p: float, excess: int) -> float:
    """Odds that of two fingerprints whose bits differ with odds p one is a guest at the other's home, on 23 bits; counted
    on drawn words."""
    rng = np.random.default_rng(SEED)
    x = rng.integers(0, 1 << HALF, 50_000)
    y = x ^ (rng.random((len(x), HALF)) < p) @ (1 << np.arange(HALF))
    homes = [w ^ _shifts(0)[0][_shifts(0)[1][_remainder(w)]] for w in (x, y)]
    return float(((np.bitwise_count(homes[0] ^ y) <= RADIUS + excess) | (np.bitwise_count(homes[1] ^ x) <= RADIUS + excess)).mean())


def bit_odds(similarity: float) -> float:
    """Odds that a bit differs between sets of that Jaccard similarity: their cosine is 2s / (1 + s) for sets of one size."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def most_bits(similarity: float, bits: int) -> int:
    """Differing bits up to which fingerprints propose sets of that similarity: what is expected, and three standard
    deviations."""
    p = bit_odds(similarity)
    return int(bits * p + 3 * np.sqrt(bits * p * (1 - p)))


@functools.cache
def tables_for(similarity: float, bits: int, exact: int, excess: int, recall: float) -> int:
    """Tables of which at least one brings two such sets together with odds of recall. All tables take their bits from the
    same fingerprint, so for each number of bits that may differ in it the odds are reckoned apart."""
    p = bit_odds(similarity)
    far = np.arange(1, most_bits(similarity, bits) + 1)
    far = far[far > bits * p - 5 * np.sqrt(bits * p * (1 - p))]
    logs = np.cumsum(np.log(np.concatenate([[1.0], np.arange(1, bits + 1)])))
    weight = np.exp(logs[bits] - logs[far] - logs[bits - far] + far * np.log(p) + (bits - far) * np.log(1 - p))
    once = np.array([meeting_odds(d / bits, excess) * (1 - d / bits) ** exact for d in far.tolist()])
    tables = 1
    while (weight * (1 - (1 - once) ** tables)).sum() < recall * weight.sum():
        tables += 1
    return tables


def _mixed(h: np.ndarray, plane: int) -> np.ndarray:
    """The shingle hashes themselves for plane 0, other 64 bits made of them for each further plane."""
    if not plane:
        return h
    h = h + np.uint64(plane * 0x9E3779B97F4A7C15 % (1 << 64))
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _hashes(text: bytes, words: int):
    """Hashes of the text's word shingles, repeats included, in lots."""
    import xxhash

    found = text.lower().split()
    if not found:
        return
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - words + 1)
    ends = ends[min(words, len(found)) - 1 :][:n].tolist()
    starts = starts[:n].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, LOT):
        yield np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + LOT], ends[at : at + LOT], strict=True)], np.uint64)


def _majority(lots, planes: int) -> bytes:
    ones, n = np.zeros((planes, 64), np.int64), 0
    for h in lots:
        n += len(h)
        for plane in range(planes):
            bits = np.unpackbits(_mixed(h, plane).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones[plane] += bits.sum(0, dtype=np.int32)
    return np.packbits((2 * ones > n).astype(np.uint8)).tobytes()


def fingerprint(text: bytes, words: int, planes: int = 1) -> bytes:
    """Big-endian fingerprint of 64 bits a plane of the text's word shingles, repeats included."""
    return _majority(_hashes(text, words), planes)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted hashes of the text's word shingles, each once."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_hashes(text, words)]))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; 1 for two empty ones."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return same / (len(both) - same) if len(both) else 1.0


def fingerprints(docs: DataFrame, words: int, planes: int = 1) -> DataFrame:
    """(doc_id, fp binary of 8 bytes a plane) per document."""

    def make(batches):
        tokens.alone()
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([fingerprint(t, words, planes) for t in common.byte_texts(batch.column(1))], pa.binary())], ["doc_id", "fp"])

    return common.bounded(docs.select("doc_id", "text")).mapInArrow(make, f"doc_id {dict(docs.dtypes)['doc_id']}, fp binary")


def set_fingerprints(docs: DataFrame, words: int, planes: int) -> DataFrame:
    """(doc_id, tag, id, fp) per document: hashes of the text and of its set of shingles, and the set's fingerprint."""

    def make(batches):
        tokens.alone()
        for batch in batches:
            sets = [shingle_set(t, words) for t in common.byte_texts(batch.column(2))]
            fps = [_majority((s[at : at + LOT] for at in range(0, len(s), LOT)), planes) for s in sets]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(_set_ids(sets)), pa.array(fps, pa.binary())], ["doc_id", "tag", "id", "fp"])
        common.settle()

    return _tagged(docs).mapInArrow(make, f"doc_id {dict(docs.dtypes)['doc_id']}, tag long, id long, fp binary")


def _tagged(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"), "text")


def _set_ids(sets: list[np.ndarray]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)


#: Homes of an anchor, and rows that lie at one, above which it is split. At most ANCHORS_SPLIT anchors are, so what the
#: driver sends to tasks of them is bounded: the limit follows the number of rows where that would be more.
HOMES, ROWS, ANCHORS_SPLIT, MOST_PARTS = 20_000, 200_000, 50_000, 64
#: Fingerprints replicated at once.
REPLICATED = 1024
#: Multipliers of a hash of ids, and of one of keys.
_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Covering:
    """Tables of chosen bits of fingerprints of 64 bits a plane: 23 of them covered, and 23 more or some exact ones."""

    def __init__(self, planes: int, tables: int, excess: int, exact: int = 0):
        self.planes, self.excess, self.exact = planes, excess, exact
        rng, each = np.random.default_rng(SEED), HALF + (exact or HALF)
        self.chosen = np.arange(each)[None] if tables == 1 else np.array([rng.choice(64 * planes, each, replace=False) for _ in range(tables)])
        self.kind = np.dtype([("key", "<i8"), ("id", "<i8"), ("home", "?"), ("fp", "<u8", (planes,))])
        #: Anchors of a fingerprint on average.
        self.ball = tables * (61 if not exact else 1 + excess * 5)

    def rows(self, ids: np.ndarray, fps: list[bytes], excess: int | None = None):
        """Rows of the fingerprints at all their anchors, by table; with excess 0 at their homes only."""
        raw = np.frombuffer(b"".join(fps), np.uint8).reshape(-1, 8 * self.planes)
        bits = np.unpackbits(raw, axis=1)
        fp = raw.reshape(-1, self.planes, 8).copy().view(">u8")[..., 0].astype(np.uint64)
        for t, own in enumerate(self.chosen):
            high, low = (b.astype(np.int64) @ (1 << np.arange(b.shape[1] - 1, -1, -1, dtype=np.int64)) for b in (bits[:, own[:HALF]], bits[:, own[HALF:]]))
            row, key, home = anchors(high, low, self.excess if excess is None else excess, bool(self.exact))
            out = np.zeros(len(row), self.kind)
            out["key"], out["id"], out["home"], out["fp"] = key | t << 48, ids[row], home, fp[row]
            yield out

    def split(self, items: DataFrame, count: int) -> dict[int, int]:
        """Parts of each anchor that is too large. Homes are counted everywhere; all rows, only of fingerprints whose home
        is too large, as others can't crowd an anchor: it has a bounded number of anchors near it."""

        def counted(excess, homes):
            def count_keys(batches):
                for batch in batches:
                    for lot in range(0, batch.num_rows, 8 * REPLICATED):
                        part = batch.slice(lot, 8 * REPLICATED)
                        ids, fps = part.column("id").to_numpy(), np.array([*part.column("fp").to_pylist(), None], object)[:-1]
                        if homes is not None:
                            crowded = np.zeros(len(ids), bool)
                            for rows in self.rows(np.arange(len(ids)), fps, 0):
                                crowded[rows["id"][np.isin(rows["key"], homes)]] = True
                            ids, fps = ids[crowded], fps[crowded]
                        for rows in self.rows(ids, fps, excess) if len(ids) else ():
                            key, n = np.unique(rows["key"], return_counts=True)
                            yield pa.record_batch([pa.array(key), pa.array(n)], ["key", "n"])

            least = max(HOMES if homes is None else ROWS, -(-count * self.ball // ANCHORS_SPLIT))
            found = items.select("id", "fp").mapInArrow(count_keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > least)
            return {r.key: min(-(-r.n // least), MOST_PARTS) for r in found.collect()}  # ANCHORS_SPLIT at most

        homes = counted(0, None)
        return homes and homes | counted(self.excess, np.array(sorted(homes)))

    def parted(self, rows: np.ndarray, parts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Rows at split anchors in the cells where their part of the homes, or of the guests, meets the others."""
        keys, number = parts
        if not len(keys):
            return rows
        at = np.minimum(np.searchsorted(keys, rows["key"]), len(keys) - 1)
        hot = keys[at] == rows["key"]
        out = [rows[~hot]]
        for own, p in ((rows[hot & (number[at] == p)], p) for p in np.unique(number)):
            part = (own["id"].view(np.uint64) * _ODD[0] >> np.uint64(40)).astype(np.int64) % p
            for k in range(p):
                for some, cell, home in ((own["home"], part * p + k, True), (np.ones(len(own), bool), k * p + part, False)):
                    copy = own[some]
                    copy["key"] |= cell[some] << 36
                    copy["home"] = home
                    out.append(copy)
        return np.concatenate(out)


def _near(rows: np.ndarray, pairs: int, most: int):
    """Lots of near pairs (u, v, differing bits) in one sorted block: each home against all of its anchor."""
    key, fp = rows["key"], rows["fp"]
    start, end = np.searchsorted(key, key, "left"), np.searchsorted(key, key, "right")
    homes = np.flatnonzero(rows["home"] & (end - start > 1))
    size = np.cumsum((end - start)[homes])
    cut = 0
    while cut < len(homes):
        upto = max(cut + 1, int(np.searchsorted(size, (size[cut - 1] if cut else 0) + pairs, "right")))
        h = homes[cut:upto]
        n = (end - start)[h]
        one = np.repeat(h, n)
        other = np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[h], n)
        far = np.zeros(len(one), np.uint16)
        for p in range(fp.shape[1]):
            far += np.bitwise_count(fp[one, p] ^ fp[other, p])
        near = (far <= most) & (rows["id"][one] != rows["id"][other])
        if near.any():
            yield rows["id"][one[near]], rows["id"][other[near]], far[near]
        cut = upto


def _forest(lots) -> tuple[np.ndarray, np.ndarray]:
    found = [common.forest(u, v) for u, v, _ in lots]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return common.forest(*map(np.concatenate, zip(*found, strict=True)))


def links(items: DataFrame, covering: Covering, most: int, count: int) -> DataFrame:
    """Edges (u, v) that span the items (id long, fp binary) with fingerprints at most `most` bits apart which meet at
    an anchor. Rows travel packed by bucket of anchors; the number of buckets follows the number of rows."""
    spark = items.sparkSession
    buckets = common.parts_for(spark, count * covering.ball, 400_000)
    found = covering.split(items, count)
    keys = np.array(sorted(found), np.int64)
    parts = keys, np.array([found[k] for k in keys.tolist()], np.int64)

    def replicate(batches):
        for batch in batches:
            for lot in range(0, batch.num_rows, REPLICATED):
                part = batch.slice(lot, REPLICATED)
                rows = np.concatenate([covering.parted(r, parts) for r in covering.rows(part.column("id").to_numpy(), part.column("fp").to_pylist())])
                bucket = (rows["key"].astype(np.uint64) * _ODD[1] >> np.uint64(33)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                rows, bucket = rows[order], bucket[order]
                own, first = np.unique(bucket, return_index=True)
                bounds = [*first, len(rows)]
                yield pa.record_batch([pa.array(own.astype(np.int32)), pa.array([rows[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["bucket", "rows"])
        common.settle()

    def compare(table: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(table.column("rows").to_pylist()), covering.kind)
        rows = rows[np.argsort(rows["key"], kind="stable")]
        u, v = _forest(_near(rows, 250_000, most))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    packed = items.select("id", "fp").mapInArrow(replicate, "bucket int, rows binary")
    return packed.groupBy("bucket").applyInArrow(compare, "u long, v long")


def linked_by_distance(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) per document; documents link at fingerprints that differ in
    at most distance bits, and component_id is the least doc_id reachable. Exact."""
    fps = common.keep(fingerprints(docs, words), "fingerprints")
    # The vertex is the fingerprint itself, read as a long.
    named = fps.withColumn("id", F.conv(F.hex("fp"), 16, -10).cast("long"))
    distinct = common.keep(named.groupBy("id", "fp").agg(F.min("doc_id").alias("least")), "distinct")
    edges = common.keep(links(distinct, Covering(1, 1, distance), distance, distinct.count()), "links")
    owner = _owners(distinct, edges)
    common.drop(distinct, edges)
    return named.join(owner, "id").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def _owners(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component_id) of distinct (id, least) by the edges between ids. Each join starts from written tables, so that a
    large component is split."""
    roots = common.components(edges)
    named = common.keep(distinct.join(roots, distinct["id"] == roots["u"], "left").select("id", "least", F.coalesce("v", "id").alias("root")), "roots")
    least = common.keep(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    owner = common.keep(named.join(least, "root").select("id", "component_id"), "components")
    common.drop(roots, named, least)
    return owner


def _verified(ids: np.ndarray, side: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], most: int, similarity: float) -> list[tuple[int, int]]:
    """Links that span what is similar among documents near each other by fingerprint: the nearest are compared first, and
    none that are joined already. Where both sides occur, only pairs of one with the other are looked at."""
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    out, sizes, both = [], np.array([len(s) for s in sets]), len(set(side.tolist())) > 1
    for at in range(0, len(ids), 256):
        far = np.bitwise_count(fps[at : at + 256, None] ^ fps[None]).sum(2, dtype=np.uint16)
        near = (far <= most) & (np.arange(at, min(at + 256, len(ids)))[:, None] < np.arange(len(ids))[None])
        near &= np.minimum(sizes[at : at + 256, None], sizes[None]) >= similarity * np.maximum(sizes[at : at + 256, None], sizes[None])
        if both:
            near &= side[at : at + 256, None] != side[None]
        one, other = np.nonzero(near)
        for k in np.argsort(far[one, other], kind="stable"):
            i, j = int(one[k]) + at, int(other[k])
            if (a := find(i)) != (b := find(j)) and jaccard(sets[i], sets[j]) >= similarity:
                root[a] = b
                out.append((int(ids[i]), int(ids[j])))
    return out


def _linked_in_groups(members: DataFrame, most: int, similarity: float, planes: int) -> DataFrame:
    """Links (u, v) that span the similar ones of each group, for members (grp, id, fp, shingles). A group of n is cut into
    about root n blocks (one, if n is small) and each two blocks meet in one place, so no task holds a large group; no pair
    leaves its task but those of a spanning forest."""
    spark = members.sparkSession
    blocks = F.when(F.col("n") <= 64, 1).otherwise(F.ceil(F.sqrt("n") / 2)).cast("int")
    sizes = common.keep(members.groupBy("grp").agg(F.count("*").alias("n")), "sizes")
    placed = members.join(sizes.select("grp", blocks.alias("blocks")), "grp").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    total = placed.agg(F.sum(F.octet_length("shingles") * F.col("blocks"))).first()[0] or 0
    buckets = common.parts_for(spark, total, 8 << 20)
    each = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select("grp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "fp", "shingles")
    each = each.withColumn("bucket", F.pmod(F.xxhash64("grp", "lo", "hi"), F.lit(buckets)).cast("int"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("grp", "ascending"), ("lo", "ascending"), ("hi", "ascending"), ("id", "ascending")])
        grp, lo, hi, block, ids = (table.column(c).to_numpy() for c in ("grp", "lo", "hi", "block", "id"))
        fps = np.frombuffer(b"".join(table.column("fp").to_pylist()), np.uint64).reshape(-1, planes)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        edge = np.flatnonzero(np.concatenate([[True], (grp[1:] != grp[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
        found = [pair for a, b in zip(edge, [*edge[1:], len(grp)], strict=True) for pair in _verified(ids[a:b], block[a:b], fps[a:b], sets[a:b], most, similarity)]
        return pa.table({c: pa.array([p[k] for p in found], pa.int64()) for k, c in enumerate("uv")})

    found = common.keep(each.groupBy("bucket").applyInArrow(compare, "u long, v long"), "links")
    common.drop(sizes)
    return found


def linked_by_similarity(docs: DataFrame, words: int = 5, similarity: float = 0.8, planes: int = 2, recall: float = 0.95) -> DataFrame:
    """(doc_id, key, component_id) per document, linked where the sets of shingles have at least the given similarity;
    key is the same for equal sets. Fingerprints propose the pairs, so some are missed, as SimHash does: recall is the part
    that the tables are to bring together at that very similarity, of more similar pairs it is more. None is linked without
    its sets being compared. The exact bits keep the homes of an anchor to about 64 for any number of documents.

    Proposals span groups. In a group all near fingerprints are compared as sets, but for those that are joined already:
    about a comparison a document where a group is alike, and the square where its documents resemble each other at less
    than the similarity; neither the rows that move nor the memory of a task grow like that."""
    spark, most = docs.sparkSession, most_bits(similarity, 64 * planes)
    sets = common.keep(set_fingerprints(docs, words, planes), "fingerprints")
    # Of copies, the row with the least doc_id stands for the set.
    distinct = common.keep(sets.groupBy("id").agg(F.first("fp").alias("fp"), F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "tag")).alias("row")).select("id", "fp", F.col("row.doc_id").alias("least"), "row.tag"), "distinct")
    count = distinct.count()
    exact = int(min(max(np.ceil(np.log2(max(count, 1) / (64 << 12))), 7), 24))
    covering = Covering(planes, tables_for(similarity, 64 * planes, exact, 1, recall), 1, exact)
    proposals = common.keep(links(distinct, covering, most, count), "proposals")
    groups = common.components(proposals)
    common.drop(proposals)
    named = groups.select(F.col("u").alias("id"), F.col("v").alias("grp")).union(groups.select(F.col("v").alias("id"), F.col("v").alias("grp")).distinct())
    chosen = common.keep(distinct.join(named, "id").select("id", "fp", "grp", "least", "tag"), "chosen")
    common.drop(groups)

    def shingles(batches):
        for batch in batches:
            found = [shingle_set(t, words) for t in common.byte_texts(batch.column(0))]
            yield pa.record_batch([pa.array(_set_ids(found)), pa.array([x.tobytes() for x in found], pa.binary())], ["id", "shingles"])

    texts = _tagged(docs)
    mine = texts["doc_id"].eqNullSafe(chosen["least"]) & (texts["tag"] == chosen["tag"])
    made = texts.join(chosen, mine, "left_semi").select("text").mapInArrow(shingles, "id long, shingles binary").dropDuplicates(["id"])
    members = common.keep(made.join(chosen.select("id", "fp", "grp"), "id").select("grp", "id", "fp", "shingles"), "members")
    edges = _linked_in_groups(members, most, similarity, planes)
    common.drop(chosen, members)
    owner = _owners(distinct, edges)
    common.drop(distinct, edges)
    out = common.keep(sets.join(owner, "id").select("doc_id", F.col("id").alias("key"), "component_id"), "linked")
    common.drop(sets, owner)
    return out


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, planes: int = 2, recall: float = 0.95) -> DataFrame:
    """The documents without near copies: of each group the one with the least doc_id stays, with its own columns.
    Rows that share that doc_id stay together; rows without doc_id stay unless linked to one that has it."""
    found = linked_by_similarity(docs, words, similarity, planes, recall)
    gone = common.keep(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    common.drop(found)
    return docs.join(gone, "doc_id", "left_anti")
