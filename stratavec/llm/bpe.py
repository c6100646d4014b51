"""Byte-level BPE by monoid tree reduction.

A text is cut by the splitting pattern, and each match is encoded alone. A match that is no token is halved until a half
is LEAF bytes long at most; halves are merged by rank, and two neighbours are joined by re-encoding a window over their
boundary that grows until it is provably stable: a sequence of tokens is the encoding of its bytes exactly if the encoding
of every two adjacent tokens' bytes is these two tokens again, so once both ends of the window agree so with the tokens
beside them, nothing outside can change. That holds if each token's own bytes merge to that token, which the tests check.
Decoding concatenates up the same kind of tree.

Null texts count as empty: no tokens. Texts of any length are encoded whole; a long match costs its length, as joins touch
few tokens. Special tokens' strings are ordinary text. Repeated rows are encoded each, an empty table gives no rows. Only
doc_id and text are read, so other columns of any name don't matter."""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, tokens

#: Bytes up to which a half is merged at once, about two tokens.
LEAF = 6
#: Above every rank.
NO_RANK = 1 << 60


class Encoder:
    """Encoding by the ranks of a vocabulary; every single byte must have one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF):
        import regex

        self.ranks, self.leaf = ranks, leaf
        self.matches = regex.compile(pattern).findall
        self.names = {rank: token for token, rank in ranks.items()}
        self.pairs = tokens.Cached(self._stable)
        self.leaves = tokens.Cached(self.merged)
        # Pairs of a string and bytes, which the garbage collector stops looking at, unlike as many lists.
        self.known = tokens.Cached(self._both, 240 << 20)

    @staticmethod
    def _ids(spelled: str) -> list[int]:
        return list(map(int, spelled.split(","))) if spelled else []

    def _both(self, piece: str) -> tuple[str, bytes]:
        """A piece's ids joined by commas, and what they decode to."""
        ids = [i for match in self.matches(piece) for i in self.encode_match(match.encode())]
        return ",".join(map(str, ids)), self.decode(ids)

    def merged(self, data: bytes) -> tuple[int, ...]:
        """Tokens of a short string: from single bytes on, the neighbours whose joint token has the least rank become that
        token, the first of equals, until none have one. What is a token already merges to itself."""
        ranks = self.ranks.get
        if (rank := ranks(data)) is not None:
            return (rank,)
        parts = [data[i : i + 1] for i in range(len(data))]
        joint = [ranks(data[i : i + 2], NO_RANK) for i in range(len(data) - 1)]
        while joint and (least := min(joint)) < NO_RANK:
            i = joint.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joint[i]
            if i:
                joint[i - 1] = ranks(parts[i - 1] + parts[i], NO_RANK)
            if i < len(joint):
                joint[i] = ranks(parts[i] + parts[i + 1], NO_RANK)
        return tuple([self.ranks[p] for p in parts])

    def _stable(self, pair: int) -> bool:
        """Whether two adjacent tokens, in one number, are the encoding of their bytes."""
        left, right = pair >> 32, pair & 0xFFFFFFFF
        return self.merged(self.names[left] + self.names[right]) == (left, right)

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of what left and right encode, from their tokens."""
        if not left or not right or self.pairs[left[-1] << 32 | right[0]]:
            return left + right
        width = 1
        while True:
            a, b = max(0, len(left) - width), min(width, len(right))
            window = self.merged(b"".join(map(self.names.__getitem__, left[a:] + right[:b])))
            before = not a or self.pairs[left[a - 1] << 32 | window[0]]
            after = b == len(right) or self.pairs[window[-1] << 32 | right[b]]
            if before and after:
                return left[:a] + window + right[b:]
            width *= 2

    def tree(self, data: bytes) -> tuple[int, ...]:
        """Halves up to leaf bytes long are merged at once, others from their own halves."""
        if len(data) <= self.leaf:
            return self.leaves[data]
        middle = len(data) // 2
        return self.join(self.tree(data[:middle]), self.tree(data[middle:]))

    def encode_match(self, data: bytes) -> tuple[int, ...]:
        rank = self.ranks.get(data)
        return (rank,) if rank is not None else self.tree(data)

    def encode(self, text: str) -> list[int]:
        return self._ids(self.spell(text)[0])

    def spell(self, text: str) -> tuple[str, bytes]:
        """A text's ids joined by commas, and what the ids decode to. Both are put together from the text's pieces, each of
        which is encoded, and its ids decoded, once."""
        found = list(map(self.known.__getitem__, tokens.pieces(text)))
        return ",".join([ids for ids, _ in found]), b"".join([data for _, data in found])

    def decode(self, ids: list[int]) -> bytes:
        """Concatenate up the tree; its lowest level is joined in runs."""
        if len(ids) <= 4096:
            return b"".join(map(self.names.__getitem__, ids))
        runs = [b"".join(map(self.names.__getitem__, ids[i : i + 4096])) for i in range(0, len(ids), 4096)]
        while len(runs) > 1:
            runs = [b"".join(runs[i : i + 2]) for i in range(0, len(runs), 2)]
        return runs[0]


@functools.cache
def encoder_of(ranks_path: str) -> Encoder:
    """Made once in a worker, whatever its tasks."""
    return Encoder(tokens.read_ranks(ranks_path), tokens.pattern())


def encoded(docs: DataFrame, ranks_path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), with_ids also the ids, of every whole text: ids_sha256 of the
    decimal ids joined by commas, decoded_sha256 of the bytes that the ids decode to."""

    def run(batches):
        encoder = encoder_of(ranks_path)
        tokens.alone(encoder.pairs, encoder.leaves, encoder.known)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, data = encoder.spell(text or "")
                count = ids.count(",") + 1 if ids else 0
                out.append((doc_id, count, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(data).hexdigest(), *([encoder._ids(ids)] if with_ids else [])))
            columns = zip(*out, strict=True) if out else [()] * (4 + with_ids)
            kinds = (batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids])

    return common.bounded(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decoded(rows: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, data binary) from rows (doc_id, ids array<int>); null ids decode to nothing."""

    def run(batches):
        encoder = encoder_of(ranks_path)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([encoder.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "data"])

    return common.bounded(rows.select("doc_id", "ids")).mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, data binary")
