"""Token counts by rank-synchronous array merging.

Pre-tokens of many texts lie as ragged numpy arrays of symbols. Each round,
every sequence finds its lowest-rank pair and merges it, all sequences at
once, until no pair is left; the symbols that survive are the tokens. Where a
merged piece can be part of no merge of its own or a lower rank, all its
places in a sequence merge in one round, else only the leftmost. Rounds grow
with the length of the longest sequence, so one of more than LONG characters
(a text without spaces, say) merges in the same order from a queue instead, in
n log n steps.

The model is a SentencePiece BPE model with byte fallback, identity
normalisation and a leading space (read with the library; its encoder is not
used). No piece has a space mark after another character, so a text is cut
before each run of spaces, and around characters that are in no longer
piece. Counts of pre-tokens are kept in a bounded table.

Null and empty texts have no tokens. Repeated rows get a row each; only
doc_id and text are read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, utf8

SPACE, LIMIT = "▁", 4096
#: Pre-tokens whose counts a worker keeps, and characters that are merged at once.
KEPT, AT_ONCE = 400_000, 500_000
#: Characters of a sequence that is merged from a queue.
LONG = 2000
_NONE = np.iinfo(np.int32).max


class Merger:
    def __init__(self, model: str):
        library = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = [i for i in range(library.get_piece_size()) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))]
        names = [library.id_to_piece(i) for i in ids]
        if any(SPACE in x.lstrip(SPACE) for x in names):
            raise ValueError("a piece has a space inside")
        number = {x: k for k, x in enumerate(names)}
        ranks, rank = np.unique([-library.get_score(i) for i in ids], return_inverse=True)
        pairs = sorted((number[x[:k]] * len(names) + number[x[k:]], number[x]) for x in names for k in range(1, len(x)) if x[:k] in number and x[k:] in number)
        self.size = len(names)
        self.keys, self.made = (np.array(x) for x in zip(*pairs, strict=True))
        self.made = self.made.astype(np.int32)
        self.rank = rank.astype(np.int32)
        least = np.full(len(names), _NONE, np.int32)  # lowest rank of a merge that a piece is part of
        for part in (self.keys // self.size, self.keys % self.size):
            np.minimum.at(least, part, self.rank[self.made])
        share = np.bincount(self.rank[np.unique(self.made)], minlength=len(ranks))
        self.sure = (least > self.rank) & (share[self.rank] == 1)
        self.of = np.full(0x110000, -1, np.int32)
        for x, k in number.items():
            if len(x) == 1:
                self.of[ord(x)] = k
        longer = {c for x in names if len(x) > 1 for c in x}
        alone = [c for c in "\n\r\t" if c not in longer]
        cut = "".join(f"\\x{ord(c):02x}" for c in alone)
        self.cut = regex.compile(f"[{cut}]|{SPACE}+[^{SPACE}{cut}]*|[^{SPACE}{cut}]+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.counts: dict[str, int] = {}

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.made[at], -1)

    def merge(self, sequences: list[str]) -> np.ndarray:
        """Tokens of each of the pre-tokens, none of which is empty."""
        text = "".join(sequences)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        symbol = self.of[points]
        owner = np.repeat(np.arange(len(sequences)), lengths)
        # a character that is no piece stands as its bytes
        weight = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        total = np.bincount(owner, np.where(symbol < 0, weight - 1, 0), len(sequences)).astype(np.int64) + lengths
        piece = np.full(len(symbol), -1, np.int32)
        piece[:-1] = np.where(owner[1:] == owner[:-1], self._pairs(symbol[:-1], symbol[1:]), -1)
        while len(symbol):
            rank = np.where(piece >= 0, self.rank[piece], _NONE)
            heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sizes = np.diff(np.append(heads, len(owner)))
            least = np.minimum.reduceat(rank, heads)
            live = np.repeat(least < _NONE, sizes)
            if not live.any():
                break
            hit = live & (rank == np.repeat(least, sizes))
            spots = np.flatnonzero(hit)
            first = np.concatenate(([True], owner[spots[1:]] != owner[spots[:-1]]))
            # of overlapping places every other one, from the left
            linked = np.concatenate(([False], (spots[1:] == spots[:-1] + 1) & ~first[1:]))
            place = np.arange(len(spots))
            place -= np.maximum.accumulate(np.where(linked, 0, place))
            take = spots[first | (self.sure[piece[spots]] & (place % 2 == 0))]
            symbol[take] = piece[take]
            total -= np.bincount(owner[take], minlength=len(total))
            stays = live
            stays[take + 1] = False
            where = np.cumsum(stays)[take] - 1
            symbol, owner, piece = symbol[stays], owner[stays], piece[stays]
            for at in (where, where[where > 0] - 1):
                after = np.minimum(at + 1, len(symbol) - 1)
                joined = (after > at) & (owner[after] == owner[at])
                piece[at] = np.where(joined, self._pairs(symbol[at], symbol[after]), -1)
        return total

    def _queued(self, sequence: str) -> int:
        """Tokens of one sequence: pairs wait in order of rank and place; merges link their neighbours anew."""
        points = np.frombuffer(sequence.encode("utf-32-le"), np.uint32)
        extra = int(((points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))[self.of[points] < 0].sum())
        symbol = self.of[points].tolist()
        n = left = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        made = self._pairs(np.array(symbol[:-1]), np.array(symbol[1:])).tolist()
        queue = [(int(self.rank[k]), i, k, symbol[i], symbol[i + 1]) for i, k in enumerate(made) if k >= 0]
        heapq.heapify(queue)
        while queue:
            _, i, k, a, b = heapq.heappop(queue)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue  # one of the two has been merged since
            symbol[i], symbol[j] = k, -2
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            left -= 1
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and symbol[x] >= 0 and symbol[y] >= 0 and (new := self.table.get(symbol[x] * self.size + symbol[y])) is not None:
                    heapq.heappush(queue, (int(self.rank[new]), x, new, symbol[x], symbol[y]))
        return left + extra

    @functools.cached_property
    def table(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.made.tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.cut(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        counts = self.counts
        new = list({x for part in cut for x in part if x not in counts})
        if len(counts) + len(new) > KEPT:
            counts.clear()
            new = list({x for part in cut for x in part})
        counts.update((x, self._queued(x)) for x in new if len(x) > LONG)
        new = [x for x in new if len(x) <= LONG]
        at = 0
        while at < len(new):
            to, size = at, 0
            while to < len(new) and (size == 0 or size + len(new[to]) <= AT_ONCE):
                size += len(new[to])
                to += 1
            counts.update(zip(new[at:to], self.merge(new[at:to]).tolist(), strict=True))
            at = to
        return [sum(map(counts.__getitem__, part)) for part in cut]


@functools.lru_cache(2)
def _merger(model: str) -> Merger:
    """Kept by each worker."""
    return Merger(model)


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit): a row for each row. model: a path that every executor has."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _merger(model)
        for batch in batches:
            column = utf8(batch.column("text"))
            for lo, hi in pieces(column, 1 << 20):
                texts = column[lo:hi].to_pylist()
                n = merger.count([t.decode() for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
