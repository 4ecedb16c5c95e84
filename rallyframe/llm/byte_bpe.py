"""Byte-level BPE by a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. Every adjacent pair that has a merge rank goes into the bucket of that rank;
a three-level bitmap over all ranks marks the buckets in use. Find-first-set gives the lowest rank, whose positions
are taken in ascending order; an entry whose pair has changed meanwhile is stale and skipped. A pre-token of n bytes
thus takes O(n) queue operations besides the ordering inside a bucket, which matters for pre-tokens of many kilobytes.
The short pre-tokens that a batch of documents has for the first time share one queue: their lists lie in the same arrays
without links between them, so a bucket holds positions of many, of which one a pre-token is merged at a time.

Cases: null text encodes as empty; empty text has no ids and decodes to no bytes; repeated rows each give a row;
other columns are ignored. Memory: a bounded cache of pieces, and the ids of one batch of documents.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .runtime import map_batches, table

#: Pieces that a worker remembers; beyond, it starts anew.
CACHE_PIECES = 400_000
CACHE_TOKENS = 800_000
CACHE_PAIRS = 1_000_000
#: Documents whose new pre-tokens share a queue, at most.
BATCH = 4096
#: Longer pieces are not remembered.
CACHE_LENGTH = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.size = max(ranks.values(), default=0) + 1
        self.bytes_of = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.single = [ranks.get(bytes([b]), -1) for b in range(256)]
        keys, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    values.append(rank)
        order = np.argsort(keys)
        #: All pairs of ids that merge, ascending, and what they merge into; a last entry that no pair equals.
        self.pair_keys = np.append(np.array(keys, dtype=np.int64)[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.array(values, dtype=np.int64)[order], -1)
        #: Pair of ids to the id of what they merge into, as met so far.
        self.pairs: dict[int, int] = {}
        #: The bitmap below the top word: a bit for every bucket in use, and a bit for every word in use.
        self.low, self.mid = [0] * ((self.size >> 6) + 1), [0] * ((self.size >> 12) + 1)
        self.split = regex.compile(pattern)
        #: By what follows the space in front.
        self.pieces: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}

    def _pair(self, left: int, right: int) -> int:
        key = left * self.size + right
        found = self.pairs.get(key)
        if found is None:
            found = self.ranks.get(self.bytes_of[left] + self.bytes_of[right], -1)
            self.pairs[key] = found
        return found

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one pre-token: always the lowest rank first, the leftmost of equal ranks first.

        The queue's words are lists of this object, all zero between calls, as every bucket is emptied before the end.
        """
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        n = len(raw)
        ids = list(map(self.single.__getitem__, raw))
        if n < 2:
            return ids
        pairs, size, low, mid = self.pairs, self.size, self.low, self.mid
        if len(pairs) >= CACHE_PAIRS:
            pairs.clear()
        get = pairs.get
        buckets: dict[int, list[int]] = {}
        top = 0
        left = ids[0]
        for i in range(n - 1):
            right = ids[i + 1]
            key = left * size + right
            rank = get(key)
            if rank is None:
                rank = self._pair(left, right)
            left = right
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(i)  # ascending, so already a heap
                else:
                    buckets[rank] = [i]
                    low[rank >> 6] |= 1 << (rank & 63)
                    mid[rank >> 12] |= 1 << (rank >> 6 & 63)
                    top |= 1 << (rank >> 12)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while top:
            block = (top & -top).bit_length() - 1
            bits = mid[block]
            word = (block << 6) + (bits & -bits).bit_length() - 1
            bits = low[word]
            rank = (word << 6) + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            lower = False
            while bucket and not lower:
                i = heappop(bucket) if len(bucket) > 1 else bucket.pop()
                j = after[i]
                if j >= n or ids[i] < 0 or pairs[ids[i] * size + ids[j]] != rank:
                    continue  # stale
                ids[i], ids[j] = rank, -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    other = ids[k]
                    found = get(rank * size + other)
                    if found is None:
                        found = self._pair(rank, other)
                    if found >= 0:
                        if found in buckets:
                            heappush(buckets[found], i)
                        else:
                            buckets[found] = [i]
                            low[found >> 6] |= 1 << (found & 63)
                            mid[found >> 12] |= 1 << (found >> 6 & 63)
                            top |= 1 << (found >> 12)
                        lower = found < rank
                h = before[i]
                if h >= 0:
                    other = ids[h]
                    found = get(other * size + rank)
                    if found is None:
                        found = self._pair(other, rank)
                    if found >= 0:
                        if found in buckets:
                            heappush(buckets[found], h)
                        else:
                            buckets[found] = [h]
                            low[found >> 6] |= 1 << (found & 63)
                            mid[found >> 12] |= 1 << (found >> 6 & 63)
                            top |= 1 << (found >> 12)
                        if found < rank:
                            lower = True
            if not bucket:
                del buckets[rank]
                low[word] &= ~(1 << (rank & 63))
                if not low[word]:
                    mid[block] &= ~(1 << (word & 63))
                    if not mid[block]:
                        top &= ~(1 << block)
        return [x for x in ids if x >= 0]

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What pairs of ids merge into, -1 for nothing."""
        keys = left * self.size + right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where((self.pair_keys[at] == keys) & (right >= 0), self.pair_ranks[at], -1)

    def merge_many(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens one behind the other, and how many each has; by one queue over all of them."""
        sizes = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
        ids = np.array(self.single, dtype=np.int64)[np.frombuffer(b"".join(raws), dtype=np.uint8)]
        n, ends = len(ids), np.cumsum(sizes)
        of = np.repeat(np.arange(len(raws)), sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends[sizes > 0] - 1] = -1
        before[(ends - sizes)[sizes > 0]] = -1
        now = np.full(n, -1)  # the rank of the pair that begins at each position
        inner = np.flatnonzero(after >= 0)
        now[inner] = self._ranks_of(ids[inner], ids[inner + 1])
        low, mid, top = self.low, self.mid, 0
        buckets: dict[int, list[int]] = {}

        def push(ranks: list[int], positions: list[int]) -> int:
            marks = 0
            for rank, position in zip(ranks, positions, strict=True):
                bucket = buckets.get(rank)
                if bucket is None:
                    buckets[rank] = [position]
                    low[rank >> 6] |= 1 << (rank & 63)
                    mid[rank >> 12] |= 1 << (rank >> 6 & 63)
                    marks |= 1 << (rank >> 12)
                else:
                    bucket.append(position)
            return marks

        begin = np.flatnonzero(now >= 0)
        top |= push(now[begin].tolist(), begin.tolist())
        while top:
            block = (top & -top).bit_length() - 1
            bits = mid[block]
            word = (block << 6) + (bits & -bits).bit_length() - 1
            bits = low[word]
            rank = (word << 6) + (bits & -bits).bit_length() - 1
            at = np.array(buckets.pop(rank), dtype=np.int64)
            low[word] &= low[word] - 1
            if not low[word]:
                mid[block] &= mid[block] - 1
                if not mid[block]:
                    top &= top - 1
            at = at[now[at] == rank]  # the others are stale
            if len(at) > 1:
                at.sort()
                owner = of[at]
                again = np.flatnonzero(owner[1:] == owner[:-1]) + 1
                if len(again):  # the next ones of the same pre-token, after what the first may bring
                    top |= push([rank] * len(again), at[again].tolist())
                    at = np.delete(at, again)
            if not len(at):
                continue
            gone = after[at]
            right, left = after[gone], before[at]
            ids[at], ids[gone], now[gone] = rank, -1, -1
            after[at] = right
            has, had = right >= 0, left >= 0
            rights, lefts = right[has], left[had]
            before[rights] = at[has]
            m = len(rights)
            a, b = np.full(m + len(lefts), rank), np.full(m + len(lefts), rank)
            b[:m], a[m:] = ids[rights], ids[lefts]
            new = self._ranks_of(a, b)
            now[at] = -1
            where = np.concatenate([at[has], lefts])
            now[where] = new
            ok = new >= 0
            top |= push(new[ok].tolist(), where[ok].tolist())
        kept = ids >= 0
        return ids[kept], np.bincount(of[kept], minlength=len(raws))

    def learn(self, texts: list[str]) -> None:
        """Remember the short pre-tokens of texts that aren't known yet."""
        known, tokens = self.pieces, self.tokens
        new: dict[str, None] = {}
        for text in texts:
            own = pieces(text)
            for piece in (own[0], *(" " + p for p in set(own[1:]).difference(known))):
                for token in self.split.findall(piece):
                    if token not in tokens and len(token) <= CACHE_LENGTH:
                        new[token] = None
        if new:
            if len(tokens) + len(new) > CACHE_TOKENS:
                tokens.clear()
            whole, merged = {}, []
            for token in new:
                raw = token.encode("utf-8", "surrogatepass")
                rank = self.ranks.get(raw)
                if rank is not None:
                    whole[token] = rank.to_bytes(4, "little")
                else:
                    merged.append((token, raw))
            tokens.update(whole)
            ids, sizes = self.merge_many([raw for _, raw in merged])
            flat, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
            tokens.update(zip([t for t, _ in merged], map(flat.__getitem__, map(slice, [0, *ends], ends)), strict=False))

    def _token(self, token: str) -> bytes:
        found = self.tokens.get(token)
        if found is None:
            found = np.array(self.merge(token.encode("utf-8", "surrogatepass")), dtype="<u4").tobytes()
            if len(token) <= CACHE_LENGTH:
                if len(self.tokens) >= CACHE_TOKENS:
                    self.tokens.clear()
                self.tokens[token] = found
        return found

    def _encoded(self, piece: str) -> bytes:
        return b"".join(map(self._token, self.split.findall(piece)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = pieces(text)
        known = self.pieces
        parts[0], head = "", self._encoded(parts[0])
        out = list(map(known.get, parts))
        out[0] = head
        if None in out:
            for i, found in enumerate(out):
                if found is None:
                    piece = parts[i]
                    found = out[i] = self._encoded(" " + piece)
                    if len(piece) < CACHE_LENGTH:
                        if len(known) >= CACHE_PIECES:
                            known.clear()
                        known[piece] = found
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_BREAK = re.compile(r" (?=\S)")
#: A space before another white space, or at the end.
_SPACED = [" " + c for c in map(chr, range(0x3001)) if c.isspace()]
_SPACED_ASCII = [x for x in _SPACED if x.isascii()]


def _unsafe(text: str) -> bool:
    return text.endswith(" ") or any(x in text for x in (_SPACED_ASCII if text.isascii() else _SPACED))




def pieces(text: str) -> list[str]:
    """Cut a text at each space that a non-space follows; joined by spaces, the pieces give the text again.

    The pre-token pattern never crosses such a place: words, numbers and marks take one space in front and none behind,
    and a run of white space leaves its last space to what follows. All pieces but the first thus stand for themselves
    with a space in front.
    """
    return _BREAK.split(text) if _unsafe(text) else text.split(" ")


_coders: dict[tuple[str, str], ByteBPE] = {}


def coder(path: str, pattern: str) -> ByteBPE:
    """One per Python worker."""
    key = (path, pattern)
    if key not in _coders:
        _coders[key] = ByteBPE(load_ranks(path), pattern)
    return _coders[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens, and whether they decode to the text's bytes."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, pattern)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        bpe.learn(texts)
        ids = [bpe.encode(t) for t in texts]
        same = [bpe.decode(x) == t.encode("utf-8", "surrogatepass") for x, t in zip(ids, texts, strict=True)]
        yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_tokens", "round_trip"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, ids binary, n_tokens long, round_trip boolean", rows=BATCH)


def digest_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The same with digests in place of ids and bytes."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, pattern)
        n, of_ids, of_bytes = [], [], []
        texts = [t or "" for t in batch.column(1).to_pylist()]
        bpe.learn(texts)
        for text in texts:
            ids = bpe.encode(text)
            n.append(len(ids) // 4)
            of_ids.append(hashlib.sha256(ids).hexdigest())
            of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows=BATCH)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
