"""Byte-level BPE by monoid tree reduction, and its decoding.

Encoding is a homomorphism up to what happens at boundaries, so a text is encoded in halves and the halves are
joined, twice over:

* Text level. The pattern that cuts a text into pieces never looks behind, so pieces that follow a common
  boundary are equal. A piece of the left half is stable if the matcher saw all it may look at inside that half
  (one character past its end, three past its start); from the first unstable piece on, a window that reaches ever
  further into the right half is cut again until one of its stable boundaries is a boundary of the right half too.
* Byte level, inside a piece of more than LEAF bytes. Tokens are a valid encoding if and only if each two
  neighbours are (the pair re-encodes to itself), so a window of tokens around the joint is re-encoded and grows,
  doubling on each side, until its outermost tokens are compatible with the untouched ones beside them. Then all
  tokens outside are proven stable.

Decoding maps ids to bytes and concatenates up the same tree.

Time grows as n log n or little more (runs and other pieces whose tokens never settle at a joint are merged by sweeps
or a heap, and once more at each level of the tree).

Defined results: a null or empty text has no tokens; texts of any length take memory in proportion to their own
length; repeated rows get equal results; other columns, whatever their names, are carried along.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAF = 64  # bytes of a piece that are merged at once
FEW = 4  # pieces of so few distinct bytes (runs) are merged at once: their tokens never settle at a joint
CHUNK = 16_384  # characters of a text that are cut into pieces at once
CACHE = 200_000  # pieces whose tokens a worker keeps


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.cut = regex.compile(pattern).findall
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> Bpe:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        return cls(ranks, pattern)

    # bytes of one piece

    def merged(self, data: bytes) -> list[int]:
        """Merges by lowest rank, leftmost first, over the whole of data."""
        ranks = self.ranks
        if (whole := ranks.get(data)) is not None:
            return [whole]
        parts = [data[i : i + 1] for i in range(len(data))]
        if len(parts) > 4 * LEAF:
            return [ranks[p] for p in self._merged_long(parts)]
        far = len(self.bytes_of) + 1 << 20
        costs = [ranks.get(a + b, far) for a, b in zip(parts, parts[1:])]
        while costs:
            least = min(costs)
            if least == far:
                break
            i = costs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = ranks.get(parts[i] + parts[i + 1], far)
            if i:
                costs[i - 1] = ranks.get(parts[i - 1] + parts[i], far)
        return [ranks[p] for p in parts]

    def _merged_long(self, parts: list[bytes]) -> list[bytes]:
        """The same for many parts: whole sweeps while the lowest rank occurs densely (runs), then a heap of pairs.

        A sweep merges all pairs of the lowest rank from left to right and stops where a merge makes a lower one.
        """
        get = self.ranks.get
        far = len(self.bytes_of) + 1 << 20
        while True:
            costs = [get(a + b, far) for a, b in zip(parts, parts[1:])]
            least, n = min(costs, default=far), len(parts)
            if least == far:
                return parts
            if costs.count(least) * 8 < n:
                break
            out, i = [], 0
            while i < n:
                if i < n - 1 and costs[i] == least:
                    pair = parts[i] + parts[i + 1]
                    lower = (out and get(out[-1] + pair, far) < least) or (i + 2 < n and get(pair + parts[i + 2], far) < least)
                    out.append(pair)
                    i += 2
                    if lower:
                        out += parts[i:]
                        break
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(c, i) for i, c in enumerate(costs) if c < far]
        heapify(heap)
        costs.append(far)
        while heap:
            cost, i = heappop(heap)
            if costs[i] != cost:
                continue
            j = after[i]
            parts[i] += parts[j]
            parts[j], costs[j] = b"", far
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                costs[i] = get(parts[i] + parts[k], far)
                if costs[i] < far:
                    heappush(heap, (costs[i], i))
            else:
                costs[i] = far
            h = before[i]
            if h >= 0:
                costs[h] = get(parts[h] + parts[i], far)
                if costs[h] < far:
                    heappush(heap, (costs[h], h))
        return [p for p in parts if p]

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of both sides, from the encodings of each."""
        if not left or not right:
            return left + right
        if self.compatible(left[-1], right[0]):
            return left + right
        reach = 1
        while True:
            a, b = max(0, len(left) - reach), min(len(right), reach)
            middle = self.merged(b"".join(map(self.bytes_of.__getitem__, left[a:] + right[:b])))
            if (not a or self.compatible(left[a - 1], middle[0])) and (b == len(right) or self.compatible(middle[-1], right[b])):
                return left[:a] + middle + right[b:]
            reach *= 2

    def piece(self, data: bytes) -> list[int]:
        if len(data) <= LEAF or len(set(data)) <= FEW:
            return self.merged(data)
        half = len(data) // 2
        return self.joined(self.piece(data[:half]), self.piece(data[half:]))

    # text

    def tokens_of(self, piece: str) -> tuple[int, ...]:
        known = self.pieces.get(piece)
        if known is None:
            known = tuple(self.piece(piece.encode("utf-8")))
            if len(piece) <= LEAF:
                if len(self.pieces) >= CACHE:
                    self.pieces.clear()
                self.pieces[piece] = known
        return known

    def _join_pieces(self, left: list[str], right: list[str]) -> list[str]:
        if not left or not right:
            return left + right
        # the unstable end of the left side: pieces whose matching may have looked past its end
        n, after, before = len(left), 0, 0
        while n:
            before += len(left[n - 1])
            if after >= 1 and before >= 3:
                break
            n -= 1
            after = before
        tail = "".join(left[n:])
        reach = 4
        while True:
            part = right[:reach]
            window = tail + "".join(part)
            whole = reach >= len(right)
            bounds, at = {}, len(tail)
            for k, p in enumerate(part):
                bounds[at] = k
                at += len(p)
            cut, done, at = self.cut(window), [], 0
            for p in cut:
                if at in bounds:
                    return left[:n] + done + right[bounds[at] :]
                end = at + len(p)
                if not whole and max(end + 1, at + 3) > len(window):
                    break
                done.append(p)
                at = end
            else:
                if whole:
                    return left[:n] + done
                if at == len(window):
                    return left[:n] + done + right[reach:]
            reach *= 2

    def pieces_of(self, text: str) -> list[str]:
        if len(text) <= CHUNK:
            return self.cut(text)
        half = len(text) // 2
        return self._join_pieces(self.pieces_of(text[:half]), self.pieces_of(text[half:]))

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            get, known = self.tokens_of, self.pieces.get
            for p in self.pieces_of(text):
                out += known(p) or get(p)
        return out

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= CHUNK:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_LOADED: dict[tuple[str, str], Bpe] = {}


def loaded(path: str, pattern: str) -> Bpe:
    """One Bpe for each vocabulary and worker process."""
    key = (path, pattern)
    if key not in _LOADED:
        _LOADED[key] = Bpe.load(path, pattern)
    return _LOADED[key]


def encoded(text: Column, path: str, pattern: str) -> Column:
    """Column of token ids (array<int>) of a text column."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = loaded(path, pattern)
        for texts in batches:
            yield pd.Series([bpe.encode(t) for t in texts], dtype=object)

    return run(text)


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """Column of bytes (binary) of a column of token ids."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = loaded(path, pattern)
        for rows in batches:
            yield pd.Series([None if r is None else bpe.decode([int(i) for i in r]) for r in rows], dtype=object)

    return run(ids)


def round_trip(text: Column, path: str, pattern: str) -> Column:
    """Struct (n_tokens, ids_sha256, decoded_sha256) of a text column: encoded, then decoded from its ids."""

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path, pattern)
        for texts in batches:
            rows = []
            for t in texts:
                ids = bpe.encode(t)
                rows.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)


def tokenised(text: Column, path: str, pattern: str) -> Column:
    """Struct (ids, n_tokens, decodes) of a text column; decodes tells whether the ids give the text's bytes back."""

    @F.pandas_udf("ids array<int>, n_tokens bigint, decodes boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path, pattern)
        for texts in batches:
            rows = [(ids := bpe.encode(t), len(ids), bpe.decode(ids) == (t or "").encode("utf-8")) for t in texts]
            yield pd.DataFrame(rows, columns=["ids", "n_tokens", "decodes"])

    return run(text)
