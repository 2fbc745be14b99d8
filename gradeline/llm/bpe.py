"""Byte-level BPE as a tree reduction: halves are encoded apart and joined by re-encoding a growing window at the seam."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gradeline.llm import texts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXT_LEAF, ID_LEAF, CACHED = 16_384, 4096, 300_000


class Codec:
    """Encoder and decoder for one rank file; ``pattern`` splits a text into pieces that are merged separately."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        lengths = np.zeros(max(self.tokens) + 1, np.int64)
        for rank, token in self.tokens.items():
            lengths[rank] = len(token)
        self.lengths, self.places = lengths, np.cumsum(lengths) - lengths
        self.octets = np.frombuffer(b"".join(self.tokens[rank] for rank in sorted(self.tokens)), np.uint8)
        self.pieces_of = regex.compile(pattern).findall
        self.agree = lru_cache(1 << 17)(self._agree)
        # Bounded stores of what recurs: encodings of short halves and of seams. Results do not depend on them.
        self.short = lru_cache(1 << 17)(self._halved)
        self.seam = lru_cache(1 << 17)(self.merged)
        self.known = _Pieces(self)

    def merged(self, data: bytes) -> list[int]:
        """Ids of a short byte string: the pair of lowest rank merges first, the leftmost of equals."""
        ranks, parts = self.ranks, [data[k:k + 1] for k in range(len(data))]
        pairs = [ranks.get(a + b, 1 << 31) for a, b in zip(parts, parts[1:])]
        while pairs:
            low = min(pairs)
            if low == 1 << 31:
                break
            k = pairs.index(low)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k < len(pairs):
                pairs[k] = ranks.get(parts[k] + parts[k + 1], 1 << 31)
            if k:
                pairs[k - 1] = ranks.get(parts[k - 1] + parts[k], 1 << 31)
        return [ranks[part] for part in parts]

    def _agree(self, left: int, right: int) -> bool:
        """Two tokens may stand next to each other: merging their bytes gives them back."""
        return self.merged(self.tokens[left] + self.tokens[right]) == [left, right]

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of one piece of any length. A row of tokens is the encoding exactly when all its neighbours agree."""
        return self.short(data) if len(data) <= 8 else self._halved(data)

    def _halved(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data) if len(data) <= 2 else None
        if len(data) <= 1 or whole is not None:
            return [self.ranks[data]] if data else []
        half = len(data) // 2
        return self.joined(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """Join two encodings: re-encode tokens at the seam, growing a side until its outer neighbour agrees."""
        if self.agree(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            seam = self.seam(b"".join([self.tokens[t] for t in left[len(left) - i:] + right[:j]]))
            settled_left = i == len(left) or self.agree(left[-i - 1], seam[0])
            settled_right = j == len(right) or self.agree(seam[-1], right[j])
            if settled_left and settled_right:
                return left[:len(left) - i] + seam + right[j:]
            i, j = (i if settled_left else i + 1), (j if settled_right else j + 1)

    def pieces(self, text: str) -> list[str]:
        """The pattern's matches over a text of any length, from halves.

        No match holds a white-space character after another one, so a match always starts between the two; matches outside the
        nearest such places on both sides of a cut cannot change, and what lies between is matched again.
        """
        if len(text) <= TEXT_LEAF:
            return self.pieces_of(text)
        left, right = self.pieces(text[:len(text) // 2]), self.pieces(text[len(text) // 2:])
        i, j = len(left), 0
        while i:
            i -= 1
            if i and left[i][0].isspace() and not left[i - 1][-1].isspace():
                break
        while j < len(right):
            j += 1
            if j < len(right) and right[j][0].isspace() and not right[j - 1][-1].isspace():
                break
        return left[:i] + self.pieces_of("".join(left[i:] + right[:j])) + right[j:]

    def encode(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers end to end."""
        return b"".join(map(self.known.__getitem__, self.pieces(text)))

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids, concatenated up the tree; a leaf's bytes are gathered from one array of all tokens."""
        if len(ids) <= ID_LEAF:
            lengths = self.lengths[ids]
            first = np.cumsum(lengths) - lengths
            return self.octets[np.arange(lengths.sum()) + np.repeat(self.places[ids] - first, lengths)].tobytes()
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class _Pieces(dict):
    """Encodings of pieces seen lately; starts anew when full, so memory is bounded and results do not depend on it."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        data, codec = piece.encode(), self.codec
        whole = codec.ranks.get(data)
        found = np.array([whole] if whole is not None else codec.encode_bytes(data), np.int32).tobytes()
        if len(self) >= CACHED:
            self.clear()
        if len(piece) <= 64:
            self[piece] = found
        return found


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each Python worker."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids array<int> for every row of ``docs`` (doc_id, text; other columns are ignored); a null or empty text has no ids.

    ``path`` names the rank file on the workers. Rows are independent: nothing is shuffled, repeated rows repeat.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in texts.small_batches(batches):
            rows = [own.encode(text or "") for text in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *(len(row) // 4 for row in rows)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids and the decoded bytes as ``data`` binary; null ids decode to nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lengths = part.column("ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                ids = part.column("ids").flatten().to_numpy(zero_copy_only=False)
                data = [own.decode(row) for row in np.split(ids, np.cumsum(lengths)[:-1])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(data, pa.binary())], ["doc_id", "ids", "data"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, data binary")
