"""Best-fit packing of tokenised documents into fixed-length sequences, with a bounded number of open bins."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeline.llm import texts
from gradeline.session import checkpointed

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LENGTH, END_ID, OPEN_BINS, PIECES_PER_TASK, CACHED = 2048, 0, 2048, 250_000, 500_000
#: A special token of the tokenizer, and how many words stand between such tokens in one call.
BETWEEN, RUN = "<|endoftext|>", 256

_MARKS = re.compile("[\u0300-\u036f]").search
_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
#: Characters that str.split() takes for spaces too, or that some Unicode versions do.
_OTHER_SPACES = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]").search


def _split(text: str) -> list[str]:
    """Words of a text, A-Z in lower case where the tokenizer would lower them alike: not before a combining mark, which joins
    some small letters only, and not in a special token."""
    if not (_MARKS(text) or "<|" in text):
        text = text.encode().lower().decode()
    return _WORDS(text) if _OTHER_SPACES(text) else text.split()


class _Known(dict):
    """Ids of the first words met, up to a bound, and of the other words of the batch at hand."""

    def __init__(self):
        super().__init__()
        self.batch: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        return self.batch[word]


class WordIds:
    """Ids of words by a tokenizer that drops white space, so that a text's ids are its words' ids end to end.

    Frequent words come early and stay; beyond the bound, words are kept for one batch. Results do not depend on it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.between = self.tokenizer.token_to_id(BETWEEN)
        self.known = _Known()

    def _encoded(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words, many in one call: the tokenizer takes a special token out before anything else, so what stands between two
        is encoded as if alone. Words that may hold a special token are encoded one by one."""
        alone = [word for word in words if "<|" in word]
        plain = [word for word in words if "<|" not in word] if alone else words
        found = {word: np.array(own.ids, "<u4").tobytes() for word, own in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True)}
        runs = [plain[k:k + RUN] for k in range(0, len(plain), RUN)]
        for run, own in zip(runs, self.tokenizer.encode_batch_fast([BETWEEN.join(run) for run in runs], add_special_tokens=False), strict=True):
            ids = np.array(own.ids, "<u4")
            ends = (4 * np.flatnonzero(ids == self.between)).tolist()
            data = ids.tobytes()
            found.update(zip(run, [data[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(data)], strict=True)], strict=True))
        return found

    def of(self, rows: list[str | None]) -> list[bytes]:
        """32-bit ids of every text, the end id last."""
        words, known = [_split(text) if text else [] for text in rows], self.known
        missing = [word for word in set().union(*words) if word not in known]
        # A stop after a letter is a token run of its own, so most words with one need not be encoded again. Not so after a letter
        # whose small form ends in a combining mark, which joins the stop.
        stems = {word: word[:-1] if word[-1] in ".," and word[-2:-1].lower().isalpha() else word for word in missing}
        wanted = [stem for stem in {*stems.values(), ".", ","} if stem not in known]
        known.batch = self._encoded(wanted)
        known.batch |= {word: known[stem] + known[word[-1]] for word, stem in stems.items() if word != stem}
        if len(known) + len(known.batch) <= CACHED:
            known.update(known.batch)
        end = np.array([END_ID], "<u4").tobytes()
        return [b"".join(map(known.__getitem__, row)) + end for row in words]


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    """One tokenizer for each Python worker."""
    return WordIds(path)


def pieces(docs: DataFrame, path: str = TOKENIZER, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) for every piece of at most ``length`` tokens of every row of ``docs``.

    A row's tokens are its words' ids and the end id; a null or empty text is the end id alone. Only rows with more than
    ``length`` tokens are cut. The order of tokens is kept, repeated rows repeat, other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_ids(path)
        for batch in texts.small_batches(batches, limit=1 << 20):
            at, piece, start, sizes, sums, ids = [], [], [], [], [], []
            for row, data in enumerate(own.of(batch.column("text").to_pylist())):
                for k, first in enumerate(range(0, len(data), 4 * length)):
                    part = data[first:first + 4 * length]
                    at.append(row)
                    piece.append(k)
                    start.append(first // 4)
                    sizes.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    ids.append(part)
            columns = [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                ends = pa.array(np.cumsum([0, *sizes]), pa.int32())
                columns.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else ""))


class OpenBins:
    """At most ``most`` open bins: a bitset marks the amounts of free space that some open bin has."""

    def __init__(self, length: int, most: int):
        self.length, self.most, self.open, self.made = length, most, 0, 0
        self.free: list[list[int]] = [[] for _ in range(length + 1)]
        self.present = 0

    def _take(self, space: int) -> int:
        own = self.free[space].pop()
        if not self.free[space]:
            self.present &= ~(1 << space)
        self.open -= 1
        return own

    def place(self, size: int) -> tuple[int, int]:
        """Bin and offset for an item: the open bin with least room that holds it, else a new one; a full or surplus bin closes."""
        fitting = self.present >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            own = self._take(space)
        else:
            own, space = self.made, self.length
            self.made += 1
        rest = space - size
        if rest:
            self.free[rest].append(own)
            self.present |= 1 << rest
            self.open += 1
            if self.open > self.most:  # the fullest closes first
                self._take((self.present & -self.present).bit_length() - 1)
        return own, self.length - space


def in_rounds(sizes: np.ndarray, most: int) -> np.ndarray:
    """Places of ``sizes`` in rounds of ``most`` in the order given, each round in falling size."""
    return np.lexsort((-sizes, np.arange(len(sizes)) // most))


def packed(items: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    """``items`` (a ``length`` column from 1 to ``length``, any others) with sequence_id and offset.

    Items are stored, dealt over tasks of about ``PIECES_PER_TASK`` by an even hash, and come in hashed order, so that short items
    meet open bins all along. Only rounds of as many items as bins may be open are put in falling length: one round cannot shut
    out the short items of the next, as a whole task in that order would. A task ends with a few sequences that are not full.
    Offsets in a sequence are gapless from 0. Numbers of sequences are unique, not gapless. Empty input gives an empty table.
    """
    stored = checkpointed(items.withColumn("__item", F.monotonically_increasing_id()))
    tasks, names = max(1, -(-stored.count() // PIECES_PER_TASK)), list(items.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(length, open_bins)
        for batch in batches:
            batch = batch.take(pa.array(in_rounds(batch.column("length").to_numpy(), open_bins)))
            places = [bins.place(size) for size in batch.column("length").to_pylist()]
            columns = [batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, batch.column("__base"), pa.array([p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], pa.int64())],
                [*names, "__base", "__bin", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    dealt = stored.repartition(tasks, "__item").sortWithinPartitions(F.xxhash64("__item"), "__item")
    dealt = dealt.withColumn("__base", F.spark_partition_id().cast("long")).drop("__item")
    done = dealt.mapInArrow(run, f"{schema}, __base bigint, __bin bigint, offset bigint")
    return done.select(*names, (F.shiftleft("__base", 33) + F.col("__bin")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str = TOKENIZER, length: int = LENGTH) -> DataFrame:
    """Every piece of every row of ``docs`` with its place in a sequence; see ``pieces`` and ``packed``."""
    return packed(pieces(docs, path, length), length)
