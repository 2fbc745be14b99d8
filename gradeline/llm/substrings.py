"""Removal of every byte that a repeated string of a given length covers, by column-wise construction over aligned pieces of texts.

Byte strings of ``least`` bytes are too many to sort, so every string is represented by the least hashed gram inside it, which equal
strings share at the same place. Strings of one text around one such gram form a piece, all pieces are aligned at their grams, and
the collection of pieces that share a gram is built column by column from the right: each round puts one symbol in front of every
piece, orders the pieces by it without losing the order of the columns behind (the symbols read in the old order are the column's
Burrows-Wheeler transform), and updates the common prefixes of neighbours. A string is repeated when its piece shares at least
``least`` symbols with a neighbour at its column. The rounds read sequential, sorted files: Spark's shuffle files of pieces, a
bounded batch of groups at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.llm.tables import stored
from gradeline.llm.texts import flat, mixed, small_batches
from gradeline.session import checkpointed

_SEGMENT = 1 << 18
_PLACE_BITS = 20
_BASE = 0x9E3779B97F4A7C15
_ODD = np.random.default_rng(400).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Settings:
    """``least`` bytes make a repeated string; ``gram`` bytes are hashed to represent it. A group of more than ``group`` different
    pieces is split by longer common parts, and a task builds columns over about ``batch`` pieces at a time."""

    least: int = 400
    gram: int = 64
    group: int = 2048
    batch: int = 8192

    @property
    def starts(self) -> int:
        """Grams inside one string, and the most strings that one of them represents."""
        return self.least - self.gram + 1


class Anchors:
    """Representative grams of all strings of ``least`` bytes in texts that stand end to end."""

    def __init__(self, settings: Settings) -> None:
        self.settings = settings
        size = _SEGMENT + settings.least
        self.powers = np.multiply.accumulate(np.full(size, _BASE, np.uint64))
        self.back = np.multiply.accumulate(np.full(size, pow(_BASE, -1, 1 << 64), np.uint64))

    def _hashes(self, octets: np.ndarray) -> np.ndarray:
        gram = self.settings.gram
        sums = np.zeros(len(octets) + 1, np.uint64)
        np.cumsum(_ODD[octets] * self.powers[:len(octets)], out=sums[1:])
        return mixed((sums[gram:] - sums[:-gram]) * self.back[:len(octets) - gram + 1])

    def found(self, octets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Text, first and last string start in the joined bytes, gram place and gram hash of every run of strings with one gram.

        Ties of hashes go to the leftmost gram, so the choice depends on nothing but the string itself. A run may be cut in two
        where a segment ends.
        """
        least, starts = self.settings.least, self.settings.starts
        inside = np.zeros(len(octets) + 1, np.int8)
        long = np.flatnonzero(np.diff(offsets) >= least)
        np.add.at(inside, offsets[long], 1)
        np.add.at(inside, offsets[long + 1] - least + 1, -1)
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        parts = []
        for at in range(0, len(octets), _SEGMENT):
            window = octets[at:at + _SEGMENT + least - 1]
            if len(window) < least or not inside[at:at + _SEGMENT].any():
                continue
            hashes = self._hashes(window)
            low = (hashes >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(len(hashes), dtype=np.uint64)
            size = 1
            while size * 2 <= starts:
                low = np.minimum(low[:-size], low[size:])
                size *= 2
            if size < starts:
                low = np.minimum(low[:size - starts], low[starts - size:])
            places = np.flatnonzero(inside[at:at + len(low)])
            grams = (low[places] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, np.int64)
            last = np.concatenate((first[1:], [len(grams)]))[:len(first)] - 1
            parts.append((places[first] + at, places[last] + at, grams[first] + at, hashes[grams[first]].view(np.int64)))
        parts = parts or [(np.zeros(0, np.int64),) * 4]
        lo, hi, gram, value = (np.concatenate(c) for c in zip(*parts, strict=True))
        return np.searchsorted(offsets, lo, "right") - 1, lo, hi, gram, value


_ANCHORS = "gram long, d1 long, d2 long, k1 long, k2 long, lo long, before int, span int"


def _anchor_rows(settings: Settings) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(settings)
        for batch in small_batches(batches):
            octets, offsets = flat(batch.column("text"))
            row, lo, hi, gram, value = anchors.found(octets, offsets)
            data = octets.tobytes()
            digest = hashlib.blake2b
            bodies = b"".join([digest(data[a:b], digest_size=16).digest() for a, b in zip(lo.tolist(), (hi + settings.least).tolist(), strict=True)])
            digests = np.frombuffer(bodies, "<i8").reshape(-1, 2)
            keys = [batch.column(c).to_numpy()[row] for c in ("k1", "k2")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(value), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(keys[0]), pa.array(keys[1]),
                 pa.array(lo - offsets[row]), pa.array((gram - lo).astype(np.int32)), pa.array((hi - lo).astype(np.int32))],
                names=["gram", "d1", "d2", "k1", "k2", "lo", "before", "span"])

    return rows


_PIECES = "grp binary, first int, last int, k1 long, k2 long, lo long, col int, span int, n long, kinds long, body binary"
_PIECE_SCHEMA = pa.schema([("grp", pa.binary()), ("first", pa.int32()), ("last", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()),
                           ("lo", pa.int64()), ("col", pa.int32()), ("span", pa.int32()), ("n", pa.int64()), ("kinds", pa.int64()), ("body", pa.binary())])


def _piece_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size > 4 << 20:
            yield pa.RecordBatch.from_pylist([dict(zip(_PIECE_SCHEMA.names, r, strict=True)) for r in held], _PIECE_SCHEMA)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist([dict(zip(_PIECE_SCHEMA.names, r, strict=True)) for r in held], _PIECE_SCHEMA)


def _cut_pieces(settings: Settings):
    """Bodies of the wanted pieces of every text. Column 0 is the leftmost start of a string that a gram can represent."""
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for k1, k2, body, wanted in zip(*[batch.column(c).to_pylist() for c in ("k1", "k2", "body", "wanted")], strict=True):
                    for w in wanted:
                        yield (w["gram"].to_bytes(8, "little", signed=True), 0, settings.starts - 1, k1, k2, w["lo"],
                               settings.starts - 1 - w["before"], w["span"], w["n"], w["kinds"], body[w["lo"]:w["lo"] + w["span"] + settings.least])

        yield from _piece_batches(rows())

    return cut


def _halved(settings: Settings):
    """Pieces cut into their strings that start in the left and in the right half of their group's columns, named by the bytes that
    all strings of such a half have in common."""
    def halves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for group, first, last, k1, k2, lo, col, span, n, kinds, body in zip(*[batch.column(c).to_pylist() for c in _PIECE_SCHEMA.names], strict=True):
                    mid = (first + last) // 2
                    for a, b in ((first, mid), (mid + 1, last)):
                        start, stop = max(col, a), min(col + span, b)
                        if start <= stop:
                            part = body[start - col:stop - col + settings.least]
                            name = hashlib.blake2b(group + a.to_bytes(4, "little") + part[b - start:a + settings.least - start], digest_size=16)
                            yield name.digest(), a, b, k1, k2, lo + start - col, start, stop - start, n, kinds, part

        yield from _piece_batches(rows())

    return halves


def repeated_starts(group: np.ndarray, col: np.ndarray, span: np.ndarray, bodies: list[bytes], settings: Settings) -> np.ndarray:
    """For each piece (groups end to end) and column, whether the string that starts there stands in another piece of the group.

    Columns go from the last to the first. ``order`` holds the pieces sorted by group and by what stands in the columns from the
    current one on; ``common[i]`` is how many symbols the i-th shares with the one before it. A stable sort by the new symbol
    keeps the order of the rest; where two pieces become neighbours, they share one symbol more than the least of all between them.
    """
    least, count, width = settings.least, len(bodies), settings.starts - 1 + settings.least
    lengths = np.fromiter(map(len, bodies), np.int64, count)
    symbols = np.zeros((width, count), np.int16)  # 0 where a piece has no symbol
    ends = np.cumsum(lengths)
    columns = np.arange(ends[-1]) - np.repeat(ends - lengths - col, lengths)
    symbols[columns, np.repeat(np.arange(count), lengths)] = np.frombuffer(b"".join(bodies), np.uint8).astype(np.int16) + 1
    base = (np.cumsum(np.concatenate(([0], group[1:] != group[:-1]))) * 512).astype(np.int32)
    order, common = np.arange(count), np.zeros(count + 1, np.int32)
    marks = np.zeros((settings.starts, count), bool)
    for j in range(width - 1, -1, -1):
        symbol = base[order] + symbols[j][order]
        moved = np.argsort(symbol, kind="stable")
        order, symbol = order[moved], symbol[moved]
        alike = np.flatnonzero((symbol[1:] == symbol[:-1]) & ((symbol[1:] & 511) > 0)) + 1
        left, right = moved[alike - 1], moved[alike]
        shared = common[right]
        apart = np.flatnonzero(right != left + 1)
        if len(apart):
            cuts = np.empty(2 * len(apart), np.int64)
            cuts[::2], cuts[1::2] = left[apart] + 1, right[apart] + 1
            shared[apart] = np.minimum.reduceat(common, cuts)[::2]
        common = np.zeros(count + 1, np.int32)
        common[alike] = shared + 1
        if j < settings.starts:
            marks[j, order] = np.maximum(common[:-1], common[1:]) >= least
    places = np.arange(settings.starts)[:, None]
    return marks & (places >= col) & (places <= col + span)


def _columnwise(settings: Settings):
    """Spans of repeated strings in the pieces of whole groups, which arrive sorted by group."""
    def spans(held: list[tuple]) -> pa.RecordBatch:
        names = {}
        group = np.array([names.setdefault(r[0], len(names)) for r in held])
        k1, k2, lo, n = (np.array([r[c] for r in held], np.int64) for c in (3, 4, 5, 8))
        col, span = (np.array([r[c] for r in held], np.int64) for c in (6, 7))
        marks = repeated_starts(group, col, span, [r[10] for r in held], settings)
        marks[:, n > 1] = False  # known to be repeated as a whole
        edges = np.diff(np.pad(marks.T.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        piece, first = np.nonzero(edges == 1)
        _, after = np.nonzero(edges == -1)
        start = lo[piece] + first - col[piece]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (k1[piece], k2[piece], start, start + (after - first) - 1 + settings.least)],
                                          names=["k1", "k2", "start", "stop"])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in _PIECE_SCHEMA.names], strict=True):
                if len(held) >= settings.batch and row[0] != held[-1][0]:
                    yield spans(held)
                    held = []
                held.append(row)
        if held:
            yield spans(held)

    return rows


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal removed runs of every text and the bytes that stay."""
    for batch in batches:
        keys, spans, kept = ([], []), [], []
        for k1, k2, body, found in zip(*[batch.column(c).to_pylist() for c in ("k1", "k2", "body", "found")], strict=True):
            runs: list[list[int]] = []
            for s in sorted((s["start"], s["stop"]) for s in found):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append(list(s))
            edges = [0, *[e for r in runs for e in r], len(body)]
            keys[0].append(k1)
            keys[1].append(k2)
            spans.append([{"start": a, "stop": b} for a, b in runs])
            kept.append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[0], pa.int64()), pa.array(keys[1], pa.int64()),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())],
            names=["k1", "k2", "spans", "kept"])


def _half(digest: Column | str, at: int) -> Column:
    return F.conv(F.substring(digest, at, 16), 16, -10).cast("long")


def _keyed(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """``text_sha256`` of the whole text and its first two 64-bit words, which name the text from here on."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*columns, text.alias("text"), F.sha2(text, 256).alias("text_sha256")).withColumns(
        {"k1": _half("text_sha256", 1), "k2": _half("text_sha256", 17)})


def _spans(rows: DataFrame, least: int) -> DataFrame:
    return rows.select("k1", "k2", F.col("lo").alias("start"), (F.col("lo") + F.col("span") + least).alias("stop"))


def repeated_spans(docs: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Spans (k1, k2, start, stop) that repeated strings cover, and the distinct texts (k1, k2, body) that may hold any.

    Grams that stand once are dropped before any text moves. Of a gram's pieces, those equal as a whole are repeated as a whole;
    only where other pieces remain, one of each kind is cut from its text and built into columns. Groups with more than
    ``settings.group`` kinds are split by the left and right half of their strings, named by longer common parts, until they are
    small or one string wide, so no task meets a whole hot group.
    """
    least = settings.least
    texts = _keyed(docs.select("text")).where(F.octet_length("text") >= least)
    anchors = stored(texts.select("text", "k1", "k2").mapInArrow(_anchor_rows(settings), _ANCHORS), "anchors")
    several = (F.min("d1") != F.max("d1")) | (F.min("d2") != F.max("d2"))
    # Written, not only summed: joins of two plain shuffles are the ones that adaptive execution splits at a hot gram.
    grams = stored(anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("total"), several.alias("several")).where("total > 1"), "grams")
    shared = stored(anchors.join(grams.select("gram", "several"), "gram"), "shared")
    holders = shared.select("k1", "k2").distinct()
    bodies = stored(texts.select("k1", "k2", F.col("text").cast("binary").alias("body")).groupBy("k1", "k2").agg(
        F.first("body").alias("body")).join(holders, ["k1", "k2"], "left_semi"), "bodies")

    whole = _spans(shared.where("not several"), least)
    unlike = shared.where("several")
    place = F.struct("k1", "k2", "lo", "before", "span")
    kinds = stored(unlike.groupBy("gram", "d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at")), "kinds")
    copies = kinds.where("n > 1").select("gram", "d1", "d2")
    whole = whole.unionByName(_spans(unlike.join(copies, ["gram", "d1", "d2"], "left_semi"), least))
    open_grams = kinds.groupBy("gram").agg(F.min("n").alias("fewest"), F.count(F.lit(1)).alias("kinds")).where("fewest = 1 and kinds > 1")
    wanted = kinds.join(open_grams.select("gram", "kinds"), "gram").select("gram", "n", "kinds", "at.*")
    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "n", "kinds", "lo", "before", "span")).alias("wanted"))
    pieces = checkpointed(bodies.join(lists, ["k1", "k2"]).mapInArrow(_cut_pieces(settings), _PIECES))
    built, split = pieces.where(F.col("kinds") <= settings.group), pieces.where(F.col("kinds") > settings.group)
    while not split.isEmpty():
        halves = checkpointed(split.mapInArrow(_halved(settings), _PIECES).withColumn("kind", F.unhex(F.sha2("body", 256))))
        kinds = checkpointed(halves.groupBy("grp", "kind").agg(
            F.sum("n").alias("n"), F.first(F.struct("first", "last", "k1", "k2", "lo", "col", "span", "body")).alias("at")))
        again = kinds.where("n > 1").select("grp", "kind")
        whole = whole.unionByName(_spans(halves.where("n = 1").join(again, ["grp", "kind"], "left_semi"), least))
        groups = kinds.groupBy("grp").agg(F.min("n").alias("fewest"), F.count(F.lit(1)).alias("kinds")).where("fewest = 1 and kinds > 1")
        left = checkpointed(kinds.join(groups.drop("fewest"), "grp").select(
            "grp", "at.first", "at.last", "at.k1", "at.k2", "at.lo", "at.col", "at.span", "n", "kinds", "at.body"))
        built = built.unionByName(left.where(F.col("kinds") <= settings.group))
        split = left.where(F.col("kinds") > settings.group)
    columns = built.repartition("grp").sortWithinPartitions("grp").mapInArrow(_columnwise(settings), "k1 long, k2 long, start long, stop long")
    return whole.unionByName(columns), bodies


def without_repeats(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, text_sha256, n_bytes, spans, kept for every row of ``docs`` (doc_id, text; other columns are ignored).

    ``spans`` are the maximal runs of bytes (start, stop; UTF-8, end exclusive) that a string of ``settings.least`` bytes covers
    which also starts anywhere else, in any row or at another place of the same text; overlaps count, and strings are judged on
    the input. ``kept`` holds the other bytes, which may cut characters in two, and is null where nothing goes. Null counts as
    empty; repeated rows are copies of each other, with or without equal doc_id. An empty table gives an empty one.
    """
    spans, bodies = repeated_spans(docs, settings)
    found = spans.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    cut = bodies.join(found, ["k1", "k2"]).mapInArrow(_merged, "k1 long, k2 long, spans array<struct<start: long, stop: long>>, kept binary")
    rows = _keyed(docs.select("doc_id", "text"), "doc_id").select(
        "doc_id", "text_sha256", F.octet_length("text").cast("long").alias("n_bytes"), "k1", "k2")
    none = F.array().cast("array<struct<start: bigint, stop: bigint>>")
    return rows.join(checkpointed(cut), ["k1", "k2"], "left").select(
        "doc_id", "text_sha256", "n_bytes", F.coalesce("spans", none).alias("spans"), "kept")
