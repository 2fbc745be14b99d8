"""Near-duplicate groups: b-bit MinHash signatures, band candidates, bit-count estimates, and links confirmed on full sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.llm import texts
from gradeline.llm.components import connected
from gradeline.session import checkpointed


@dataclass(frozen=True)
class Settings:
    """What is a link, and how candidates are found.

    A pair of similarity ``num / den`` misses every band with probability (1 - s**rows)**bands, 5e-8 for the defaults;
    the estimate then drops a pair only when it lies ``sigmas`` standard deviations under the limit.
    """

    words: int = 5
    num: int = 80
    den: int = 100
    bands: int = 32
    rows: int = 4
    bits: int = 4
    sigmas: float = 5.0
    block: int = 1024

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    @property
    def least_matches(self) -> int:
        """Fewest equal low-bit groups of a pair at the limit: chance matches raise the expectation to s + (1 - s) / 2**bits."""
        s = self.num / self.den
        p = s + (1 - s) / 2**self.bits
        return max(0, math.floor(self.minima * p - self.sigmas * math.sqrt(self.minima * p * (1 - p))))


def shingle_sets(octets: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The distinct word shingles of every row as sorted hashes; a row of fewer words has one, a row without words none."""
    octets = texts.lowered(octets)
    starts, ends, rows = texts.word_spans(octets, offsets)
    hashes = texts.span_hashes(octets, starts, ends)
    runs = texts.sequence_hashes(hashes, words)
    bounds = np.searchsorted(rows, np.arange(len(offsets)))
    sets = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= words:
            sets.append(np.unique(runs[a:b - words + 1]))
        else:
            sets.append(texts.sequence_hashes(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return sets


def minima_of(sets: list[np.ndarray], count: int) -> np.ndarray:
    """``count`` MinHash minima for each non-empty set, by multiply-add permutations of 32-bit values."""
    draw = np.random.default_rng(99)
    factors = draw.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = draw.integers(0, 1 << 32, count, dtype=np.uint32)
    out = np.empty((len(sets), count), np.uint32)
    done = 0
    while done < len(sets):
        stop, size = done, 0
        while stop < len(sets) and (stop == done or size + len(sets[stop]) <= 32768):
            size += len(sets[stop])
            stop += 1
        values = (np.concatenate(sets[done:stop]) >> np.uint64(32)).astype(np.uint32)
        heads = np.cumsum([0, *map(len, sets[done:stop - 1])])
        work = np.empty_like(values)
        for k in range(count):
            np.multiply(values, factors[k], out=work)
            np.add(work, shifts[k], out=work)
            out[done:stop, k] = np.minimum.reduceat(work, heads)
        done = stop
    return out


def packed(minima: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of every minimum, packed into 64-bit words."""
    scrambled = (minima * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)
    groups = scrambled.reshape(len(minima), minima.shape[1] * bits // 64, 64 // bits).astype(np.uint64)
    return np.bitwise_or.reduce(groups << (np.arange(64 // bits, dtype=np.uint64) * np.uint64(bits)), axis=2)


def band_keys(minima: np.ndarray, bands: int) -> np.ndarray:
    keys = np.zeros((len(minima), bands), np.uint64)
    parts = minima.reshape(len(minima), bands, minima.shape[1] // bands).astype(np.uint64)
    for k in range(parts.shape[2]):
        keys = texts.mixed(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k] + np.arange(1, bands + 1, dtype=np.uint64))
    return keys


def _signer(s: Settings):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.small_batches(batches):
            sets = shingle_sets(*texts.flat(batch.column("text")), s.words)
            full = [x for x in sets if len(x)]
            minima = minima_of(full, s.minima)
            sigs, bands = iter(packed(minima, s.bits).view(np.int64).tolist()), iter(band_keys(minima, s.bands).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("text_key"), pa.array([len(x) for x in sets], pa.int64()),
                pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets], pa.binary()),
                pa.array([next(sigs) if len(x) else None for x in sets], pa.list_(pa.int64())),
                pa.array([next(bands) if len(x) else None for x in sets], pa.list_(pa.int64())),
            ], ["doc_id", "text_key", "n_shingles", "digest", "sig", "bands"])

    return sign


def _set_builder(words: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.small_batches(batches):
            sets = shingle_sets(*texts.flat(batch.column("text")), words)
            digests = batch.column("digest").to_pylist()
            own = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() == d for x, d in zip(sets, digests, strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column("cid").filter(pa.array(own)),
                pa.array([x.tobytes() for x, mine in zip(sets, own, strict=True) if mine], pa.binary())], ["cid", "members"])

    return build


def _confirmer(s: Settings):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
                a, b = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(s.den * common >= s.num * (len(a) + len(b) - common))
            mask = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(mask), batch.column("y").filter(mask)], ["x", "y"])

    return confirm


def matches(left: str, right: str, s: Settings) -> Column:
    """Equal low-bit groups of two packed signatures, by bit counts."""
    ones = sum(1 << k for k in range(0, 64, s.bits))
    ones = ones - (1 << 64) if ones >> 63 else ones

    def unequal(x: Column) -> Column:
        folded = x
        for k in range(1, s.bits):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, k))
        return F.bit_count(folded.bitwiseAND(F.lit(ones)))

    words = s.minima * s.bits // 64
    parts = [unequal(F.col(left)[k].bitwiseXOR(F.col(right)[k])) for k in range(words)]
    return F.lit(s.minima) - sum(parts[1:], parts[0])


def _unequal_groups(x: np.ndarray, bits: int) -> np.ndarray:
    folded = x.copy()
    for k in range(1, bits):
        folded |= x >> np.uint64(k)
    return np.bitwise_count(folded & np.uint64(sum(1 << k for k in range(0, 64, bits)))).sum(axis=-1)


def _crossing(s: Settings):
    """Links of one bucket block pair that join different components: estimates first, then full sets, and a spanning tree goes out.

    All pairs are looked at, but a pair whose ends are joined already needs no second path, so fewer links than classes leave.
    """
    least = s.least_matches

    def links(key: tuple, group: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        own, ids, labels = (group.column(c).to_numpy() for c in ("own", "cid", "root"))
        labels = labels.copy()
        sig = group.column("sig").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(ids), -1)
        sets = [np.frombuffer(m.as_buffer(), np.uint64) for m in group.column("members").combine_chunks()]
        sizes = np.array([len(m) for m in sets])
        values = np.unique(np.concatenate(sets), return_inverse=True)[1]
        holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(values, kind="stable")]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(values))])
        heads = np.concatenate([[0], np.cumsum(sizes)])
        second, xs, ys = own == j, [], []
        for k in np.flatnonzero(own == i):
            at = np.flatnonzero(second & (labels != labels[k]))
            at = at[s.minima - _unequal_groups(sig[at] ^ sig[k], s.bits) >= least]
            if not len(at):
                continue
            found = [holders[bounds[v]:bounds[v + 1]] for v in values[heads[k]:heads[k + 1]]]
            common = np.bincount(np.concatenate(found), minlength=len(sets))[at]
            for m in at[s.den * common >= s.num * (sizes[k] + sizes[at] - common)]:
                if labels[m] != labels[k]:
                    labels[labels == labels[m]] = labels[k]
                    xs.append(max(ids[k], ids[m]))
                    ys.append(min(ids[k], ids[m]))
        return pa.table({"x": pa.array(xs, pa.int64()), "y": pa.array(ys, pa.int64())})

    return links


def text_key() -> Column:
    """A second key beside doc_id, so that rows of one id and different texts stay apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def near_groups(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text; other columns are ignored).

    Texts of one shingle set form a class, so copies are compared once. Classes that share a band meet their bucket's
    first and last class; confirmed links form components. Only members of different components of a bucket are then compared
    further, all of them, in blocks of ``block`` classes with their full sets, so a bucket never stands in one task, no pair is
    lost, and only links that join something leave a task.
    A null or empty text has no shingles and stands alone. Rows of one doc_id and text share a class and its result; a
    null doc_id never names a component unless all its members lack one. Empty input gives an empty table.
    """
    s = settings
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    keyed = docs.withColumn("text_key", text_key())
    signed = checkpointed(keyed.mapInArrow(
        _signer(s), f"doc_id {kind}, text_key bigint, n_shingles bigint, digest binary, sig array<bigint>, bands array<bigint>"))
    classes = signed.where("n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("first_id"), F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands"))
    classes = checkpointed(classes.select(F.monotonically_increasing_id().alias("cid"), "*"))
    sigs = classes.select("cid", "sig")

    slots = classes.select("cid", F.explode("bands").alias("band"))
    shared = slots.groupBy("band").agg(
        F.min("cid").alias("head"), F.max("cid").alias("tail"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = checkpointed(slots.join(shared, "band"))

    wanted = members.select("cid").distinct().join(classes.select("cid", "digest", "first_id"), "cid")
    sets = checkpointed(
        docs.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
        .join(wanted.withColumn("key", F.coalesce(F.col("first_id").cast("string"), F.lit(""))).drop("first_id"), "key")
        .select("cid", "digest", "text").mapInArrow(_set_builder(s.words), "cid bigint, members binary")
        .dropDuplicates(["cid"]))

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("cid").alias("x"), F.col("members").alias("left"))
        right = sets.select(F.col("cid").alias("y"), F.col("members").alias("right"))
        return pairs.join(left, "x").join(right, "y").mapInArrow(_confirmer(s), "x bigint, y bigint")

    def estimated(pairs: DataFrame) -> DataFrame:
        left, right = sigs.toDF("x", "left_sig"), sigs.toDF("y", "right_sig")
        both = pairs.join(left, "x").join(right, "y")
        return both.where(matches("left_sig", "right_sig", s) >= s.least_matches).select("x", "y")

    # First every class with the first and last class of its buckets, then what a bucket still holds in different components.
    ends = members.select("cid", F.explode(F.array("head", "tail")).alias("end")).where("cid <> end")
    stars = ends.select(F.greatest("cid", "end").alias("x"), F.least("cid", "end").alias("y")).distinct()
    links = checkpointed(confirmed(estimated(stars)))
    roots = checkpointed(connected(links))

    placed = members.where("size > 3 and cid <> head and cid <> tail").select("band", "cid", "size").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn(
        "root", F.coalesce("root", "cid"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    blocks = F.ceil(F.col("size") / s.block).cast("int")
    own = F.pmod(F.xxhash64("cid"), blocks).cast("int")
    open_members = placed.join(mixed, "band").withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "band", "cid", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    more = open_members.join(sigs, "cid").join(sets, "cid").groupBy("band", "i", "j").applyInArrow(_crossing(s), "x bigint, y bigint")
    roots = checkpointed(connected(checkpointed(links.unionByName(more.distinct()))))

    named = classes.select("cid", "digest", "first_id").join(
        roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    firsts = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = named.join(firsts, "root").select("digest", "component_id")
    rows = signed.select("doc_id", "text_key", "n_shingles", "digest").join(labels, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "text_key", "n_shingles", component.alias("component_id"),
                       F.col("doc_id").eqNullSafe(component).alias("kept"))


def without_near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that ``near_groups`` keeps, with all their columns: one document of each group, and all empty ones."""
    gone = near_groups(docs, settings).where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (text_key() == gone["__gone"]), "left_anti")
