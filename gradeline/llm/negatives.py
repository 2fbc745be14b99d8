"""Hard negatives by threshold joins: an inverted index without the dimensions that norms cover, partial scores, falling thresholds."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeline.session import checkpointed

_EVERYTHING = -(2**63)
_GROUPS = 16
_AT_ONCE = 64


@dataclass(frozen=True)
class Settings:
    """``positives`` per anchor, ``negatives`` per positive with low * p <= 100 * n <= 100 * p for their scores p and n; vectors are
    dealt into at least ``blocks`` blocks of at most about ``rows`` rows, anchors into blocks of ``anchors``. Thresholds of negatives
    fall through ``steps`` hundredths of the least positive score before they reach ``low``."""

    positives: int = 5
    negatives: int = 5
    low: int = 80
    blocks: int = 24
    rows: int = 1 << 16
    anchors: int = 256
    steps: tuple[int, ...] = (95, 90)


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, v (floor(scale * x) of every component) of the rows whose vec_id, label, vector and components are all there and finite.

    Numbers beyond a long end at its bounds. Other columns are ignored.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.where("vec_id is not null and label is not null and embedding is not null").where(finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                       F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


_INT = pa.int64()
_BLOCK = pa.schema([("block", pa.int32()), *[(c, pa.binary()) for c in ("uid", "vec_id", "label", "anchor", "v")]])


def _matrix(column: pa.ListArray, dims: int, kind: str) -> np.ndarray:
    """Vectors as rows of one array; missing last components are 0."""
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), dims), kind)
    if len(values) == out.size:
        out[:] = values.reshape(out.shape)
    else:
        places = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[np.repeat(np.arange(len(lengths)), lengths), places] = values
    return out


def _packed(dims: int, kind: str):
    """Rows sorted by block as one row a block."""
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("uid", "vec_id", "label", "anchor")]
            matrix = _matrix(batch.column("v"), dims, kind)
            for block in np.unique(blocks):
                at = blocks == block
                if block not in parts:
                    yield from (_block(b, p) for b, p in parts.items())
                    parts = {block: []}
                parts[block].append([*(c[at] for c in columns), matrix[at]])
        yield from (_block(b, p) for b, p in parts.items())

    def _block(block: int, pieces: list) -> pa.RecordBatch:
        joined = [np.concatenate(c).tobytes() for c in zip(*pieces, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *[pa.array([c], pa.binary()) for c in joined]], schema=_BLOCK)

    return pack


class Block:
    """Vectors of one block, their dimensions in the order of rising energy, and the norms of their first dimensions."""

    def __init__(self, uid: np.ndarray, vec_id: np.ndarray, label: np.ndarray, matrix: np.ndarray) -> None:
        self.uid, self.vec_id, self.label = uid, vec_id, label
        self.exact = matrix.astype(np.int64)
        values = matrix.astype(np.float64)
        self.dims = np.argsort(np.square(values).sum(0), kind="stable")
        self.values = values[:, self.dims]
        self.edges = np.unique(np.linspace(0, len(self.dims), min(_GROUPS, len(self.dims)) + 1).astype(int))
        self.norms = first_norms(self.values, self.edges)


def first_norms(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Euclidean norm of the dimensions before each edge."""
    sums = np.zeros((len(values), values.shape[1] + 1))
    np.cumsum(np.square(values), axis=1, out=sums[:, 1:])
    return np.sqrt(sums[:, edges])


def integer_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products of integer rows, in Python's integers where a long may overflow (they end at its bounds)."""
    most = max(1, float(np.abs(a.astype(np.float64)).max(initial=0))) * max(1, float(np.abs(b.astype(np.float64)).max(initial=0)))
    if most * max(1, a.shape[1]) < 2**62:
        return np.einsum("ij,ij->i", a, b)
    return np.array([min(max(sum(map(int.__mul__, x, y)), -(2**63)), 2**63 - 1) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)


def joined_above(block: Block, queries: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every query, the rows of the block whose score is at least its threshold, and their scores.

    The first dimensions of a row are left out of the index as far as their norm times any query's norm stays under the threshold:
    a row without any indexed product cannot reach it. Rows are sorted by how many dimensions are left out, so the postings of
    a dimension are the first rows. Partial scores add up over the indexed dimensions; pairs whose partial score and the norms of
    the dimensions left out cannot reach the threshold go, the others are scored in full, in integers.
    """
    values = queries.astype(np.float64)[:, block.dims]
    lengths = first_norms(values, block.edges)
    whole = lengths[:, -1]
    slack = 1e-9 * whole.max(initial=0) * block.norms[:, -1].max(initial=0) + 1e-9
    reach = np.where(least > slack, (least - slack) / np.maximum(whole, 1e-300), 0.0)
    limit = reach.min(initial=np.inf)
    left_out = np.maximum((block.norms < limit).sum(1) - 1, 0) if limit > 0 else np.zeros(len(block.uid), int)
    rows = np.argsort(left_out, kind="stable")
    counts = np.searchsorted(left_out[rows], np.arange(len(block.edges)), "right")
    reached = rows[:counts[-2]] if len(block.edges) > 1 else rows
    stored = block.values[reached]
    for a in range(0, len(queries), _AT_ONCE):
        part = values[a:a + _AT_ONCE]
        sums = np.zeros((len(part), len(reached)))
        for g in range(len(block.edges) - 2, -1, -1):
            dims, postings = slice(block.edges[g], block.edges[g + 1]), counts[g]
            sums[:, :postings] += part[:, dims] @ stored[:postings, dims].T
        skipped, bound = left_out[reached], block.norms[reached, left_out[reached]]
        for q in range(len(part)):
            alive = np.flatnonzero(sums[q] + lengths[a + q][skipped] * bound >= least[a + q] - slack)
            found = reached[alive]
            scores = np.concatenate([integer_products(np.broadcast_to(queries[a + q], (len(found[c:c + 65536]), queries.shape[1])).astype(np.int64),
                                                      block.exact[found[c:c + 65536]]) for c in range(0, max(1, len(found)), 65536)])
            enough = scores >= least[a + q]
            yield found[enough], scores[enough]


def _first(scores: np.ndarray, vec_id: np.ndarray, uid: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` best: highest score, then smallest vec_id, then row."""
    if len(scores) > count:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - count)[len(scores) - count])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((uid[at], vec_id[at], -scores[at]))[:count]]


def _block_of(row: dict, dims: int, kind: str) -> Block:
    columns = [np.frombuffer(row[c], np.int64) for c in ("uid", "vec_id", "label")]
    return Block(*columns, np.frombuffer(row["v"], kind).reshape(-1, dims))


_FOUND = "uid long, window int, score long, other_id long, other_uid long"
_FOUND_SCHEMA = pa.schema([("uid", _INT), ("window", pa.int32()), ("score", _INT), ("other_id", _INT), ("other_uid", _INT)])


def _found(parts: list[tuple]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 5
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)).cast(f.type) for c, f in zip(columns, _FOUND_SCHEMA, strict=True)], schema=_FOUND_SCHEMA)


def _best(block: Block, rows: np.ndarray, scores: np.ndarray, uid: int, window: int, count: int) -> tuple:
    at = _first(scores, block.vec_id[rows], block.uid[rows], count)
    n = len(at)
    return np.full(n, uid), np.full(n, window), scores[at], block.vec_id[rows[at]], block.uid[rows[at]]


def _at_home(dims: int, kind: str, count: int):
    """The best rows of its label in an anchor's own block: the thresholds that its search starts from."""
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block, parts = _block_of(row, dims, kind), []
                places = np.flatnonzero(np.frombuffer(row["anchor"], np.int64))
                everything = np.full(len(places), _EVERYTHING)
                for at, (rows, scores) in zip(places, joined_above(block, block.exact[places], everything), strict=True):
                    alike = (block.label[rows] == block.label[at]) & (rows != at)
                    parts.append(_best(block, rows[alike], scores[alike], block.uid[at], 0, count))
                yield _found(parts)

    return search


def _search(dims: int, kind: str, count: int, negative: bool, low: int):
    """Best rows of one block for every anchor of one anchor block: of its label, or of another label in the window of each positive."""
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for row in batch.to_pylist():
                if held is None or held[0] != row["block"]:
                    held = row["block"], _block_of(row, dims, kind)
                block, parts = held[1], []
                queries = np.frombuffer(row["a_v"], np.int64).reshape(-1, dims)
                uids, labels, least = (np.frombuffer(row[c], np.int64) for c in ("a_uid", "a_label", "a_least"))
                for uid, label, windows, (rows, scores) in zip(uids, labels, row["a_windows"], joined_above(block, queries, least), strict=True):
                    alike = block.label[rows] == label
                    if not negative:
                        alike &= block.uid[rows] != uid
                        parts.append(_best(block, rows[alike], scores[alike], uid, 0, count))
                        continue
                    rows, scores = rows[~alike], scores[~alike]
                    for k, p in enumerate(windows):
                        inside = (scores >= -(-low * p // 100)) & (scores <= p)
                        parts.append(_best(block, rows[inside], scores[inside], uid, k, count))
                yield _found(parts)

    return search


_ANCHORS = "a_uid binary, a_label binary, a_least binary, a_v binary, a_windows array<array<long>>"


def _anchor_blocks(dims: int, size: int):
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                columns = [part.column(c).to_numpy().astype(np.int64).tobytes() for c in ("uid", "label", "least")]
                columns.append(_matrix(part.column("v"), dims, "int64").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([c], pa.binary()) for c in columns], pa.array([part.column("windows").to_pylist()], pa.list_(pa.list_(_INT)))],
                    names=["a_uid", "a_label", "a_least", "a_v", "a_windows"])

    return pack


def _round(blocks: DataFrame, count: int, active: DataFrame, waiting: int, dims: int, settings: Settings,
           search: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], most: int) -> DataFrame:
    """The best rows for ``active`` anchors (uid, label, v, least, windows) over all blocks, at most ``most`` for each window."""
    packed = active.repartition(-(-waiting // (settings.anchors * 16)), "uid").sortWithinPartitions("least").mapInArrow(
        _anchor_blocks(dims, settings.anchors), _ANCHORS)
    dealt = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).repartition(count, "block")
    found = blocks.join(dealt.hint("merge"), "block").mapInArrow(search, _FOUND)
    order = Window.partitionBy("uid", "window").orderBy(F.desc("score"), "other_id", "other_uid")
    return checkpointed(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most))


def hard_negatives(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for vectors (vec_id, label, v, anchor: boolean).

    A row's score is its inner product with the anchor; higher ones come first, ties by smaller vec_id. An anchor's positives are
    its first other rows of the same label; for each of them the first rows of other labels inside its window of scores are
    returned, ranked from 1. Fewer rows where there are fewer, none where a positive score is below 0. Rows that repeat a vec_id are
    rows of their own. Shorter vectors end in zeros; an empty table gives an empty one.

    Anchors, in blocks, meet all blocks of rows. The thresholds of a search start at the best scores of an anchor's own block and
    fall, for the anchors whose windows are not full yet, until all are full or everything is searched. Each task returns at most
    as many rows per window as the result needs, so copies of one vector cannot flood it.
    """
    numbered = checkpointed(vectors.select("vec_id", "label", "v", F.coalesce("anchor", F.lit(False)).alias("anchor"),
                                           F.monotonically_increasing_id().alias("uid")))
    rows, dims, top = numbered.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)),
                                   F.max(F.greatest(F.abs(F.array_max("v").cast("double")), F.abs(F.array_min("v").cast("double"))))).first()
    dims, kind = max(1, dims), "int16" if (top or 0) < 2**15 else "int64"
    count = max(settings.blocks, -(-rows // settings.rows))
    dealt = numbered.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(count)).cast("int")).repartition(count, "block").sortWithinPartitions("block")
    blocks = checkpointed(dealt.mapInArrow(_packed(dims, kind), "block int, uid binary, vec_id binary, label binary, anchor binary, v binary")
                          .repartition(count, "block").sortWithinPartitions("block"))

    home = blocks.mapInArrow(_at_home(dims, kind, settings.positives), _FOUND)
    ladder = home.groupBy("uid").agg(F.sort_array(F.collect_list("score"), asc=False).alias("ladder"))
    empty = F.array().cast("array<bigint>")
    anchors = checkpointed(numbered.where("anchor").join(ladder, "uid", "left").select(
        "uid", "vec_id", "label", "v", F.coalesce("ladder", empty).alias("ladder"), empty.alias("windows")))

    active, positives = anchors, None
    for step in (*range(0, settings.positives, 2), None):
        waiting = active.count()
        if not waiting:
            break
        least = F.lit(_EVERYTHING) if step is None else F.coalesce(F.try_element_at("ladder", F.lit(step + 1)), F.lit(_EVERYTHING))
        tried = active.withColumn("least", least)
        found = _round(blocks, count, tried, waiting, dims, settings, _search(dims, kind, settings.positives, False, settings.low), settings.positives)
        counts = found.groupBy("uid").agg(F.count(F.lit(1)).alias("have"))
        state = checkpointed(tried.join(counts, "uid", "left").withColumn(
            "full", (F.coalesce("have", F.lit(0)) >= settings.positives) | (F.col("least") == _EVERYTHING)))
        full = found.join(state.where("full").select("uid"), "uid", "left_semi")
        positives = full if positives is None else positives.unionByName(full)
        active = state.where("not full").drop("least", "have", "full")
    if positives is None:
        positives = home.withColumn("rank", F.lit(1)).limit(0)

    listed = positives.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "other_id"))).alias("p"))
    listed = checkpointed(anchors.drop("windows").join(listed, "uid").withColumn("windows", F.col("p.score")))
    active, negatives = listed.where(F.exists("windows", lambda p: p >= 0)), None
    for step in (*[s for s in settings.steps if s > settings.low], settings.low):
        waiting = active.count()
        if not waiting:
            break
        lowest = F.array_min(F.filter("windows", lambda p: p >= 0))
        least = F.ceil(lowest.cast("decimal(38,0)") * step / 100).cast("long")
        tried = active.withColumn("least", least)
        found = _round(blocks, count, tried, waiting, dims, settings, _search(dims, kind, settings.negatives, True, settings.low), settings.negatives)
        have = found.groupBy("uid").agg(F.sum((F.col("rank") == settings.negatives).cast("int")).alias("have"))
        open_windows = F.size(F.filter("windows", lambda p: p >= 0))
        state = checkpointed(tried.join(have, "uid", "left").withColumn(
            "full", (F.coalesce("have", F.lit(0)) >= open_windows) | F.lit(step == settings.low)))
        full = found.join(state.where("full").select("uid"), "uid", "left_semi")
        negatives = full if negatives is None else negatives.unionByName(full)
        active = state.where("not full").drop("least", "have", "full")
    if negatives is None:
        negatives = home.withColumn("rank", F.lit(1)).limit(0)

    pairs = listed.select("uid", F.col("vec_id").alias("anchor_id"), F.posexplode("p").alias("window", "p"))
    return pairs.join(negatives, ["uid", "window"]).select(
        "anchor_id", F.col("p.other_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))
