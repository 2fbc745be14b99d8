"""Quality rules: hard limits, and an isolation forest on rule statistics whose threshold comes from labelled rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeline.llm import texts
from gradeline.llm.ranks import lowest_hashed
from gradeline.session import checkpointed

#: What counts as a symbol, and the limits of the hard rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 10, 20, 5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_stops")


@dataclass(frozen=True)
class Settings:
    """Forest size, and the share of rows labelled good that the threshold may lose at most.

    ``sample`` bounds the rows that trees are grown on; counts, usual ranges, scores and the threshold use all rows.
    """

    trees: int = 100
    per_tree: int = 256
    sample: int = 20_000
    lost_good: float = 0.005
    bins: int = 1000
    reach: float = 10.0
    seed: int = 5


def _lookup(chars: str | bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode() if isinstance(chars, str) else chars)] = True
    return table


_IS_SYMBOL, _IS_UPPER = _lookup(SYMBOLS), _lookup(bytes(range(ord("A"), ord("Z") + 1)))
_IS_DIGIT, _IS_STOP = _lookup("0123456789"), _lookup(".,;:!?")


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeats(keys: np.ndarray) -> np.ndarray:
    """How often every key occurs."""
    _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[back]


def rule_counts(octets: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of ``COUNTS`` for every row of a batch of texts."""
    n = len(offsets) - 1
    starts, ends, rows = texts.word_spans(octets, offsets)
    salt = texts.mixed(np.arange(n, dtype=np.uint64) + np.uint64(11))
    hashes = texts.span_hashes(octets, starts, ends)
    out = {"n_words": np.bincount(rows, minlength=n)}
    covered = np.zeros(len(octets) + 1, np.int32)
    covered[starts] += 1
    covered[ends] -= 1  # words never touch, so no place is both
    inside = np.cumsum(covered[:-1]) > 0
    out["word_chars"] = _per_row(inside & texts.starts_of_points(octets), offsets)
    for name, table in (("n_symbols", _IS_SYMBOL), ("n_upper", _IS_UPPER), ("n_digits", _IS_DIGIT), ("n_stops", _IS_STOP)):
        out[name] = _per_row(table[octets], offsets)

    # Lines with a word, keyed by their whole bytes and row.
    breaks = np.flatnonzero(octets == 10)
    heads = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    heads = heads[heads < len(octets)]
    tails = np.searchsorted(breaks, heads)
    tails = np.where(tails < len(breaks), breaks[np.minimum(tails, len(breaks) - 1)] if len(breaks) else 0, len(octets))
    line_rows = np.searchsorted(offsets, heads, "right") - 1
    tails = np.minimum(tails, offsets[line_rows + 1])
    words_before = np.concatenate([[0], np.cumsum(inside)])
    worded = words_before[tails] > words_before[heads]
    heads, tails, line_rows = heads[worded], tails[worded], line_rows[worded]
    keys = texts.mixed(texts.span_hashes(octets, heads, tails) + salt[line_rows])
    firsts = np.unique(keys, return_index=True)[1]
    out["n_dup_lines"] = np.bincount(line_rows, minlength=n) - np.bincount(line_rows[firsts], minlength=n)

    # Windows of five words of one row that occur twice or more cover words.
    covers = np.zeros(len(hashes) + 1, np.int32)
    runs = texts.sequence_hashes(hashes, WINDOW)
    if len(runs):
        valid = np.flatnonzero(rows[: len(runs)] == rows[WINDOW - 1:])
        again = valid[_repeats(texts.mixed(runs[valid] + salt[rows[valid]])) > 1]
        np.add.at(covers, again, 1)
        np.subtract.at(covers, again + WINDOW, 1)
    out["n_repeat_words"] = np.bincount(rows[np.cumsum(covers[:-1]) > 0], minlength=n)
    return out


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the rule counts for every row of ``docs`` (doc_id, text); a null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.small_batches(batches):
            found = rule_counts(*texts.flat(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(found[c], pa.int64()) for c in COUNTS)], ["doc_id", *COUNTS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS))


def ratios(columns: dict[str, np.ndarray]) -> np.ndarray:
    """One row of rule statistics for each document; ten more words in a divisor keep short texts from extreme ratios."""
    c = {k: np.asarray(v, float) for k, v in columns.items()}
    words, chars = c["n_words"] + 10, c["word_chars"] + 40
    return np.column_stack([c["word_chars"] / words, c["n_symbols"] / words, c["n_repeat_words"] / words,
                            c["n_upper"] / chars, c["n_digits"] / chars, c["n_stops"] / words])


#: Bins of the medians: a width of 0.1 percent of a statistic over 0.001, then so many parts of each.
_FINE, _LEAST, _PARTS = 1000, 0.001, 4096


def medians(counts: DataFrame, middle: np.ndarray | None = None) -> np.ndarray:
    """Lower median over all rows of ``counts`` of every statistic, or of its distance from ``middle``, to six digits or better.

    All rows are counted in bins, then those of the middle bin in finer ones. Only counts of bins leave the tasks.
    """
    def counted(within: np.ndarray | None) -> dict[int, list[tuple[int, int]]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = ratios({c: batch.column(c).to_numpy() for c in COUNTS})
                rows = np.arcsinh((rows if middle is None else np.abs(rows - middle)) / _LEAST) * _FINE
                for f, own in enumerate(rows.T):
                    own = np.floor(own) if within is None else np.floor(own[np.floor(own) == within[f]] * _PARTS)
                    bins, n = np.unique(own.astype(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(bins), f), pa.int32()), pa.array(bins), pa.array(n, pa.int64())], ["f", "bin", "n"])

        sums = counts.select(*COUNTS).mapInArrow(run, "f int, bin bigint, n bigint").groupBy("f", "bin").agg(F.sum("n"))
        found: dict[int, list[tuple[int, int]]] = {}
        for f, k, n in sums.collect():
            found.setdefault(f, []).append((k, n))
        return {f: sorted(found[f]) for f in sorted(found)}

    coarse, before, total = [], [], 0
    for own in counted(None).values():
        upto = np.cumsum([n for _, n in own])
        total = int(upto[-1])
        at = int(np.searchsorted(2 * upto, total))
        coarse.append(own[at][0])
        before.append(int(upto[at]) - own[at][1])
    fine = [own[int(np.searchsorted(2 * (b + np.cumsum([n for _, n in own])), total))][0]
            for b, own in zip(before, counted(np.array(coarse)).values(), strict=True)]
    return np.sinh(np.array(fine) / _PARTS / _FINE) * _LEAST


class Excess:
    """How far a statistic lies above its usual range, median plus ``reach`` median deviations (0.02 at least); usual and low
    values are all 0, so the forest does not see outliers on the low side. Seeing both sides costs more than it finds: so many good
    rows stray low that the threshold, which may lose few of them, then keeps most bad rows too (figures in REPLY_r02.md)."""

    def __init__(self, middle: np.ndarray, spread: np.ndarray, reach: float):
        self.middle, self.spread, self.reach = middle, np.maximum(spread, 0.02), reach

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum((rows - self.middle) / self.spread - self.reach, 0.0)


class Forest:
    """Isolation trees as arrays: random splits of random features, each tree on its own draw of rows."""

    def __init__(self, rows: np.ndarray, s: Settings):
        draw = np.random.default_rng(s.seed)
        self.depth = max(1, int(np.ceil(np.log2(max(2, min(s.per_tree, len(rows)))))))
        self.norm = self.expected(min(s.per_tree, len(rows)))
        nodes = 1 << (self.depth + 1)
        self.feature = np.zeros((s.trees, nodes), np.int32)
        self.split = np.full((s.trees, nodes), np.inf)
        self.length = np.zeros((s.trees, nodes))
        for tree in range(s.trees):
            self._grow(tree, 1, 0, rows[draw.permutation(len(rows))[: s.per_tree]], draw)

    @staticmethod
    def expected(n: float) -> float:
        """Mean path length of an unsuccessful search among n rows."""
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, tree: int, node: int, depth: int, rows: np.ndarray, draw: np.random.Generator) -> None:
        self.length[tree, node] = depth + self.expected(len(rows))
        open_features = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 and depth < self.depth else []
        if not len(open_features):
            return
        f = draw.choice(open_features)
        cut = draw.uniform(rows[:, f].min(), rows[:, f].max())
        self.feature[tree, node], self.split[tree, node] = f, cut
        self._grow(tree, 2 * node, depth + 1, rows[rows[:, f] <= cut], draw)
        self._grow(tree, 2 * node + 1, depth + 1, rows[rows[:, f] > cut], draw)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly of every row, 0 to 1: short mean paths score high."""
        total, each = np.zeros(len(rows)), np.arange(len(rows))
        for feature, split, length in zip(self.feature, self.split, self.length, strict=True):
            node = np.ones(len(rows), np.int64)
            for _ in range(self.depth):
                leaf = np.isinf(split[node])
                node = np.where(leaf, node, 2 * node + (rows[each, feature[node]] > split[node]))
            total += length[node]
        return 2.0 ** (-total / len(self.feature) / max(self.norm, 1e-9))


def judged(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, the rule counts, base_failed, anomaly and kept for every row of ``docs`` (doc_id, text).

    A row fails the base rules with fewer than 10 words or over 20 percent of its words in repeated five-word windows. Trees are
    grown on at most ``sample`` rows (those of lowest id hash); every row is scored. The threshold is the lowest anomaly above which
    at most ``lost_good`` of all rows labelled ``quality`` 1 lie, so never above their highest; only without any such label nothing
    beyond the base rules is rejected.
    ``labels`` (doc_id, quality) may repeat or miss rows and hold nulls, which are ignored. Repeated rows repeat, null texts are
    empty (and fail), empty input gives an empty table.
    """
    s = settings
    counts = checkpointed(statistics(docs))
    drawn = lowest_hashed(counts, ["doc_id", "n_words", "word_chars"], s.sample).select(*COUNTS).toPandas()
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    if drawn.empty:
        return counts.withColumns({"base_failed": failed, "anomaly": F.lit(0.0), "kept": F.lit(False)})
    known = ratios({c: drawn[c].to_numpy() for c in COUNTS})
    middle = medians(counts)
    excess = Excess(middle, medians(counts, middle), s.reach)
    forest = Forest(excess(known), s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = excess(ratios({c: batch.column(c).to_numpy() for c in COUNTS}))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.scores(rows))], [*batch.schema.names, "anomaly"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = checkpointed(counts.mapInArrow(
        run, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", anomaly double")).withColumn("base_failed", failed)
    good = labels.where("quality = 1").select("doc_id").distinct()
    bins = scored.join(good, "doc_id").groupBy(F.floor(F.col("anomaly") * s.bins).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    histogram = dict(bins.collect())  # at most one row for each bin
    spare, limit = s.lost_good * sum(histogram.values()), (max(histogram) + 1) / s.bins if histogram else 2.0
    for k in sorted(histogram, reverse=True):
        spare -= histogram[k]
        if spare < 0:
            break
        limit = k / s.bins
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < limit))
