"""Secret scans: fixed patterns, and a battery of randomness tests on long tokens under false-discovery control."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeline.llm import texts
from gradeline.session import checkpointed

#: The patterns of the three base kinds, in their order, and the fewest characters of each.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

_ASSIGN, _ACCESS, _HEX = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(HEX.replace("+", "{%d,}" % LEAST_HEX))
#: "=" parts tokens unless it pads one at its end.
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:=+(?![A-Za-z0-9+/_-]))?")
_PLAIN_RUN, _URL_RUN = re.compile(r"[A-Za-z0-9+/]{16,}=*"), re.compile(r"[A-Za-z0-9_-]{16,}=*")

#: Alphabets a token may be written in, the narrowest first.
ENCODINGS = {
    "digits": "0123456789",
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "alnum": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_SETS = {name: frozenset(chars) for name, chars in ENCODINGS.items()}
_PLACES = {name: {c: k for k, c in enumerate(chars)} for name, chars in ENCODINGS.items()}


@dataclass(frozen=True)
class Settings:
    """Level of the false-discovery control, and the p-value under which a randomness test rejects a token."""

    level: float = 0.01
    reject: float = 0.001
    bins: int = 64


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base patterns: leftmost non-overlapping matches of each kind, short ones dropped."""
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]  # a run is maximal, so short ones can be left out at once
    return sorted((a, b, k) for a, b, k in found)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _above(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def encoding_of(token: str) -> str | None:
    """The narrowest alphabet that holds the token without its padding."""
    chars = set(token)
    return next((name for name, own in _SETS.items() if chars <= own), None)


def battery(token: str) -> tuple[str, float, float] | None:
    """Encoding, the smallest p-value of the randomness tests, and how surprising the token is as a word.

    Under the hypothesis of independent uniform characters: chi-squared over the alphabet (Wilson-Hilferty), runs above and
    below the middle of the alphabet, and the serial correlation of neighbours. The last value is the p-value of its
    character-class changes under the hypothesis of a word, whose neighbours mostly stay in one class of letters or digits.
    """
    body = token.rstrip("=")
    name = encoding_of(body)
    if name is None or len(body) < 16:
        return None
    size, n = len(ENCODINGS[name]), len(body)
    at = np.array([_PLACES[name][c] for c in body])
    counts = np.bincount(at, minlength=size)
    free = size - 1
    chi = float(((counts - n / size) ** 2).sum() * size / n)
    uniform = _above(((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free)))
    high = at >= size / 2
    ups = int(high.sum())
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 1 + 2 * ups * (n - ups) / n
    spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    turning = _two_sided((runs - mean) / spread) if 0 < ups < n else 2.0 ** (1 - n)
    centred = at - at.mean()
    power = float((centred ** 2).sum())
    serial = _two_sided((float((centred[1:] * centred[:-1]).sum()) / power + 1 / n) * math.sqrt(n)) if power else 0.0
    kinds = np.array([0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in body])
    changes = int((kinds[1:] != kinds[:-1]).sum())
    rate = 0.2  # of class changes between neighbours of a word, camel case and numbered names included
    word = sum(math.comb(n - 1, k) * rate ** k * (1 - rate) ** (n - 1 - k) for k in range(changes, min(n, 400))) if n <= 400 else _above(
        (changes - rate * (n - 1)) / math.sqrt(rate * (1 - rate) * (n - 1)))
    return name, min(uniform, turning, serial), min(1.0, word)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and candidate tokens of every row: (start, end, kind) and (start, end, p_random, p_word) arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.int32())]))
        candidate = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("p_random", pa.float64()), ("p_word", pa.float64())]))
        for batch in texts.small_batches(batches):
            spans, tokens = [], []
            for text in batch.column("text").to_pylist():
                spans.append([{"start": a, "stop": b, "kind": k} for a, b, k in base_spans(text or "")])
                tokens.append([{"start": a, "stop": b, "p_random": p, "p_word": q} for a, b, p, q in _tokens_of(text or "")])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(spans, span), pa.array(tokens, candidate)], ["doc_id", "spans", "tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, spans array<struct<start:bigint,stop:bigint,kind:int>>, "
             "tokens array<struct<start:bigint,stop:bigint,p_random:double,p_word:double>>")


def _length_class(start: str, stop: str):
    return F.floor(F.log2(F.col(stop) - F.col(start))).cast("int")


def _tokens_of(text: str) -> list[tuple[int, int, float, float]]:
    """(start, end, p_random, p_word) of the tokens that the battery can test, by start. A token in no one alphabet, with + or / and
    - or _, is tested as its runs in either of base64's alphabets; such runs may overlap."""
    found = []
    for m in _TOKEN.finditer(text):
        if encoding_of(m.group().rstrip("=")):
            spans = {m.span()}
        else:
            spans = {r.span() for run in (_PLAIN_RUN, _URL_RUN) for r in run.finditer(text, *m.span())}
        found += [(a, b, t[1], t[2]) for a, b in sorted(spans) if (t := battery(text[a:b]))]
    return found


def cuts(found: DataFrame, s: Settings) -> dict[int, float]:
    """For each length class the p-value up to which tokens are discoveries: Benjamini-Hochberg over binned log p-values.

    Long tokens have smaller p-values by length alone; a class of its own keeps them from lending their discoveries to short
    ones. Only the counts of (class, bin) are gathered, at most 64 x ``bins`` rows, and a bin counts at its upper edge.
    """
    tokens = found.select(F.explode("tokens").alias("t")).select("t.*")
    step = 16.0 / s.bins
    bins = tokens.select(
        _length_class("start", "stop").alias("class"), F.when(F.col("p_random") < s.reject, 1.0).otherwise(F.col("p_word")).alias("p"))
    bins = bins.withColumn("bin", F.least(F.floor(-F.log10(F.greatest("p", F.lit(1e-300))) / step), F.lit(s.bins - 1)).cast("int"))
    sums = bins.groupBy("class", "bin").agg(F.count(F.lit(1)).alias("n"))
    below = Window.partitionBy("class").orderBy(F.desc("bin"))
    ranked = sums.select(
        "class", F.pow(F.lit(10.0), -F.col("bin") * step).alias("edge"), F.sum("n").over(below).alias("rank"),
        F.sum("n").over(Window.partitionBy("class")).alias("m"))
    return dict(ranked.where(F.col("edge") * F.col("m") <= s.level * F.col("rank")).groupBy("class").agg(F.max("edge")).collect())


def secret_spans(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id and ``spans``, an array of (start, stop, kind) by start, then kind, for every row of ``docs`` (doc_id, text).

    Kinds 0 to 2 are the base patterns; kind 3 is a token of 16 or more characters that passes as random (no test of the battery
    rejects uniform independent characters) and whose character-class changes no word would show, at a controlled rate of false
    discoveries within its length class, and which no base span overlaps. Offsets are code points, stop is exclusive. A null or empty
    text has no spans; rows are independent but for the cuts, which all tokens decide; empty input gives an empty table.
    """
    s = settings
    found = checkpointed(scanned(docs))
    limits = cuts(found, s)

    def accepted(t):
        cut = F.lit(-1.0)
        for own, value in sorted(limits.items()):
            cut = F.when(F.floor(F.log2(t["stop"] - t["start"])) == own, F.lit(value)).otherwise(cut)
        clear = ~F.exists("spans", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"]))
        return (t["p_random"] >= s.reject) & (t["p_word"] <= cut) & clear

    added = F.transform(F.filter("tokens", accepted), lambda t: F.struct(
        t["start"].alias("start"), t["stop"].alias("stop"), F.lit(len(KINDS) - 1).alias("kind")))
    order = lambda a, b: F.when(
        a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(
        F.when(a["kind"] < b["kind"], -1).when(a["kind"] > b["kind"], 1).otherwise(0))
    return found.select("doc_id", F.array_sort(F.concat("spans", added), order).alias("spans"))


def masked(docs: DataFrame, mask: str, settings: Settings = Settings()) -> DataFrame:
    """``docs`` (text and any other columns) with every span of ``secret_spans`` replaced by ``mask``; overlapping spans are one.

    The cuts come from one pass over all texts; a second pass finds the spans again and masks them, so no text is shuffled.
    """
    s = settings
    limits = cuts(scanned(docs), s)

    def cleaned(text: str | None) -> str | None:
        if not text:
            return text
        base = [(a, b) for a, b, _ in base_spans(text)]
        spans = base + [
            (a, b) for a, b, random, word in _tokens_of(text)
            if random >= s.reject and word <= limits.get((b - a).bit_length() - 1, -1.0) and not any(x < b and a < y for x, y in base)]
        out, at = [], 0
        for a, b in sorted(spans):
            if b > at:
                out += [text[at:a], mask] if a >= at else []
                at = b
        return "".join(out) + text[at:] if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.small_batches(batches):
            at = batch.schema.get_field_index("text")
            done = pa.array(map(cleaned, batch.column(at).to_pylist()), pa.string())
            yield batch.set_column(at, "text", done)

    return docs.mapInArrow(run, docs.schema)
