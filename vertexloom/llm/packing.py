"""Best-fit packing by minimum bin slack.

Packing depends on lengths alone, and a length is at most `capacity`; so the driver gets
a histogram of at most `capacity` rows, however large the corpus. For each bin, the longest
remaining length is taken, and a subset-sum dynamic programme over the available lengths,
one bit for each reachable sum, finds the fullest combination with it. As the same
combination would be found again while its lengths last, it is removed as often as the
histogram allows at once: the list of patterns stays short, whatever the number of documents.

Pieces then find their place by their rank within their length. Ranks come from counts by
(length, salt), so no length gathers in one task, and each task looks its pieces up in the
pattern table, whose size the capacity bounds.

Defined cases: null text counts as empty, and its piece is the end id alone; a document over
`capacity` is cut into full pieces, the first of which may be shorter; repeated rows and ids
are packed each on its own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_characters
from .common import durable

#: How the byte-level vocabulary's pre-tokenizer splits text.
BYTE_LEVEL_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of the table of runs; it is emptied when full.
CACHE_ENTRIES = 500_000
CACHE_CHARS = 48
#: Pieces that share a length and a salt, about.
RANK_ROWS = 50_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class _Runs(dict):
    """Ids of a run that stands after a space, remembered."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, run: str) -> bytes:
        ids = self.encode(" " + run)
        if len(run) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[run] = ids
        return ids


class ByteTokenizer:
    """Ids by the tokenizers library.

    A token boundary stands before every space that a non-space character follows, so such
    runs are encoded once and remembered. Runs in Latin letters go through the merges of
    the same file in tiktoken, which gives the same ids; all else goes to tokenizers itself.
    """

    #: A space before white space or the end, where the boundary does not hold.
    odd_space = re.compile(r" (?=\s|\Z)")

    def __init__(self, text: str):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(text)
        byte = {c: b for b, c in enumerate(byte_characters())}
        ranks = {bytes(map(byte.__getitem__, token)): i for token, i in spec["model"]["vocab"].items() if all(c in byte for c in token)}
        ranks = {t: i for t, i in ranks.items() if i not in {a["id"] for a in spec["added_tokens"]}}
        self.plain = tiktoken.Encoding("runs", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.full = Tokenizer.from_str(text)
        self.full.no_truncation()
        self.full.no_padding()
        self.special = [a["content"] for a in spec["added_tokens"]]
        self.runs = _Runs(self._encode)

    def _encode(self, text: str) -> bytes:
        if len(text) < 10_000 and (text.isascii() or max(text) < "ɐ"):
            ids = self.plain.encode_ordinary(text)
        else:
            ids = self.full.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.odd_space.search(text):
            return self._encode(text)
        first, *runs = text.split(" ")
        return b"".join([self._encode(first) if first else b"", *map(self.runs.__getitem__, runs)])


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document."""
    if n_ids <= capacity:
        return [(0, n_ids)]
    head = n_ids % capacity
    return [(0, head)] * bool(head) + [(s, capacity) for s in range(head, n_ids, capacity)]


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """One row a piece of each document."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # the file's size, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = ByteTokenizer(spec.value), end_id.to_bytes(4, "little")
        names = [x.split()[0] for x in PIECES.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = tokenizer.encode(text.as_py() or "") + end
                rows += [(doc_id, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(raw) // 4, capacity))]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def fullest(available: list[tuple[int, int]], room: int) -> Counter:
    """The lengths, (length, count) from the longest, that fill `room` best; with equal fill, the longer ones."""
    reach, trail = 1, []
    full = 1 << room
    mask = (full << 1) - 1
    for length, count in available:
        if length > room:
            continue
        power, left = 1, min(count, room // length)
        while left > 0:
            times = min(power, left)
            more = (reach | reach << (length * times)) & mask
            if more != reach:
                trail.append((length, times, reach))
                reach = more
                if reach & full:
                    left = 0
                    break
            left -= times
            power <<= 1
        if reach & full:
            break
    at, out = reach.bit_length() - 1, Counter()
    for length, times, before in reversed(trail):
        if not before >> at & 1:
            out[length] += times
            at -= length * times
    return out


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (length to multiplicity) and how often each is used; together they use up the histogram."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    if any(n > capacity or n < 1 for n in counts):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    order = sorted(counts, reverse=True)
    patterns = []
    while order:
        longest = order[0]
        counts[longest] -= 1
        pattern = fullest([(n, counts[n]) for n in order if counts[n]], capacity - longest)
        counts[longest] += 1
        pattern[longest] += 1
        times = min(counts[n] // m for n, m in pattern.items())
        for n, m in pattern.items():
            counts[n] -= m * times
            if not counts[n]:
                order.pop(bisect.bisect_left(order, -n, key=lambda x: -x))
        patterns.append((dict(sorted(pattern.items(), reverse=True)), times))
    return patterns


def place_table(patterns: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Columns length, first rank, first sequence, multiplicity, offset; sorted by length and rank."""
    used, rows, sequence = Counter(), [], 0
    for pattern, times in patterns:
        offset = 0
        for n, m in pattern.items():
            rows.append((n, used[n], sequence, m, offset))
            used[n] += m * times
            offset += n * m
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds rank, from 0 within each length, without gathering a length in one task."""
    largest = pieces.groupBy("length").count().agg(F.max("count")).first()[0] or 0
    salts = max(1, -(-largest // RANK_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("below"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("n", F.row_number().over(within))
    return numbered.join(offsets, ["length", "salt"]).withColumn("rank", F.col("below") + F.col("n") - 1).drop("n", "below", "salt")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = durable(tokenize(docs, tokenizer_path, capacity, end_id), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # `capacity` rows at most
    table = docs.sparkSession.sparkContext.broadcast(place_table(minimum_bin_slack(histogram, capacity)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        span = int(t[:, 1].max(initial=0)) + 1 if len(t) else 1
        starts = t[:, 0] * span + t[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = np.searchsorted(starts, length * span + np.minimum(rank, span - 1), side="right") - 1
            _, first, sequence, m, offset = t[row].T
            k = rank - first
            columns = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence + k // m), pa.array(offset + k % m * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    columns = ("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked(pieces).select(*columns).mapInArrow(run, PIECES + ", sequence_id bigint, offset bigint")
