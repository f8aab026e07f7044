"""Language identification by cross-parsing entropy.

For each language, a suffix automaton of labelled text is built; it accepts every substring of
that text. A document is parsed against it greedily: the longest match is a phrase, the next
one starts after it, and a letter that the language never showed is a phrase of its own. The
language that needs the fewest normalised phrases wins: their number times the logarithm of the length of
the language's sample, the cross-parsing estimate of entropy, so that a language of little text is not put
at a disadvantage. The score is one minus the ratio of that to the runner-up's. Letters are lower-cased, all else counts as a single space.

The automata come from a bounded sample: about `sample_rows` labelled rows a language, chosen by
a hash of their ids, and at most `sample_chars` characters. All chosen rows are learned from, each
with a piece from anywhere in its text, of `piece_chars` characters at most and in shares as even as the
texts' lengths allow: 119 characters of each of 200 long texts. At most twice `sample_rows` rows a language
are collected, however many share an id. Their tables are the only
thing that is broadcast, and their size does not depend on the corpus. Every letter of the samples
has a code: transitions by the commonest lie in a dense table, those by all others in a sorted
list of pairs of state and code. Every whole text is
parsed in one pass: many texts advance together, as columns of one array, `BLOCK` letters at a time, with
the state carried on; where few are left that are longer, each goes on by itself, letter by letter.

Defined cases: null text, or text without a letter, is ``und`` with score 0, as is all text
where no language could be learned; with a single language its score is 1; a tie goes to
the name that comes first; a letter beyond the sample is one phrase in every language; repeated rows are predicted each on its own; a null id counts as
empty text in the fold; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import random
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 512
#: Fewer texts than this go on one by one.
TOGETHER = 96
BATCH_CHARS = 2_000_000
#: Codes of letters: PAD, OTHER and SPACE come before the alphabet's letters.
PAD, OTHER, SPACE, FIRST = 0, 1, 2, 3
#: Codes below this have columns in the dense tables; transitions by all further codes are searched for.
DENSE_CODES = 128


def automaton_edges(codes: list[int]) -> list[dict[int, int]]:
    """Transitions by state of the automaton of all substrings; state 0 is the root."""
    link, length, edges = [-1], [0], [{}]
    last = 0
    for c in codes:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return edges


def dense_table(edges: list[dict[int, int]], width: int) -> np.ndarray:
    """Transitions [state, code] by codes below `width`; -1: none."""
    table = np.full((len(edges), width), -1, np.int32)
    for s, e in enumerate(edges):
        for c, t in e.items():
            if c < width:
                table[s, c] = t
    return table


def suffix_automaton(codes: list[int], width: int) -> np.ndarray:
    """Transitions [state, code] of the automaton of all substrings; -1: none; state 0 is the root."""
    return dense_table(automaton_edges(codes), width)


class CrossParser:
    """The automata of the languages over one alphabet."""

    def __init__(self, samples: dict[str, str]):
        texts = {k: v.lower() for k, v in sorted(samples.items())}
        seen = Counter(c for t in texts.values() for c in t if c.isalpha())
        letters = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))]
        self.codes = FIRST + len(letters)
        alpha = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        self.code = np.where(alpha, OTHER, SPACE).astype(np.min_scalar_type(self.codes))
        self.code[[ord(c) for c in letters]] = np.arange(FIRST, self.codes)
        self.width = min(self.codes, DENSE_CODES)
        self.names = list(texts)
        self.rare: dict[int, dict[int, int]] = {}
        self.weights = np.log2(2.0 + np.array([len(t) for t in texts.values()], np.float64))
        self.tables = [self._ready(automaton_edges(self.letters(t).tolist())) for t in texts.values()]

    def _ready(self, edges: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat dense transitions, with none for an unseen code and no move at padding; where to go from the root, and at
        what cost; transitions by the other codes, as sorted keys and targets that end in a key beyond all.
        """
        table = dense_table(edges, self.width)
        table[:, OTHER] = -1
        table[:, PAD] = np.arange(len(table))
        root = np.full(self.codes, -1, np.int32)
        root[: self.width] = table[0]
        for c, t in edges[0].items():
            root[c] = t
        rest = sorted((s * self.codes + c, t) for s, e in enumerate(edges) for c, t in e.items() if c >= self.width)
        keys = np.array([*(k for k, _ in rest), np.iinfo(np.int64).max], np.int64)
        targets = np.array([*(t for _, t in rest), -1], np.int32)
        return table.ravel(), np.maximum(root, 0), (root < 0).astype(np.int32), keys, targets

    def letters(self, text: str) -> np.ndarray:
        """Codes of a lower-case text; runs of non-letters become one space."""
        codes = self.code[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
        gap = codes == SPACE
        gap[1:] &= codes[:-1] == SPACE
        if len(gap):
            gap[0] = codes[0] == SPACE
        return codes[~gap]

    def phrases(self, documents: list[np.ndarray]) -> np.ndarray:
        """Phrases [document, language]: each text is parsed greedily from its first letter to its last."""
        sizes = np.array([len(d) for d in documents], np.int64)
        states = np.zeros((len(self.names), len(documents)), np.int32)
        counts = np.zeros((len(self.names), len(documents)), np.int64)
        for at in range(0, int(sizes.max(initial=0)), BLOCK):
            left = np.flatnonzero(sizes > at)
            if len(left) < TOGETHER:
                for i in left.tolist():
                    for k in range(len(self.names)):
                        states[k, i], more = self._alone(k, documents[i][at:], int(states[k, i]))
                        counts[k, i] += more
                break
            grid = np.zeros((BLOCK, len(left)), self.code.dtype)
            for column, i in enumerate(left.tolist()):
                some = documents[i][at : at + BLOCK]
                grid[: len(some), column] = some
            for k in range(len(self.names)):
                states[k, left], more = self._together(k, grid, states[k, left])
                counts[k, left] += more
        return (counts + (states > 0)).T

    def _together(self, k: int, grid: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after the columns of `grid`, and phrases ended in them."""
        table, go, cost, keys, targets = self.tables[k]
        count = np.zeros(len(state), np.int32)
        for column in grid:
            if self.codes == self.width:
                following = table.take(state * np.int32(self.width) + column)
            else:
                rare = np.flatnonzero(column >= self.width)
                following = table.take(state * np.int32(self.width) + np.where(column < self.width, column, OTHER))
                wanted = state[rare].astype(np.int64) * self.codes + column[rare]
                at = np.searchsorted(keys, wanted)
                following[rare] = np.where(keys[at] == wanted, targets[at], -1)
            missed = np.flatnonzero(following < 0)
            if len(missed):
                code = column[missed]
                count[missed] += (state[missed] > 0) + cost[code]
                following[missed] = go[code]
            state = following
        return state, count

    def _alone(self, k: int, letters: np.ndarray, state: int) -> tuple[int, int]:
        """The same for one text."""
        table, go, cost, keys, targets = self.tables[k]
        if k not in self.rare:
            self.rare[k] = dict(zip(keys.tolist(), targets.tolist(), strict=True))
        rare, dense, width, codes, count = self.rare[k], memoryview(table), self.width, self.codes, 0
        first, price = go.tolist(), cost.tolist()
        for c in letters.tolist():
            following = dense[state * width + c] if c < width else rare.get(state * codes + c, -1)
            if following < 0:
                count += (state > 0) + price[c]
                following = first[c]
            state = following
        return state, count

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        documents = [self.letters(t.lower()) for t in texts]
        known = np.array([bool((d != SPACE).any()) for d in documents], bool)
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts))
        found = self.phrases(documents) * self.weights
        best = found.argmin(1)
        low = found[np.arange(len(texts)), best]
        second = np.partition(found, 1, axis=1)[:, 1] if len(self.names) > 1 else np.full(len(texts), np.inf)
        score = np.where(known, np.clip(1 - low / np.maximum(second, 1e-9), 0, 1), 0.0)
        return [self.names[b] if k else "und" for b, k in zip(best, known, strict=True)], score


def even_pieces(texts: list[tuple[int, str]], chars: int) -> str:
    """Of each (seed, text) a piece at a random place, in even shares of `chars` characters; what short texts leave goes to the others."""
    left, share = max(0, chars - len(texts)), 0
    for k, n in enumerate(sorted(len(t) for _, t in texts)):
        share = left // (len(texts) - k)
        if n > share:
            break
        share, left = n, left - n
    pieces = []
    for seed, t in texts:
        start = random.Random(seed).randrange(max(1, len(t) - share + 1))
        pieces.append(t[start : start + share])
    return "\n".join(pieces)[:chars]


def sample(docs: DataFrame, learn: Column, sample_rows: int = 200, sample_chars: int = 24_000, piece_chars: int = 3_000) -> dict[str, str]:
    """Labelled text of each language: about `sample_rows` rows by the hash of their ids, `sample_chars` characters at most.

    One count a language comes to the driver, where each has an automaton anyway; so rows are chosen in
    the scan, and only their pieces are shuffled.
    """
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    shares = {r["lang"]: min(1.0, sample_rows / r["count"]) for r in rows.groupBy("lang").count().collect()}
    if not shares:
        return {}
    share = F.create_map(*(F.lit(x) for pair in sorted(shares.items()) for x in pair))[F.col("lang")]
    # rows without an id, or with one id, are told apart by their texts
    pick = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.when(F.col("doc_id").isNull(), F.col("text")), F.lit("language sample")), F.lit(1 << 30))
    seed = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language piece")), F.lit(1 << 30)).cast("int")
    piece = F.substr(F.col("text"), seed % F.greatest(F.char_length("text") - (piece_chars - 1), F.lit(1)) + 1, F.lit(piece_chars))
    chosen = rows.filter(pick <= share * (1 << 30)).select("lang", pick.alias("pick"), seed.alias("seed"), piece.alias("text"))
    order = Window.partitionBy("lang").orderBy("pick", "text")
    chosen = chosen.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= 2 * sample_rows)
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in chosen.orderBy("lang", "place").collect():
        texts.setdefault(r["lang"], []).append((r["seed"], r["text"]))
    return {lang: even_pieces(t, sample_chars) for lang, t in texts.items()}


def identify(docs: DataFrame, parser: CrossParser) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(parser)  # bounded by the sample, not by the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end]) <= BATCH_CHARS):
                    chars += len(texts[end])
                    end += 1
                names, score = known.predict(texts[at:end])
                yield pa.RecordBatch.from_arrays([keys.slice(at, end - at), pa.array(names), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])
                at = end

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")
