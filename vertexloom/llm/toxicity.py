"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Learned from a bounded sample: at most `SAMPLE_ROWS` labelled ids, chosen by their hash, with one text
each, that of the least hash where an id repeats.
The lexicon is learned too, from the sample: at most `LEXICON_WORDS` words that at least
`LEXICON_DOCUMENTS` toxic documents hold, by `LEXICON_Z` standard deviations more than their share; a word
below these bounds counts only through the other features. Features of a text are lexicon densities, nearness to second-person words, rates of
capitals, punctuation and obfuscation, and length. Trees are grown on histograms of the
features; a part of the sample that no tree has seen fits the isotonic curve. Whole
texts are read once to be scored, without any shuffle.

Defined cases: null text counts as empty, and an empty text gets the score of its features; where
there are fewer than `LEAST_LABELS` usable labels, or of one kind only, the score is the share of toxic labels (0 without
any); a document labelled twice counts as toxic if one label says so; a null id counts as
empty text in the fold; repeated rows are scored each on its own; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000
LEXICON_WORDS = 256
#: Least toxic documents of a lexicon word, and least excess over the toxic share in standard deviations.
LEXICON_DOCUMENTS, LEXICON_Z = 5, 7.0
#: Fewer usable labels train no trees: hardly a word can reach `LEXICON_Z` in them.
LEAST_LABELS = 50
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti usted ustedes vosotros su sus".split())
#: Stand-ins of letters in obfuscated words.
LEET = str.maketrans("013457@$!|", "oieastasil")
HIT, OBFUSCATED_HIT, SECOND, OBFUSCATED, CAPITALS = 1, 2, 4, 8, 16
NEAR = 6
CACHE_ENTRIES = 300_000
FEATURES = ("log_words", "hits", "hit_density", "weight", "top_weight", "weight_density", "distinct_hits", "obfuscated_hits", "near_second", "second_density", "capital_words", "capital_letters", "exclamations", "questions", "stars", "punctuation", "digits", "obfuscation")
CALIBRATION_PARTS = 4


class _Runs(dict):
    """What a white-space-free run is: flags, remembered."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def plain(self, run: str) -> str:
        return "".join(c for c in run.lower().translate(LEET) if c.isalpha())

    def word(self, run: str) -> str:
        low = run.lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»¿¡…“”‘’")
        return low if low in self.lexicon else self.plain(run)

    def __missing__(self, run: str) -> int:
        low = run.lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»¿¡…“”‘’")
        flags = 0
        mixed = bool(low) and not low.isalpha() and any(c.isalpha() for c in low)
        if low in self.lexicon:
            flags |= HIT
        elif not run.isalpha() and self.plain(run) in self.lexicon:
            flags |= HIT | OBFUSCATED_HIT
        if low in SECOND_PERSON:
            flags |= SECOND
        if mixed:
            flags |= OBFUSCATED
        if len(low) > 1 and low.isalpha() and run.upper() == run:
            flags |= CAPITALS
        if len(run) <= 48:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[run] = flags
        return flags


class Featurizer:
    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.runs = _Runs(lexicon)

    def __call__(self, text: str) -> list[float]:
        runs = text.split()
        n = max(1, len(runs))
        flags = np.frombuffer(bytes(map(self.runs.__getitem__, runs)), np.uint8)
        kinds = np.bincount(flags, minlength=32)
        of = lambda bit: int(kinds[(np.arange(32) & bit) > 0].sum())
        hits = np.flatnonzero(flags & HIT) if of(HIT) else np.array([], np.int64)
        words = [self.runs.word(runs[i]) for i in hits.tolist()]
        weights = [self.lexicon.get(w, 0.0) for w in words]
        near = 0
        if len(hits) and of(SECOND):
            second = np.flatnonzero(flags & SECOND)
            k = np.searchsorted(second, hits)
            gap = np.minimum(np.abs(hits - second[np.maximum(k - 1, 0)]), np.abs(hits - second[np.minimum(k, len(second) - 1)]))
            near = int((gap <= NEAR).sum())
        raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
        chars = max(1, int(raw.sum()))
        letters = max(1, int(raw[65:91].sum() + raw[97:123].sum()))
        marks = int(raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum())
        return [
            float(np.log1p(len(runs))), len(hits), len(hits) / n, sum(weights), max(weights, default=0.0), sum(weights) / n, len(set(words)), of(OBFUSCATED_HIT), near, of(SECOND) / n,
            of(CAPITALS) / n, raw[65:91].sum() / letters, raw[33] / chars, raw[63] / chars, raw[42] / chars, marks / chars, raw[48:58].sum() / chars, of(OBFUSCATED) / n,
        ]


@dataclass
class BoostedTrees:
    """Trees of fixed depth as arrays: feature, threshold for each inner node; value for each leaf."""

    depth: int = 3
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 80, rate: float = 0.15, bins: int = 48, ridge: float = 1.0, least: float = 8.0) -> "BoostedTrees":
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.base)
        inner = (1 << self.depth) - 1
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, np.maximum(p * (1 - p), 1e-9)
            feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, width = (1 << level) - 1, 1 << level
                local = node - first
                gain, choice = np.full(width, 1e-9), [None] * width
                for f in range(x.shape[1]):
                    size = len(edges[f]) + 1
                    if size < 2:
                        continue
                    key = local * size + binned[:, f]
                    gs = np.bincount(key, g, width * size).reshape(width, size).cumsum(1)
                    hs = np.bincount(key, h, width * size).reshape(width, size).cumsum(1)
                    cs = np.bincount(key, minlength=width * size).reshape(width, size).cumsum(1)
                    gt, ht, ct = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                    score = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                    score[(cs < least) | (ct - cs < least)] = 0
                    at = score[:, :-1].argmax(1)
                    value = score[np.arange(width), at]
                    for k in np.flatnonzero(value > gain):
                        gain[k], choice[k] = value[k], (f, edges[f][at[k]])
                for k, c in enumerate(choice):
                    if c:
                        feature[first + k], limit[first + k] = c
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > limit[node])
            leaf = node - inner
            value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
            margin += value[leaf]
            self.trees.append((feature, limit, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), (1 << self.depth) - 1
        for feature, limit, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += value[node - inner]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of the non-decreasing curve from score to the share of y."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # lowest score, highest score, sum, count
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        if blocks and blocks[-1][1] == s:
            blocks[-1][2] += v
            blocks[-1][3] += 1
        else:
            blocks.append([s, s, v, 1])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    x = [p for b in blocks for p in ((b[0],) if b[0] == b[1] else (b[0], b[1]))]
    v = [b[2] / b[3] for b in blocks for _ in range(1 if b[0] == b[1] else 2)]
    return np.array(x), np.array(v)


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: BoostedTrees | None
    curve: tuple[np.ndarray, np.ndarray] | None
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.full(len(x), self.share)
        return np.clip(np.interp(self.trees.margin(x), *self.curve), 0, 1)


def _sampled(docs: DataFrame, labels: DataFrame, learn: Column, rows: int) -> DataFrame:
    """doc_id, toxic, text of the sample. The sample's ids are broadcast: `rows` of them at most."""
    marked = labels.filter(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = marked.orderBy(F.xxhash64(F.col("doc_id"), F.lit("toxicity sample")), "doc_id").limit(rows)
    met = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    return met.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Words and their log odds. Copies of a text count once, by the least hash of its three-word runs."""
    words = F.split(F.lower("text"), r"[^\p{L}]+", -1)
    words_column = F.col("words")
    runs = F.transform(words_column, lambda w, i: F.xxhash64(w, F.get(words_column, i + 1), F.get(words_column, i + 2)))
    split = sample.select("toxic", words.alias("words")).select("toxic", F.array_min(runs).alias("copy"), F.array_distinct("words").alias("words"))
    each = split.select("toxic", "copy", F.explode("words").alias("word"))
    seen = each.filter(F.char_length("word") > 1).distinct()
    counts = seen.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    totals = sample.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).first()
    toxic, clean = (totals["t"] or 0) + 1.0, (totals["c"] or 0) + 1.0
    odds = F.ln((F.col("t") + 0.5) / toxic) - F.ln((F.col("c") + 0.5) / clean)
    share, n = toxic / (toxic + clean), F.col("t") + F.col("c")
    excess = (F.col("t") - n * share) / F.sqrt(n * share * (1 - share))
    best = counts.filter(F.col("t") >= LEXICON_DOCUMENTS).select("word", odds.alias("odds"), excess.alias("z")).filter(F.col("z") >= LEXICON_Z)
    return {r["word"]: float(r["odds"]) for r in best.orderBy(F.desc("z"), "word").limit(LEXICON_WORDS).collect()}


def _with_features(rows: DataFrame, lexicon: dict[str, float], model: ToxicityModel | None = None) -> DataFrame:
    """doc_id and toxic with the features, or doc_id with the model's score."""
    keys = ["doc_id", "toxic"] if model is None else ["doc_id"]
    shared = rows.sparkSession.sparkContext.broadcast((lexicon, model))  # bounded by LEXICON_WORDS and the number of trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, scorer = shared.value
        featurizer = Featurizer(words)
        for batch in batches:
            x = np.array([featurizer(t.as_py() or "") for t in batch.column("text")], np.float64).reshape(-1, len(FEATURES))
            own = [batch.column(k) for k in keys]
            if scorer is None:
                yield pa.RecordBatch.from_arrays([*own, pa.array(list(x), pa.list_(pa.float64()))], [*keys, "x"])
            else:
                yield pa.RecordBatch.from_arrays([*own, pa.array(scorer.score(x))], [*keys, "score"])

    made = "doc_id bigint, toxic int, x array<double>" if model is None else "doc_id bigint, score double"
    return rows.select(*keys, "text").mapInArrow(run, made)


def train(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE_ROWS, least_labels: int = LEAST_LABELS) -> ToxicityModel:
    """`learn`: which labels may be used, a condition on their doc_id."""
    sample = _sampled(docs, labels, learn, rows)
    lexicon = learn_lexicon(sample)
    found = sorted(_with_features(sample, lexicon).collect(), key=lambda r: (r["doc_id"], r["x"]))  # `rows` rows at most
    y = np.array([r["toxic"] for r in found], np.float64)
    share = float(y.mean()) if len(y) else 0.0
    if len(y) < least_labels or share in (0.0, 1.0):
        return ToxicityModel(lexicon, None, None, share)
    x = np.array([r["x"] for r in found])
    held = np.array([(r["doc_id"] * 2654435761 >> 8) % CALIBRATION_PARTS == 0 for r in found])
    if y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
        held[:] = False
    trees = BoostedTrees().fit(x[~held], y[~held])
    on = held if held.any() else ~held
    return ToxicityModel(lexicon, trees, isotonic(trees.margin(x[on]), y[on]), share)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score of every whole text."""
    return _with_features(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), model.lexicon, model)


def reject(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that score below `threshold`, all their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by LEXICON_WORDS and the number of trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurizer = Featurizer(shared.value.lexicon)
        for batch in batches:
            x = np.array([featurizer(t.as_py() or "") for t in batch.column("text")], np.float64).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(shared.value.score(x) < threshold))

    return docs.mapInArrow(run, docs.schema)
