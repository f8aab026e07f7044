"""Secret scans: fixed patterns, and a randomness test battery (DataFrame functions only).

Base kinds are leftmost, non-overlapping matches of three patterns; a match that fails its
length rule is dropped after the scan, so it still takes up its place. Positions are code
points of the whole match, end exclusive. They come from one pass that marks the matches
with control characters and then adds up the lengths between marks; control characters of
the text itself are first replaced, one for one, by another that no pattern accepts.

The battery adds spans of kind ``random``. Candidates are runs of 20 characters or more of the
encodings' alphabets that hold a digit and a letter. Each has its encoding inferred (hex,
base32, base64) and is tested, as a sequence of the encoding's values, for uniformity
(chi-squared over classes of the alphabet that ordinary words fill unevenly), for runs above and
below the middle, and for serial correlation. Three times the smallest p-value is its score: a random
string's is spread over 0 to 1, an ordinary one's lies near 0, the more so the longer it is.

The hypothesis that a candidate must overcome is "ordinary text of this corpus". Its law is counted in
each length band from stand-ins: from words of each whole text, joined like identifiers and paths,
with numbers, `STAND_INS` strings a document, for bands that its hash chooses. In a band with encoding, the candidates above a score
are reported for the lowest score at which the ordinary ones expected there (all candidates of the
band times the part of stand-ins that score as high in that encoding) are no more than the given
share of them, over all encodings: the Benjamini-Hochberg rule, on p-values from the stand-ins. Short strings have less
power, and are judged among their like; where no score bounds the false ones, the band abstains.
A span that a base span overlaps is not reported. Scores are counted in classes, so the corpus
is reduced to `BANDS` x 3 x `CLASSES` counts of either sort, and the thresholds are a number a
band and encoding.

Defined cases: null text counts as empty and has no spans; rows that repeat are scanned each
on its own; an empty table gives an empty table; other columns are passed by or kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

# The base patterns.
ASSIGN = r"""(?i)((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Upper ends of the length bands; the last band is open.
BAND_ENDS = (24, 32, 40, 48, 64, 96, 128)
BANDS = len(BAND_ENDS) + 1
#: Classes of -8 log2(p) that scores are counted in.
CLASSES = 400
#: Classes of each alphabet for the chi-squared test.
CHI_SETS = {
    "hex": ("01", "23", "45", "67", "89", "ab", "cd", "ef"),
    "base32": ("AEIOU", "LNRST", "BCDFGHJKMPQVWXYZ", "234567"),
    "base64": ("aeiou", "lnrst", "bcdfghjkmpqvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789+/"),
}
#: Part of the reported random spans that may be ordinary text.
RATE = 0.05
#: Stand-ins that each document gives.
STAND_INS = 3
#: What words of stand-ins are joined with.
JOINTS = ("/", "_", "-", "=")

SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def _spans(marked: Column, kind: int, least: int, inner: bool = False) -> Column:
    """Spans of a text whose matches stand between \\x01 and \\x03; with `inner`, \\x02 stands before the part that `least` is about."""

    def step(acc: Column, piece: Column) -> Column:
        def more(match: Column) -> Column:
            size = F.char_length(match) - (1 if inner else 0)
            value = F.char_length(F.substring_index(match, "\x02", -1)) if inner else size
            start = acc["at"]
            one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + size).alias("end")))
            return F.struct(
                (start + F.char_length(piece) - (2 if inner else 1)).alias("at"),
                F.when(value >= least, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"),
            )

        return let(F.substring_index(piece, "\x03", 1), more)

    def walk(pieces: Column) -> Column:
        zero = F.struct(F.char_length(pieces[0]).cast("bigint").alias("at"), F.expr(f"cast(array() as {SPANS})").alias("spans"))
        return F.aggregate(F.slice(pieces, 2, F.size(pieces)), zero, step, lambda acc: acc["spans"])

    return let(F.split(marked, "\x01", -1), walk)


def _none() -> Column:
    return F.expr(f"cast(array() as {SPANS})")


def _clean(text: Column) -> Column:
    """The text without the marks, at the same positions."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.rlike(whole, F.lit("[\x01-\x03]")), F.regexp_replace(whole, "[\x01-\x03]", "\x04")).otherwise(whole)


def base_spans(text: Column) -> Column:
    """Spans of the base patterns in a text without marks, by kind."""

    def holds(low: Column) -> Column:  # before the costly pattern: one of its words
        return F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("api"))

    assign = F.when(let(F.lower(text), holds), _spans(F.regexp_replace(text, ASSIGN, "\x01$1\x02$2\x03"), 0, MIN_ASSIGN, True)).otherwise(_none())
    access = F.when(F.contains(text, F.lit("AKIA")), _spans(F.regexp_replace(text, ACCESS, "\x01$0\x03"), 1, MIN_ACCESS)).otherwise(_none())
    runs = F.when(F.rlike(text, F.lit(HEX[:-1] + "{%d}" % MIN_HEX)), _spans(F.regexp_replace(text, HEX[:-1] + "{%d,}" % MIN_HEX, "\x01$0\x03"), 2, MIN_HEX)).otherwise(_none())
    return F.concat(assign, access, runs)


def _normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0, to 1e-7 (Abramowitz and Stegun 26.2.17)."""

    def of(z: Column) -> Column:
        poly = lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.least(F.lit(1.0), F.greatest(F.lit(1e-300), F.exp(-z * z / 2) * 0.3989422804014327 * let(1 / (1 + 0.2316419 * z), poly)))

    return let(z, of)  # here and below: what is named often is computed once, which keeps the plan small too


def _chi_squared(text: Column, name: str) -> Column:
    """Normal score of how unevenly the text uses the alphabet, by its classes."""
    sets, df = CHI_SETS[name], len(CHI_SETS[name]) - 1
    size = len(ALPHABETS[name])

    def total(n: Column) -> Column:
        terms = [F.pow(n * (1 - len(x) / size) - F.char_length(F.translate(text, x, "")), F.lit(2.0)) / (n * len(x) / size) for x in sets]
        return (F.pow(sum(terms[1:], terms[0]) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5

    return let(F.char_length(text).cast("double"), total)


def _battery(s: Column) -> Column:
    """Struct of the encoding inferred for `s`, as its place in `ALPHABETS`, and the class of its score."""
    core = F.regexp_replace(F.regexp_replace(s, "=+$", ""), "[-_=]", "+")
    names = list(ALPHABETS)

    def inferred(core: Column) -> Column:
        return F.when(F.rlike(core, F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$")), 0).when(F.rlike(core, F.lit("^[A-Z2-7]+$")), 1).otherwise(2)

    def tests(e: Column) -> Column:
        text, code = e["text"], e["code"]
        k = F.when(code == 0, 16.0).when(code == 1, 32.0).otherwise(64.0)
        alphabet = F.when(code == 0, ALPHABETS[names[0]]).when(code == 1, ALPHABETS[names[1]]).otherwise(ALPHABETS[names[2]])
        uniform = F.when(code == 0, _chi_squared(text, names[0])).when(code == 1, _chi_squared(text, names[1])).otherwise(_chi_squared(text, names[2]))

        def of(v: Column) -> Column:
            n = F.size(v).cast("double")

            def rest(x: Column) -> Column:
                return F.struct(
                    F.aggregate(v, F.lit(0.0), lambda a, y: a + (y - x["mean"]) * (y - x["mean"])).alias("var"),
                    F.aggregate(x["pairs"], F.lit(0.0), lambda a, p: a + (p["a"] - x["mean"]) * (p["b"] - x["mean"])).alias("cov"),
                    F.aggregate(x["pairs"], F.lit(1.0), lambda a, p: a + F.when((p["a"] * 2 >= k) != (p["b"] * 2 >= k), 1.0).otherwise(0.0)).alias("runs"),
                    F.size(F.filter(v, lambda y: y * 2 >= k)).cast("double").alias("high"),
                )

            def score(r: Column) -> Column:
                def by_middle(mid: Column) -> Column:
                    return let((mid - 1) * (mid - 2) / (n - 1), lambda spread: F.when(spread > 0, F.abs(r["runs"] - mid) / F.sqrt(spread)).otherwise(F.lit(10.0)))

                z_runs = let(2 * r["high"] * (n - r["high"]) / n + 1, by_middle)
                z_serial = F.when(r["var"] > 0, F.abs(r["cov"] / r["var"]) * F.sqrt(n)).otherwise(F.lit(10.0))
                upper = let(uniform, lambda z: let(_normal_tail(F.abs(z)), lambda p: F.when(z >= 0, p).otherwise(1 - p)))
                # of the two-sided tests, the larger score has the smaller p
                return F.least(F.lit(1.0), 3 * F.least(upper, F.least(F.lit(1.0), 2 * _normal_tail(F.greatest(z_runs, z_serial)))))

            pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
            given = F.struct((F.aggregate(v, F.lit(0.0), lambda a, y: a + y) / n).alias("mean"), pairs.alias("pairs"))
            return let(let(given, rest), score)

        values = F.transform(F.split(text, "(?!^)(?!$)"), lambda c: (F.position(c, alphabet) - 1).cast("double"))
        p = F.when(F.char_length(text) >= 8, let(values, of)).otherwise(F.lit(0.0))
        klass = F.least(F.lit(CLASSES - 1), F.floor(-8 * F.log2(F.greatest(p, F.lit(1e-300))))).cast("int")
        return F.struct(code.alias("code"), klass.alias("klass"))

    def of_core(core: Column) -> Column:
        return let(inferred(core), lambda code: let(F.struct(F.when(code == 0, F.lower(core)).otherwise(core).alias("text"), code.alias("code")), tests))

    return let(core, of_core)


def _mixed(piece: Column) -> Column:
    return F.rlike(piece, F.lit("[0-9]")) & F.rlike(piece, F.lit("[A-Za-z]"))


def candidates(text: Column) -> Column:
    """array<start, end, band, code, klass> of a text without marks."""
    runs = _spans(F.regexp_replace(text, CANDIDATE, "\x01$0\x03"), 3, 20)

    def judge(c: Column) -> Column:
        size = c["end"] - c["start"]
        band = F.lit(0)
        for end in BAND_ENDS:
            band = band + F.when(size > end, 1).otherwise(0)
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), band.alias("band"), c["score"]["code"].alias("code"), c["score"]["klass"].alias("klass"))

    def judged(spans: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
        both = F.zip_with(spans, pieces, lambda s, t: F.struct(s["start"].alias("start"), s["end"].alias("end"), t.alias("text")))
        scored = F.transform(F.filter(both, lambda b: _mixed(b["text"])), lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), _battery(b["text"]).alias("score")))
        return F.transform(scored, judge)

    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint,band:int,code:int,klass:int>>)")
    return F.when(F.rlike(text, F.lit(CANDIDATE)), let(runs, judged)).otherwise(none)


def stand_ins(text: Column) -> Column:
    """array<band, text>: `STAND_INS` strings like identifiers or paths, of words from all over the text, with numbers, for bands that a hash chooses."""
    ends = (19, *BAND_ENDS, 192)

    def made(words: Column) -> Column:
        n = F.size(words)

        def of(seed: Column, place: Column) -> Column:
            band = ((seed + 3 * place) % BANDS).cast("int")
            seed = seed + 7919 * place
            size = F.element_at(F.array(*map(F.lit, ends[:-1])), band + 1) + 1 + F.floor(seed / BANDS) % F.element_at(F.array(*(F.lit(e - b) for b, e in zip(ends, ends[1:], strict=False))), band + 1)

            def joined(size: Column) -> Column:
                k = F.floor(size / 3).cast("int")

                def piece(i: Column) -> Column:
                    raw = F.get(words, F.pmod(seed + i * F.greatest(F.floor(n / k), F.lit(1)), n).cast("int"))
                    # the long ones may be candidates themselves
                    word = let(raw, lambda w: F.when(F.char_length(w) <= 16, F.regexp_replace(w, "[^A-Za-z0-9]", "")).otherwise(""))

                    def dressed(draw: Column) -> Column:
                        number = F.floor(draw / 6) % F.element_at(F.array(*(F.lit(10**d) for d in range(1, 5))), (F.floor(draw / 64) % 4 + 1).cast("int"))
                        cased = let(word, lambda w: F.when(draw % 3 == 0, F.initcap(w)).otherwise(w))
                        return F.concat(cased, F.when(F.floor(draw / 3) % 2 == 0, number.cast("string")).otherwise(""), F.element_at(F.array(*map(F.lit, JOINTS)), (F.floor(draw / 7) % len(JOINTS) + 1).cast("int")))

                    return let(F.pmod(F.xxhash64(seed, i), F.lit(1 << 20)).cast("int"), dressed)

                return F.substring(F.array_join(F.transform(F.sequence(F.lit(0), k - 1), piece), ""), F.lit(1), size)

            return F.struct(band.alias("band"), let(size.cast("int"), joined).alias("text"))

        each = let(F.pmod(F.xxhash64(F.get(words, 0), F.get(words, n - 1), n), F.lit(1 << 20)), lambda seed: F.transform(F.sequence(F.lit(0), F.lit(STAND_INS - 1)), lambda i: of(seed, i)))
        return F.when(n >= 8, each)

    return let(F.split(text, " "), made)


def fdr_thresholds(docs: DataFrame, rate: float = RATE) -> list[int]:
    """For each band and encoding, the highest class of scores that is reported; -1 where none is."""
    text = _clean(F.col("text"))
    each = docs.select(F.explode(candidates(text)).alias("c")).select(F.lit(1).alias("real"), "c.band", "c.code", "c.klass")
    words = docs.select(F.explode(stand_ins(text)).alias("c")).select("c.band", F.col("c.text").alias("piece"))
    ordinary = words.filter((F.char_length("piece") >= 20) & _mixed(F.col("piece"))).select(F.lit(0).alias("real"), "band", _battery(F.col("piece")).alias("b")).select("real", "band", "b.code", "b.klass")
    counts = each.unionByName(ordinary).groupBy("real", "band", "code", "klass").count().collect()  # 2 x BANDS x 3 x CLASSES rows at most
    n = {(r["real"], r["band"], r["code"], r["klass"]): r["count"] for r in counts}
    limits = []
    for band in range(BANDS):
        total = [sum(v for k, v in n.items() if k[:2] == (real, band)) for real in (0, 1)]
        likes = {}  # by encoding and class: stand-ins of that encoding that score as high
        for code in range(len(ALPHABETS)):
            like = 0
            for klass in range(CLASSES):  # from the highest score down
                like += n.get((0, band, code, klass), 0)
                likes[code, klass] = like
        bound, found = -1, 0
        for like in sorted(set(likes.values())):  # p-values are (like + 1) over (stand-ins + 1)
            found = sum(n.get((1, band, *k), 0) for k, v in likes.items() if v <= like)
            if found and total[1] * (like + 1) / (total[0] + 1) <= rate * found:
                bound = like
        limits += [max((klass for klass in range(CLASSES) if likes[code, klass] <= bound), default=-1) for code in range(len(ALPHABETS))]
    return limits


def scan(docs: DataFrame, thresholds: list[int], name: str = "spans") -> DataFrame:
    """Adds the column `name`, array<start, kind, end>, sorted by start, then kind."""
    limits = F.array(*map(F.lit, thresholds))

    def both(base: Column, text: Column) -> Column:
        clear = F.filter(candidates(text), lambda c: (c["klass"] <= F.get(limits, c["band"] * len(ALPHABETS) + c["code"])) & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
        return F.concat(base, F.transform(clear, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end"))))

    return docs.withColumn(name, let(_clean(F.col("text")), lambda t: let(base_spans(t), lambda b: F.sort_array(both(b, t)))))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced; overlapping spans become one mark."""

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["parts"], F.array(piece))).otherwise(acc["parts"]).alias("parts"),
        )

    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<string>)").alias("parts"))
    tail = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, zero, step, tail)).otherwise(text)
