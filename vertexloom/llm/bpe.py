"""BPE encoding and decoding: a segment tree over adjacent pair ranks.

Each leaf of a word's tree holds the rank of the pair that starts there (or NONE);
inner nodes hold the minimum of (rank, position), so the root is the leftmost pair of
lowest rank. Merging it changes three leaves (the merged pair, the one before, the one
after), each a point update of logarithmic cost, until the root is NONE. The trees of
many words of equal width are advanced together as rows of one array; where few words share a
width, each has a tree by itself, whose updates end at the first node that they leave as it was.

The rest of the vocabulary file is followed as it stands: special tokens are cut out of
the raw text first; the remainder is normalised (NFC, white space to a space, lower case
one code point at a time), split by the file's pattern, and mapped to byte characters.
White space never stands inside a word, so results are remembered for each
white-space-free run, in a bounded table.

Defined cases: null text counts as empty and gives no ids; the decoder is the file's (none:
tokens joined by a space). Repeated rows and ids are encoded each on its own, an empty table
gives an empty table, and other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.int64(1 << 62)
#: Fewer words of one width than this are merged one by one, if they are longer than `SHORT` bytes.
TOGETHER, SHORT = 32, 64
#: Entries of the table of runs; it is emptied when full.
CACHE_ENTRIES = 600_000
#: White space to str.split() alone.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Beyond these ranges, which no new version of Unicode changes, letter cases and compositions are left to the library.
UNSETTLED = re.compile("[^\x00-\u02ff\u2000-\u206f\u20a0-\u20bf\u2190-\u23ff\u2500-\u27bf\u3000-\u3029\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\U0001f300-\U0001f64f]")
#: Longer runs are not remembered.
CACHE_CHARS = 48


def byte_characters() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next code point from 256."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class SegmentTreeBpe:
    """Merges of words, by the vocabulary and ranked merges of one tokenizer file."""

    def __init__(self, model: dict):
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.byte_char = byte_characters()
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        into = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.into = keys[order], order.astype(np.int64), into
        self.pairs: dict[int, tuple[int, int]] | None = None
        self.first = np.array([self.vocab.get(c, -1) for c in self.byte_char], np.int64)
        self.last = np.array([self.vocab.get(c + self.suffix, -1) for c in self.byte_char], np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.rank[at], NONE)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, given as UTF-8, as little-endian unsigned 32-bit integers."""
        out = [b""] * len(words)
        widths: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            widths.setdefault(max(1, (len(w) - 1).bit_length()), []).append(i)
        for power, members in widths.items():
            if len(members) < TOGETHER and 1 << power > SHORT:
                for i in members:
                    out[i] = self._merge_one(words[i])
                continue
            step = max(1, (1 << 20) >> power)
            for k in range(0, len(members), step):
                some = members[k : k + step]
                for i, ids in zip(some, self._merge([words[i] for i in some], 1 << power), strict=True):
                    out[i] = ids
        return out

    def _merge(self, words: list[bytes], width: int) -> list[bytes]:
        rows, lengths = len(words), np.fromiter(map(len, words), np.int64, len(words))
        raw = np.zeros((rows, width), np.uint8)
        inside = np.arange(width) < lengths[:, None]
        raw[inside] = np.frombuffer(b"".join(words), np.uint8)
        ids = np.where(inside, self.first[raw], -1)
        some = lengths > 0
        ids[some, lengths[some] - 1] = self.last[raw[some, lengths[some] - 1]]
        place = np.arange(width, dtype=np.int64)
        # Leaves from `width` on; a node's value is rank * width + position, so that ties go to the left.
        tree = np.full((rows, 2 * width), NONE, np.int64)
        if width > 1:
            rank = self._ranks(ids[:, :-1], ids[:, 1:])
            tree[:, width : 2 * width - 1] = np.where(rank == NONE, NONE, rank * width + place[:-1])
        level = width
        while level > 1:
            half = level >> 1
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        nxt = np.tile(place + 1, (rows, 1))
        prv = np.tile(place - 1, (rows, 1))
        alive = inside.copy()
        live = np.flatnonzero(tree[:, 1] != NONE) if width > 1 else np.array([], np.int64)
        while len(live):
            at = tree[live, 1] % width
            rank = tree[live, 1] // width
            gone = nxt[live, at]
            after = nxt[live, gone]
            ids[live, at] = self.into[rank]
            alive[live, gone] = False
            nxt[live, at] = after
            has_after = after < lengths[live]
            prv[live[has_after], after[has_after]] = at[has_after]
            before = prv[live, at]
            self._put(tree, live, gone, np.full(len(live), NONE), width)
            right = np.where(has_after, ids[live, np.minimum(after, width - 1)], -1)
            self._set(tree, live, at, ids[live, at], right, width)
            b = before >= 0
            rb, pb = live[b], before[b]
            self._set(tree, rb, pb, ids[rb, pb], ids[rb, at[b]], width)
            live = live[tree[live, 1] != NONE]
        flat = ids[alive].astype("<u4").tobytes()
        ends = (4 * np.cumsum(alive.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _merge_one(self, word: bytes) -> bytes:
        """One word of two bytes or more."""
        if self.pairs is None:
            self.pairs = {k: (r, i) for k, r, i in zip(self.keys.tolist(), self.rank.tolist(), self.into[self.rank].tolist(), strict=True)}
        pairs, n, none = self.pairs, len(word), int(NONE)
        width = 1 << (n - 1).bit_length()
        raw = np.frombuffer(word, np.uint8)
        start = self.first[raw]
        start[-1] = self.last[raw[-1]]
        rank = self._ranks(start[:-1], start[1:])
        whole = np.full(2 * width, NONE, np.int64)
        whole[width : width + n - 1] = np.where(rank == NONE, NONE, rank * width + np.arange(n - 1))
        level = width
        while level > 1:
            half = level >> 1
            whole[half:level] = np.minimum(whole[level : 2 * level : 2], whole[level + 1 : 2 * level : 2])
            level = half
        tree, ids = memoryview(whole), memoryview(start)
        nxt, prv = memoryview(np.arange(1, n + 1)), memoryview(np.arange(-1, n - 1))
        gone = bytearray(n)

        def put(at: int, value: int) -> None:
            node = at + width
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    return
                tree[node] = least

        def score(at: int, after: int) -> int:
            left, right = ids[at], ids[after]
            known = pairs.get(left << 32 | right) if left >= 0 and right >= 0 else None
            return none if known is None else known[0] * width + at

        while tree[1] != none:
            at = tree[1] % width
            eaten = nxt[at]
            after = nxt[eaten]
            ids[at] = pairs[ids[at] << 32 | ids[eaten]][1]
            gone[eaten], nxt[at] = 1, after
            put(eaten, none)
            if after < n:
                prv[after] = at
                put(at, score(at, after))
            else:
                put(at, none)
            before = prv[at]
            if before >= 0:
                put(before, score(before, at))
        return start[np.frombuffer(gone, np.uint8) == 0].astype("<u4").tobytes()

    def _set(self, tree, rows, at, left, right, width) -> None:
        rank = self._ranks(left, right)
        self._put(tree, rows, at, np.where(rank == NONE, NONE, rank * width + at), width)

    @staticmethod
    def _put(tree, rows, at, value, width) -> None:
        node = at + width
        tree[rows, node] = value
        node = node >> 1
        for _ in range(width.bit_length() - 1):
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node = node >> 1


class WordTokenizer:
    """Encoding and decoding as the tokenizer file says."""

    def __init__(self, text: str):
        import regex
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        spec = json.loads(text)
        self.normalizer = Tokenizer.from_str(text).normalizer
        self.bpe = SegmentTreeBpe(spec["model"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.splitter = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), behavior=split["behavior"].lower(), invert=split["invert"])
        self.space = regex.compile(r"\s+")
        self.tokens = {i: t for t, i in self.bpe.vocab.items()} | {i: t for t, i in self.special.items()}
        self.runs: dict[str, bytes] = {}

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if UNSETTLED.search(text):
            return self.normalizer.normalize_str(text)
        return unicodedata.normalize("NFC", text).lower()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        pieces: list[list] = []
        fresh: set[str] = set()
        for text in texts:
            parts = self.cut.split(text) if self.cut and "<" in text else [text]
            row: list = []
            for part in parts:
                if part in self.special:
                    row.append(self.special[part])
                elif part:
                    part = self.normal(part)
                    # str.split() also splits at the information separators, which the file's \\s does not
                    runs = self.space.split(part) if SEPARATORS.search(part) else part.split()
                    fresh.update(runs)
                    row.append(runs)
            pieces.append(row)
        known = self.runs
        if len(known) > CACHE_ENTRIES:
            known.clear()
        local = self._encode_runs([r for r in fresh if r not in known])
        for r, ids in local.items():
            if len(r) <= CACHE_CHARS:
                known[r] = ids
        long = {r: ids for r, ids in local.items() if len(r) > CACHE_CHARS}
        get = known.__getitem__ if not long else lambda r: known[r] if r in known else long[r]
        return [b"".join(x.to_bytes(4, "little") if isinstance(x, int) else b"".join(map(get, x)) for x in row) for row in pieces]

    def _encode_runs(self, runs: list[str]) -> dict[str, bytes]:
        split = list(map(self.split, runs))
        words = list({w for ws in split for w in ws})
        ids = dict(zip(words, self.bpe.encode_words([w.encode() for w in words]), strict=True))
        return {r: ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws]) for r, ws in zip(runs, split, strict=True)}

    def split(self, run: str) -> list[str]:
        if run.isascii() or max(run) < "\u0250":
            return self.words.findall(run)
        return [w for w, _ in self.splitter.pre_tokenize_str(run)]  # other Unicode versions class some letters otherwise

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


def encode_documents(docs: DataFrame, tokenizer_path: str, batch_chars: int = 4_000_000) -> DataFrame:
    """doc_id and text to doc_id, n_tokens, ids_sha256, decoded_sha256, of every whole text."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # the file's size, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(spec.value)
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end]) <= batch_chars):
                    chars += len(texts[end])
                    end += 1
                n, enc, dec = [], [], []
                for raw in tokenizer.encode_batch(texts[at:end]):
                    ids = np.frombuffer(raw, "<u4")
                    n.append(len(ids))
                    enc.append(hashlib.sha256(raw).hexdigest())
                    dec.append(hashlib.sha256(tokenizer.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([keys.slice(at, end - at), pa.array(n, pa.int64()), pa.array(enc), pa.array(dec)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at = end

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
