"""N-gram Jaccard self-join by PartEnum signatures, and its connected classes.

Sets are those of `shingles`; two link where 100 * intersection >= 80 * union.

Nodes. Equal sets are one node, named by a 64-bit hash of the set, so exact copies are never
paired. Each map batch names a signature of a node once.

Signatures. Sizes fall into bands whose ends grow by 1/0.8, so linked sets lie in one band or in two
neighbours; a set takes part in its own band's instance and in the one below. An instance of
largest size u splits the feature domain, by hash, into n parts, more than the number k of
features in which linked sets can differ: at least n - k parts agree. The hash of what a set
has in a part is a signature. Parts with two features or more are signed first; a set with
too few of them (as many weak parts as n - k or more) signs weak parts too, and a set
with as many empty parts as that signs these as well. So linked sets share a signature: if one
of the two signs strong parts alone, the agreeing part is strong in both.

Candidates. Signatures travel packed, by bucket; a bucket's run of equal signatures of up to
`SMALL_RUN` nodes gives its pairs, a longer one only pairs with its first node (the pivot), and
its members are kept. Signatures of very many nodes are dealt by node instead: each task makes its
part of the run and passes on its first node, or all nodes of a short part, and the parts of a run
meet by counts and minima. So no signature, however common, gathers in one task. Which are common
is estimated from one in `ONE_IN` of all (signature, node), whichever batches hold them; the
estimate moves work between tasks and changes no result. Pairs are dropped by an exact bound:
counts of features by class of a sketch differ by no more than the sets do. The others are verified
on whole sets.
Long runs come of passages that many sets share, or of many near copies. A set shares at least
n - k strong parts, less its weak ones, with any set linked with it; if it is in fewer long runs
than that, they meet in a short one. For the others, only pairs in different classes are open;
they are sought among sets that share one of their rarest features, a fifth of each, which leaves
out the passages that many share, then bounded and verified. The holders of a feature meet in
blocks of `BLOCK_HOLDERS`, each pair of blocks in a task. No link is lost.

Classes. Verified links, between nodes, are joined by least labels with pointer jumping, as
tables. Links, labels and sets are never collected.

Defined cases: null text has an empty set; empty sets link with nothing; rows that repeat have
equal sets, hence one class; a null id is in a class like any other, whose name is the least
id that is not null; an empty table gives an empty table; other columns are ignored, and
`keep_one` keeps them as they are, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, durable, unused
from .shingles import U, mix, shingle_sets

NEED, OF = 80, 100
WIDTH = 5
#: Parts of an instance for each feature of its largest set.
PARTS = 0.4
#: Longest run of equal signatures whose pairs are all made at once.
SMALL_RUN = 8
#: Signatures that meet in one task, about.
BUCKET_SIGNATURES = 500_000
#: A signature of about this many nodes is dealt by node.
HOT_SIGNATURES = BUCKET_SIGNATURES // 10
#: Of the occurrences of signatures, one in so many is counted to find the common ones: all those of one document in `DOCUMENT_IN`.
ONE_IN, DOCUMENT_IN = 1024, 16
#: Classes of signatures in the map of common ones, which is broadcast; a class holds a bit.
HOT_CELLS = 1 << 20
#: Bytes of text that are shingled at once (more for a longer text), and signatures that a task packs at once.
BATCH_BYTES = 1_000_000
PACKED = 500_000
#: Holders of a rare feature that meet in one task: two blocks of these.
BLOCK_HOLDERS = 1_000
SKETCH = 256


def bands(largest: int) -> list[int]:
    """Upper ends of the size bands: the next band begins above, and ends at, 1/0.8 of an end."""
    ends = [1]
    while ends[-1] < largest:
        ends.append(max(ends[-1] + 1, ends[-1] * OF // NEED))
    return ends


_ENDS = np.array(bands(1 << 40), np.int64)


def differ(size: np.ndarray, below: int) -> np.ndarray:
    """Most features in which a set of `size` and a set linked with it can differ: a partner has size / 0.8 at most, and in the band below no more than `size`."""
    return size * (OF - NEED) * 2 // (OF + NEED) if below else size * (OF - NEED) // NEED


def batches_of(texts: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs of texts of `BATCH_BYTES` in all, or of one longer text; null counts as empty."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES, side="right")))
        yield at, end, [t or b"" for t in texts.slice(at, end - at).cast(pa.binary()).to_pylist()]
        at = end


def node_names(sets: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """A hash of each set; 0 for an empty one."""
    out = np.zeros(n, np.uint64)
    if len(sets):
        begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        total = np.add.reduceat(mix(sets ^ U(0xA5A5A5A5A5A5A5A5)), begin)
        out[owner[begin]] = mix(total) | U(1)
    return out


def sketches(sets: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Features of each set by class, 255 at most: clipped counts differ no more than the counts do."""
    cells = np.bincount(owner * SKETCH + (mix(sets) % U(SKETCH)).astype(np.int64), minlength=n * SKETCH)
    return np.minimum(cells, 255).astype(np.uint8).reshape(n, SKETCH)


@dataclass(frozen=True)
class Instance:
    """What the documents have in the parts of one instance; the first three by filled part, the rest by document."""

    sign: np.ndarray
    doc: np.ndarray
    features: np.ndarray
    place: np.ndarray
    taking: np.ndarray
    band: np.ndarray
    parts: np.ndarray
    agree: np.ndarray  #: parts in which a linked set agrees, at least
    strong: np.ndarray
    filled: np.ndarray


def instances(sets: np.ndarray, owner: np.ndarray, n_docs: int) -> Iterator[Instance]:
    sizes = np.bincount(owner, minlength=n_docs)
    own_band = np.searchsorted(_ENDS, sizes, side="left")
    for below in (0, 1):
        taking = (sizes > 0) & (own_band >= below)
        band = np.maximum(own_band - below, 0)
        u = _ENDS[band]
        parts = np.maximum(u * (OF - NEED) // NEED + 1, np.ceil(u * PARTS).astype(np.int64))
        mine = taking[owner]
        who, what = owner[mine], sets[mine]
        seed = mix(band[who].astype(np.uint64) * U(0x2545F4914F6CDD1D) + U(7))
        part = (mix(what ^ seed) % parts[who].astype(np.uint64)).astype(np.int64)
        base = np.concatenate(([0], np.cumsum(np.where(taking, parts, 0))[:-1])).astype(np.int64)
        slot = base[who] + part
        order = np.argsort(slot, kind="stable")
        slot, what, who = slot[order], what[order], who[order]
        begin = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1]))) if len(slot) else np.zeros(0, np.int64)
        total = np.add.reduceat(mix(what + U(0x632BE59BD9B4E019)), begin) if len(begin) else np.zeros(0, np.uint64)
        features = np.diff(np.concatenate((begin, [len(slot)])))
        doc, place = who[begin], slot[begin] - base[who[begin]]
        sign = mix(total ^ mix(place.astype(np.uint64) + band[doc].astype(np.uint64) * U(1 << 40)))
        strong, filled = np.bincount(doc[features >= 2], minlength=n_docs), np.bincount(doc, minlength=n_docs)
        yield Instance(sign, doc, features, place, taking, band, parts, parts - differ(sizes, below), strong, filled)


def signatures(made: Iterable[Instance]) -> tuple[np.ndarray, np.ndarray]:
    """All signatures, and the document of each."""
    found, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i in made:
        weak_too = i.parts - i.strong >= i.agree
        keep = (i.features >= 2) | weak_too[i.doc]
        found.append(i.sign[keep])
        of.append(i.doc[keep])
        for d in np.flatnonzero(i.taking & (i.parts - i.filled >= i.agree)).tolist():
            gone = np.setdiff1d(np.arange(i.parts[d]), i.place[i.doc == d]).astype(np.uint64)
            found.append(mix(mix(gone + U(i.band[d]) * U(1 << 40)) ^ U(0xE4E4)))
            of.append(np.full(len(gone), d))
    return np.concatenate(found), np.concatenate(of)


def sure_signatures(made: Iterable[Instance], n_docs: int) -> np.ndarray:
    """How many of its strong signatures each set shares with any set linked with it, at least; 0 for one that signs weak parts."""
    least = np.full(n_docs, np.iinfo(np.int64).max)
    for i in made:
        sure = np.maximum(i.agree - (i.parts - i.strong), 0)
        least = np.where(i.taking, np.minimum(least, sure), least)
    return np.where(least == np.iinfo(np.int64).max, 0, least)


def seen_signatures(sets: np.ndarray, owner: np.ndarray, names: np.ndarray, one_in: int) -> list[int]:
    """One in `one_in` of the signatures of different nodes."""
    documents = min(one_in, DOCUMENT_IN)
    some = np.zeros(len(names), bool)
    some[np.unique(names, return_index=True)[1]] = True
    some &= (names != 0) & (mix(names ^ U(0x3C3C)) % U(documents) == 0)
    mine = some[owner]
    found, of = signatures(instances(sets[mine], owner[mine], len(names)))
    counted = mix(found ^ mix(names[of])) % U(one_in // documents) == 0
    return found[counted].view(np.int64).tolist()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def name_documents(docs: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """doc_id, n_shingles, node, sketch of each row; seen: the counted signatures of its batch, in the batch's first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in batches_of(batch.column(1)):
                sets, owner = shingle_sets(texts, WIDTH)
                cells, names = sketches(sets, owner, b - a), node_names(sets, owner, b - a)
                seen = [seen_signatures(sets, owner, names, one_in), *[None] * (b - a - 1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.bincount(owner, minlength=b - a)), _signed(names), pa.array([c.tobytes() for c in cells], pa.binary()), pa.array(seen, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "node", "sketch", "seen"],
                )

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, node bigint, sketch binary, seen array<bigint>")


def hot_cells(named: DataFrame, least: int, one_in: int = ONE_IN) -> tuple[np.ndarray, int]:
    """Which classes of signatures hold one of about `least` nodes or more, and how many nodes those have; `HOT_CELLS` rows at most reach the driver."""
    counted = named.select(F.explode("seen").alias("sign")).groupBy("sign").agg((F.count("*") * one_in).alias("n")).filter(F.col("n") >= least)
    cells = counted.groupBy(F.pmod(F.col("sign"), F.lit(HOT_CELLS)).alias("cell")).agg(F.sum("n").alias("n")).collect()
    hot = np.zeros(HOT_CELLS, bool)
    hot[[r["cell"] for r in cells]] = True
    return hot, sum(r["n"] for r in cells)


def _runs(sign: np.ndarray, node: np.ndarray, lone: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by signature and node, each once, without lone signatures unless `lone`: signature, node, and where runs begin."""
    order = np.lexsort((node, sign))
    sign, node = sign[order], node[order]
    fresh = np.ones(len(sign), bool)
    fresh[1:] = (sign[1:] != sign[:-1]) | (node[1:] != node[:-1])
    sign, node = sign[fresh], node[fresh]
    if len(sign) and not lone:
        same = sign[1:] == sign[:-1]
        shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
        sign, node = sign[shared], node[shared]
    begin = np.flatnonzero(np.concatenate(([True], sign[1:] != sign[:-1]))) if len(sign) else np.zeros(0, np.int64)
    return sign, node, begin


def _candidates(docs: DataFrame, buckets: int, hot: np.ndarray, salts: int, scratch: Scratch) -> DataFrame:
    """run (0 for short ones), a, b: pairs of nodes of which one begins the run or its part, or all pairs of a short one.

    Signatures in `hot` classes go by node to `salts` buckets of their own, numbered from `buckets` on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(hot)) if salts else None  # HOT_CELLS bits

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        found, node = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((node, found))
        found, node = found[order], node[order]
        fresh = np.ones(len(found), bool)
        fresh[1:] = (found[1:] != found[:-1]) | (node[1:] != node[:-1])
        found, node = found[fresh], node[fresh]
        bucket = (mix(found) % U(buckets)).astype(np.int64)
        if salts:
            common = np.unpackbits(shared.value)[(found % U(HOT_CELLS)).astype(np.int64)] > 0
            bucket[common] = buckets + (mix(node[common] ^ U(0x5A17)) % U(salts)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        own, cut = np.unique(bucket[order], return_index=True)
        rows = np.split(order, cut[1:])
        return pa.RecordBatch.from_arrays(
            [pa.array(own, pa.int64()), pa.array([found[i].tobytes() for i in rows], pa.binary()), pa.array([node[i].tobytes() for i in rows], pa.binary())],
            ["bucket", "signs", "nodes"],
        )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for a, b, texts in batches_of(batch.column(0)):
                sets, owner = shingle_sets(texts, WIDTH)
                names = node_names(sets, owner, b - a)
                first = np.zeros(b - a, bool)
                first[np.unique(names, return_index=True)[1]] = True
                mine = first[owner]
                for i in instances(sets[mine], owner[mine], b - a):
                    found, of = signatures([i])
                    held.append((found, names[of]))
                    n += len(found)
                if n >= PACKED:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)

    def meet(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        part = key[0].as_py() >= buckets  # of runs
        join = lambda c: np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in group.column(c)] or [np.zeros(0, np.uint64)])
        sign_, node, begin = _runs(join("signs"), join("nodes"), part)
        end = np.concatenate((begin[1:], [len(sign_)])).astype(np.int64)
        size = end - begin
        runs, left, right = [], [], []
        long = size > SMALL_RUN
        # long runs: every member with the first
        within = np.repeat(long, size) if len(size) else np.zeros(0, bool)
        pivot = np.repeat(node[begin], size) if len(size) else node
        star = within & (pivot != node)
        runs.append(sign_[star] | U(1)), left.append(pivot[star]), right.append(node[star])
        for n in range(2, SMALL_RUN + 1):
            at = begin[size == n]
            if part:
                break
            for i in range(n):
                for j in range(i + 1, n):
                    left.append(node[at + i]), right.append(node[at + j]), runs.append(np.zeros(len(at), np.uint64))
        r, a, b = map(np.concatenate, (runs, left, right))
        order = np.lexsort((b, a, r))
        r, a, b = r[order], a[order], b[order]
        fresh = np.ones(len(r), bool)
        fresh[1:] = (r[1:] != r[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        out = [pa.table({"run": _signed(r[fresh]), "a": _signed(a[fresh]), "b": _signed(b[fresh])})]
        if part:  # what it passes on: of a long part its first node, twice; of a short one each node, without a partner
            short = ~np.repeat(long, size) if len(size) else np.zeros(0, bool)
            out.append(pa.table({"run": _signed(sign_[begin[long]]), "a": _signed(node[begin[long]]), "b": _signed(node[begin[long]])}))
            out.append(pa.table({"run": _signed(sign_[short]), "a": _signed(node[short]), "b": pa.nulls(int(short.sum()), pa.int64())}))
        return pa.concat_tables(out)

    signed = docs.select("text").mapInArrow(sign, "bucket bigint, signs binary, nodes binary")
    met = signed.groupBy("bucket").applyInArrow(meet, "run bigint, a bigint, b bigint")
    return _whole_runs(scratch.keep(met, "parts")) if salts else met


def _whole_runs(met: DataFrame) -> DataFrame:
    """The pairs of `met`, and those between the parts of runs."""
    passed = met.filter("b is null or a = b").select("run", "a", F.col("b").isNotNull().alias("long"))
    runs = passed.groupBy("run").agg(F.min("a").alias("pivot"), (F.max("long") | (F.count("*") > SMALL_RUN)).alias("long"))
    whole = passed.select("run", "a").join(runs, "run")
    star = whole.filter("long and a != pivot").select(F.col("run").bitwiseOR(F.lit(1).cast("bigint")).alias("run"), F.col("pivot").alias("a"), F.col("a").alias("b"))
    short = whole.filter("not long").select("run", "a")  # SMALL_RUN rows a run at most
    pairs = short.join(short.withColumnRenamed("a", "b"), "run").filter("a < b").select(F.lit(0).cast("bigint").alias("run"), "a", "b")
    return met.filter("a != b").unionAll(star).unionAll(pairs)


def _bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that sizes and sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, SKETCH).astype(np.int16) for c in ("sa", "sb"))
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            apart = np.abs(sa - sb).sum(1, dtype=np.int64)
            common = (na + nb - apart) // 2  # at most
            keep = OF * common >= NEED * (na + nb - common)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    left = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    near = OF * F.least("na", "nb") >= NEED * F.greatest("na", "nb")
    met = pairs.join(left.drop("sa"), "a").join(right.drop("sb"), "b").filter(near).select("a", "b")
    return met.join(left, "a").join(right, "b").mapInArrow(run, "a bigint, b bigint")


def _whole_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """node, features, sure: the sets of the wanted nodes, from the text of their least document."""
    keys = nodes.join(wanted, "node", "left_semi").select("key", "node")
    texts = docs.select(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("key"), "text").join(keys, "key").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy()
            for a, b, raw in batches_of(batch.column("text")):
                sets, owner = shingle_sets(raw, WIDTH)
                names = node_names(sets, owner, b - a).view(np.int64)
                cut = np.searchsorted(owner, np.arange(b - a + 1))
                own = np.flatnonzero(names == node[a:b])  # an id may name other texts too
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[a:b][own]), pa.array([sets[cut[i] : cut[i + 1]].tobytes() for i in own], pa.binary()), pa.array(sure_signatures(instances(sets, owner, b - a), b - a)[own])],
                    ["node", "features", "sure"],
                )

    made = texts.mapInArrow(run, "node bigint, features binary, sure bigint")
    return scratch.keep(made.groupBy("node").agg(F.first("features").alias("features"), F.first("sure").alias("sure")), "sets")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b, common, total of the pairs: the sizes of intersection and union of whole sets."""
    sets = _whole_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, docs, scratch)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, total = [], []
            for x, y in zip(batch.column("fa"), batch.column("fb"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                c = len(np.intersect1d(x, y, assume_unique=True))
                common.append(c)
                total.append(len(x) + len(y) - c)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(total, pa.int64())], ["a", "b", "common", "total"])

    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("features").alias("fa")), "a").join(sets.select(F.col("node").alias("b"), F.col("features").alias("fb")), "b")
    out = scratch.keep(met.select("a", "b", "fa", "fb").mapInArrow(count, "a bigint, b bigint, common bigint, total bigint"), "links")
    scratch.drop(sets)
    return out


def components(links: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """node, label of all nodes with links (a, b): the least node of each connected class."""
    both = scratch.keep(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct(), "edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    for _ in range(max_rounds):
        # of the joins, one side has one row a key, so adaptive execution can split a large class on the other
        offered = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("offer"))
        least = labels.join(offered, "node").select("node", F.least("label", "offer").alias("via"), "label")
        # the label of the label: distances to the least node halve each round
        parent = labels.select(F.col("node").alias("via"), F.col("label").alias("above"))
        jumped = scratch.keep(least.join(parent, "via", "left").select("node", F.least("via", F.coalesce("above", "via")).alias("label"), F.col("label").alias("old")), "labels")
        changed = not jumped.filter("label != old").isEmpty()
        scratch.drop(labels)
        labels = jumped
        if not changed:
            scratch.drop(both)
            return labels.select("node", "label")
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def merged_classes(labels: DataFrame, late: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label after more links (a, b): only the classes that they join are followed, each as one node, its label."""
    ends = late.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = scratch.keep(labels.unionAll(ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))), "labels")
    of = lambda end: known.select(F.col("node").alias(end), F.col("label").alias(f"of_{end}"))
    above = components(late.join(of("a"), "a").join(of("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")), scratch)
    above = above.select(F.col("node").alias("label"), F.col("label").alias("above"))
    return known.join(above, "label", "left").select("node", F.coalesce("above", "label").alias("label"))


def _open_nodes(members: DataFrame, nodes: DataFrame, labels: DataFrame, docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """node, label of the nodes that may have links which only long runs show, and their whole sets."""
    in_runs = scratch.keep(members.select("run", F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left").select("run", "node", F.coalesce("label", "node").alias("label")), "runs")
    # a run all of whose members are in one class leaves nothing open
    unsettled = in_runs.groupBy("run").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("run")
    open_runs = scratch.keep(in_runs.join(unsettled, "run", "left_semi").select("node", "label").distinct(), "open")
    sets = _whole_sets(open_runs.select("node"), nodes, docs, scratch)
    # fewer long runs than sure signatures: one of those it shares with any linked set is in a short run
    within = in_runs.groupBy("node").agg(F.count("*").alias("long")).join(sets.select("node", "sure"), "node")
    rest = scratch.keep(open_runs.join(within.filter("long >= sure"), "node", "left_semi"), "open")
    scratch.drop(in_runs, open_runs)
    return rest, sets


def _rare_pairs(open_nodes: DataFrame, sets: DataFrame, nodes: DataFrame, scratch: Scratch, block_holders: int) -> DataFrame:
    """Pairs (a, b) of open nodes in different classes that share one of their rarest features.

    Linked sets share 0.8 of the larger's features at least; so, in any common order, the first 0.2 of
    each, and one more, have one in common. The order is by how many open nodes hold a feature.
    Where sets meet, places in that order and sketches rule pairs out before any is made. The holders of
    a feature are dealt to blocks, and a task gets two blocks.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                features = np.frombuffer(raw.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(features), node, np.int64)), pa.array(features)], ["node", "feature"])

    own_sets = sets.join(open_nodes.select("node"), "node", "left_semi").select("node", "features")
    each = scratch.keep(own_sets.mapInArrow(explode, "node bigint, feature bigint"), "features")
    shared = each.groupBy("feature").agg(F.count("*").alias("held")).filter("held > 1")
    common = each.join(shared, "feature").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("held", "feature"))).alias("common"))
    sized = common.join(nodes.select("node", "n_shingles"), "node").join(open_nodes, "node")
    # features that one node alone holds come first, and take up places
    alone = F.col("n_shingles") - F.size("common")
    first = F.greatest(F.floor(F.col("n_shingles") * (OF - NEED) / OF) + 1 - alone, F.lit(0)).cast("int")
    prefix = sized.select("node", "label", "n_shingles", alone.alias("alone"), F.posexplode(F.slice("common", 1, first)).alias("at", "f"))
    prefix = scratch.keep(prefix.select("node", "label", "n_shingles", (F.col("alone") + F.col("at")).cast("bigint").alias("place"), F.col("f.feature").alias("feature")), "prefix")
    mixed = prefix.groupBy("feature").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.ceil(F.count("*") / block_holders).alias("blocks")).filter("low != high").select("feature", "blocks")
    met = prefix.join(mixed, "feature").join(nodes.select("node", "sketch"), "node")
    met = met.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))

    def meet(group: pa.Table) -> pa.Table:
        node, label, size, place, own = (group.column(c).to_numpy() for c in ("node", "label", "n_shingles", "place", "own"))
        cells = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(node), SKETCH).astype(np.int16)
        left, right = [], []
        two = own.min() != own.max()
        for i in range(len(node) - 1):
            j = np.arange(i + 1, len(node))
            both = size[i] + size[j]
            apart = (OF - NEED) * both  # linked sets differ by this over OF + NEED at most
            # as the first feature in common, it has none in common before it; else the pair meets at an earlier one
            j = j[(label[j] != label[i]) & ((OF + NEED) * (place[i] + place[j]) <= apart) & ((OF + NEED) * np.abs(size[i] - size[j]) <= apart) & ((own[j] != own[i]) | (not two))]
            far = np.abs(cells[j] - cells[i]).sum(1, dtype=np.int64)
            j = j[(OF + NEED) * far <= (OF - NEED) * (size[i] + size[j])]
            left.append(np.minimum(node[i], node[j]))
            right.append(np.maximum(node[i], node[j]))
        none = np.zeros(0, np.int64)
        return pa.table({"a": pa.array(np.concatenate([none, *left])), "b": pa.array(np.concatenate([none, *right]))})

    met = met.select("feature", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "label", "n_shingles", "place", "own", "sketch")
    return met.groupBy("feature", "low", "high").applyInArrow(meet, "a bigint, b bigint").distinct()


def join_classes(docs: DataFrame, bucket_signatures: int = BUCKET_SIGNATURES, hot_signatures: int = HOT_SIGNATURES, one_in: int = ONE_IN, block_holders: int = BLOCK_HOLDERS) -> DataFrame:
    """(doc_id, text) to doc_id, n_shingles, component_id. The numbers move work between tasks and change no result."""
    scratch = Scratch()
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    named = scratch.keep(name_documents(docs, one_in), "named")
    full = named.filter("n_shingles > 0")
    nodes = scratch.keep(full.groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("key"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "nodes")
    total = full.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(1, math.ceil(total * 0.6 / bucket_signatures))
    hot, often = hot_cells(named, hot_signatures, one_in)
    found = scratch.keep(_candidates(docs, buckets, hot, math.ceil(often / bucket_signatures), scratch), "pairs")
    pairs = scratch.keep(_bounded(found.select("a", "b").distinct(), nodes), "near")
    measured = _verified(pairs, nodes, docs, scratch)
    linked = F.expr(f"{OF} * common >= {NEED} * total")
    links = measured.filter(linked).select("a", "b")
    labels = components(links, scratch)
    members = found.filter("run != 0")
    if not members.isEmpty():
        rest, sets = _open_nodes(members, nodes, labels, docs, scratch)
        known = measured.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        more = scratch.keep(_rare_pairs(rest, sets, nodes, scratch, block_holders).join(known, ["a", "b"], "left_anti"), "near")
        if not more.isEmpty():
            late = _verified(more, nodes, docs, scratch).filter(linked).select("a", "b")
            if not late.isEmpty():
                labels = merged_classes(labels, late, scratch)
    own = full.select("doc_id", "n_shingles", "node").join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("label", "node").alias("label"))
    least = own.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    empty = named.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = durable(own.join(least, "label").select("doc_id", "n_shingles", "component_id").unionAll(empty), "classes")
    scratch.clear()
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without those linked to a smaller id; of rows that repeat an id and text, one stays."""
    classes = join_classes(docs)
    key, text = unused(docs, "kept_id"), unused(docs, "text_hash")
    kept = classes.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(key)).distinct()
    out = docs.join(kept, docs["doc_id"].cast("bigint").eqNullSafe(F.col(key)), "left_semi")
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return out
    return out.withColumn(text, F.xxhash64("text")).dropDuplicates(["doc_id", text]).drop(text)
