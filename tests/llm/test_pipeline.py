"""The corpus pipeline, stage by stage against brute force on what the stage before it kept."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from vertexloom.llm import packing, queries, secrets

from test_llm_operators import base, classes, deduped, toxic_rows

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, kept_id int, n_lines int, text_hash string"


def corpus():
    """Clean and toxic texts, exact and near copies, shared lines, secrets, nulls, a long text and repeated rows."""
    rng = random.Random(41)
    rows, labels = toxic_rows(160)
    texts = {r[0]: r[1] for r in rows}
    for i in range(160, 190):  # copies of clean texts, a word changed in some
        words = texts[1 + 6 * rng.randrange(20)].split()
        if i % 2:
            words[0] = "changed"
        texts[i] = " ".join(words)
    block = "shared line one\nshared line two\nshared line three"
    for i in range(190, 205):
        texts[i] = f"own words {i} here\n{block}\nlast words of {i}"
    for i in range(205, 212):
        texts[i] = f"note {i} token=abcdef{i}x and AKIAABCDEFGHIJKLM{i} with deadbeef" + "0123456789abcdef" * (i - 203)
    texts |= {212: None, 213: "", 214: " \n\n ", 215: " ".join(f"long{k % 997}x{k}" for k in range(9000)), 216: "one", 217: "one"}
    made = [(i, t, "en" if i % 3 else None, "s", len(t or ""), "a", 1, 2, "b") for i, t in texts.items()]
    return made + [made[5], made[212], (None, "no id here at all", None, None, None, None, None, None, None)], labels


def taken(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_each_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given, toxic = taken(docs), {i for i, _, t in corpus()[1] if t}
    states = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == [x.split()[0] for x in SCHEMA.split(", ")]
        assert docs.filter("spans != 'a' or kept_id != 1 or n_lines != 2 or text_hash != 'b' or n_chars != char_length(text)").count() == 0
        states.append(taken(docs))
    clean, lines, single, masked = states
    assert not set(clean) - set(given) and all(clean[k] == given[k] for k in clean)
    gone = {k[0] for k in given if k not in clean}
    assert len(gone & toxic) >= 0.95 * len(toxic) and not gone - toxic
    # lines: rows that share id and text are one document
    by_place = sorted(set(clean), key=lambda k: (k[0] is not None, k[0] or 0))
    want = deduped([t for _, t in by_place])
    assert lines == Counter({(i, None if t is None else want[k]): clean[i, t] for k, (i, t) in enumerate(by_place)})
    assert sum("shared line two" in (t or "") for _, t in lines) == 1
    # one of each class; ids are unique but for repeated rows
    by_place = sorted((k for k in lines if k[0] is not None), key=lambda k: k[0])
    found = classes([t for _, t in by_place])
    keep = {by_place[k] for k, (_, c) in found.items() if k == c}
    assert set(single) == keep | {k for k in lines if k[0] is None} and set(single.values()) == {1}
    for i, t in single:
        spans = [s.split(":") for s in base(t or "").split(",") if s]
        out = next(x for j, x in masked if j == i)
        assert (out is None) == (t is None)
        for _, a, b in spans:
            assert t[int(a) : int(b)] not in out
        if not spans and len(t or "") < 20:
            assert out == t
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    tokenizer = packing.ByteTokenizer(open(queries.vocabulary("byte_bpe_50k.json"), encoding="utf-8").read())
    sizes = Counter()
    for r in pieces:
        sizes[r["doc_id"]] += r["length"]
    assert sizes == Counter({i: len(tokenizer.encode(t or "")) // 4 + 1 for i, t in masked})
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()) == Counter(r["doc_id"] for r in pieces)


def test_an_empty_table(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_texts_without_secrets_stay(spark):
    docs = spark.createDataFrame([(1, "plain words here"), (2, None), (3, "a\\b $1 \x01 c")], "doc_id bigint, text string")
    found = secrets.scan(docs, secrets.fdr_thresholds(docs))
    assert [r[0] for r in found.orderBy("doc_id").select(secrets.redact(F.col("text"), F.col("spans"))).collect()] == ["plain words here", None, "a\\b $1 \x01 c"]
