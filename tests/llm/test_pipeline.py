"""Each stage against a brute-force version on its own input, and odd tables."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from siteweave.llm import simhash_bk

from .test_operators import LONG, check_packing, labelled, plain_spans


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs, labels = labelled(spark, 300)
    more = [(1000, "token = \"0123456789abcdef0123\" and more words here", "s1", "en"), (1001, None, None, None), (1002, "", "s1", "en"), (1003, LONG, "s2", "en"), (1004, LONG, "s2", "en"), (None, "lost words without an id at all", "s1", "en")]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality", "toxicity", "near_duplicates", "secrets", "packing"]
    stage = dict(pipeline.STAGES)
    one = stage["quality"](spark, docs, tables)
    assert one.columns == docs.columns
    kept = {r["doc_id"] for r in one.collect()}
    assert {k for k in range(300) if k % 5} <= kept and not kept & {k for k in range(0, 300, 5)}
    two = stage["toxicity"](spark, one, tables)
    kept = {r["doc_id"] for r in two.collect()}
    assert not kept & {k for k in range(0, 300, 7)} and {k for k in range(300) if k % 5 and k % 7} <= kept
    three = stage["near_duplicates"](spark, two, tables)
    rows = two.collect()
    left = {r["doc_id"] for r in three.collect()}
    prints = [(r["doc_id"], simhash_bk.fingerprint(r["text"], 5)) for r in rows]
    for d, f in prints:
        if d is not None and not any(e is not None and e < d and (f ^ g).bit_count() <= 6 for e, g in prints):
            assert d in left
    assert not {1003, 1004} <= left
    four = stage["secrets"](spark, three, tables).collect()
    assert all(not plain_spans(r["text"]) for r in four) and len(four) == three.count()
    assert all(r["n_chars"] == len(r["text"]) for r in four if r["text"] is not None)
    assert any(re.search(r"\[assign\]", r["text"] or "") for r in four)


def test_rows_are_decided_one_by_one(spark, tables):
    """Null and repeated ids, repeated rows, ties, and columns named as the stages' own."""
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("doc_id < 300")
    good, junk, toxic = ({r["doc_id"]: r["text"] for r in docs.where("doc_id IN (1, 5, 7)").collect()}[k] for k in (1, 5, 7))
    secret = 'token = "0123456789abcdef0123" and more words here'
    texts = [(None, good), (None, junk), (None, toxic), (1, junk), (1, good + " one more word"), (1, good + " one more word"), (7, good + " two other words at the end"), (None, secret), (None, None), (3, "")]
    rows = spark.createDataFrame([(d, t, "s1", "en", k) for k, (d, t) in enumerate(texts)], "doc_id long, text string, source string, lang string, k int")
    rows = rows.unionByName(docs.where("doc_id NOT IN (1, 3, 7)").select("doc_id", "text", "source", "lang", (F.col("doc_id") + 1000).cast("int").alias("k")))
    clash = ["__row", "__set", "__n", "__prefix", "__bits", "__of", "__spans", "__merged", "__quality", "__toxicity", "__evidence", "root", "first", "key", "kept_0"]
    rows = rows.select("*", F.length("text").cast("long").alias("n_chars"), *[F.col("k").alias(c) for c in clash])
    stage = dict(pipeline.STAGES)
    left = {}
    for name in ("quality", "toxicity", "near_duplicates", "secrets"):
        got = stage[name](spark, rows, tables)
        assert got.columns == rows.columns
        out = got.collect()
        assert all(r[c] == r["k"] for r in out for c in clash)
        left[name] = {r["k"] for r in out if r["k"] < 1000}
        if name == "secrets":
            assert {r["k"]: r["text"] for r in out if r["k"] < 1000} == {k: '[assign]" and more words here' if t == secret else t for k, (_, t) in enumerate(texts)}
    every = set(range(len(texts)))
    assert not left["quality"] & {1, 3} and {0, 4, 5, 6} <= left["quality"]
    assert left["toxicity"] == every - {2} and left["secrets"] == every
    # of each group the least id stays, null ids last: 4 of 0, 4, 5, 6 (5 repeats 4), 3 of 1 and 3, 9 of the texts without words
    assert left["near_duplicates"] == {2, 3, 4, 7, 9}
    packed = stage["packing"](spark, rows.where("k < 1000"), tables).collect()
    assert sorted({str(r["doc_id"]) for r in packed}) == sorted({str(d) for d, _ in texts}) and len(packed) == len(texts)


def test_run_packs_what_is_left(spark, tables):
    rows = pipeline.run(spark, tables).collect()
    assert len({r["sequence_id"] for r in rows}) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    assert check_packing([], []) == (0, 0)


def test_no_documents(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("false").withColumn("__gone", F.lit(1))
    for _, f in pipeline.STAGES:
        docs = f(spark, docs, tables)
    assert docs.count() == 0


def _near_texts():
    """Texts with copies and near copies of many degrees, a common passage, and a group whose members are all near copies."""
    import numpy as np

    rng = np.random.default_rng(12)
    word = lambda n: [f"v{int(x)}" for x in rng.integers(0, 4000, n)]
    common, texts = word(30), []
    for k in range(60):
        w = word(int(rng.integers(3, 150)))
        w = w + common if k % 2 else w
        texts.append(w)
        for _ in range(3):
            v = list(w)
            for at in rng.integers(0, len(v), int(rng.integers(0, 1 + len(v) // 30))):
                v[at] = word(1)[0]
            texts.append(v)
    base = word(120)
    for k in range(40):
        texts.append([*base[:60], f"n{k}", *base[61:]])
    return [" ".join(w) for w in texts]


def _near_groups(texts):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    own, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(own)):
        for j in range(i):
            if own[i] == own[j] or 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(own))]


@pytest.mark.parametrize("shard", [512, 4])
def test_near_duplicates_are_those_of_likeness(spark, monkeypatch, shard):
    from siteweave.llm import shingle_join

    monkeypatch.setattr(shingle_join, "SHARD", shard)
    texts = _near_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r["doc_id"] for r in dict(pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()}
    assert left == {k for k, root in enumerate(_near_groups(texts)) if k == root}


def test_one_row_of_each_group_stays(spark):
    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcde")
    rows = [(1, a), (None, a), (None, b), (3, c), (5, c), (5, d), (None, e), (None, e), (7, b + " more"), (1, a), (None, None), (None, "")] + [(None, f"{d} {k} {c} {k}") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"] or "") for r in dict(pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()), key=str)
    assert [x for x in got if x[0] is None and x[1].startswith(d)] and len([x for x in got if x[1].startswith(d + " ")]) == 1
    assert sorted((x for x in got if not x[1].startswith(d + " ")), key=str) == sorted([(1, a), (7, b + " more"), (3, c), (5, d), (None, e), (None, "")], key=str)


def test_near_duplicates_take_candidates_from_fingerprints(spark, monkeypatch):
    """The SimHash trees are searched, what they find is checked, and texts that only their fingerprints join stay apart."""
    a = " ".join(f"w{k}" for k in range(400))
    texts = [a, a + " more", "other words of another text here", a.replace("w0 ", "v0 ")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, linked = [], simhash_bk.linked
    monkeypatch.setattr(simhash_bk, "linked", lambda *args: seen.append(args[1]) or linked(*args))
    left = {r["doc_id"] for r in dict(pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()}
    assert left == {0, 2} and seen == [4]
    own = pipeline.shingle_join.keyed(docs)
    assert pipeline._candidates(own).count() >= 1
    monkeypatch.setattr(simhash_bk, "linked", lambda distinct, radius, count: distinct.alias("p").crossJoin(distinct.alias("q")).where("p.fp < q.fp").selectExpr("p.fp AS a", "q.fp AS b"))
    assert {r["doc_id"] for r in dict(pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()} == {0, 2}


def test_candidates_of_secrets_are_a_written_list(spark):
    """Texts need not move to meet a short list of candidates: it is written, and the postings are gone."""
    from siteweave.llm import secret_trigrams

    docs = spark.createDataFrame([(1, 'token = "0123456789abcdef0123"'), (2, "plain words")], "doc_id long, text string")
    clean = secret_trigrams.redacted(docs)
    assert any("/candidates-" in f for f in clean.inputFiles()) and not any("/postings-" in f for f in clean.inputFiles())
    assert sorted(r["text"] for r in clean.collect()) == ["[assign]\"", "plain words"]
