"""Operators 11 to 13 against brute force, with nulls, empty and long texts, ties, repeats, no rows and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siteweave.llm import divergence_audit, extendible_dedup, importance_ngrams

SCHEMA = "doc_id long, text string"
LONG = "Word another third fourth " * 60_000
ODD = [(1, "The quick brown fox."), (2, None), (3, ""), (4, LONG), (5, "The quick brown fox."), (5, "The quick brown fox."), (5, "a1  B\n\tc É\U0001f600 İ"), (None, "The quick brown fox."), (6, " \t\n "), (None, None), (None, "x")]


def odd(spark, **more):
    """With columns whose names the operators use inside."""
    df = spark.createDataFrame(ODD, SCHEMA)
    for c in ("row", "id", "h", "t", "sha", "pos", "g1", "b1", "bucket", "n", "size", "score", "rank", "term", "part", "block", "docs", "place", "kept"):
        df = df.withColumn(c, F.lit(1))
    return df.withColumns({c: F.lit(v).cast("string") for c, v in ({"source": "s", "lang": None} | more).items()})


# ---- 11 ----


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def grams(t):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t)) if x]
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def plain_resampling(docs, target, percent=25, least=20):
    code = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(code, grams(x)[1]))
    for x in target:
        t.update(map(code, grams(x)[1]))
    all_s, all_t = sum(s.values()) + 10_000.0, sum(t.values()) + 10_000.0
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * all_s / ((s[b] + 1.0) * all_t)))
    rows = []
    for n, (d, x) in enumerate(docs):
        w, f = grams(x)
        weight = sum(gain(code(g)) for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w), n])
    own = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[6]))
    for k, r in enumerate(own[: percent * len(own) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


def test_resampling_by_brute_force(spark):
    rng = np.random.default_rng(1)
    docs = [(k, " ".join(rng.choice(["Ab", "cd,", "ef-g", "h1", "É", "aa", "bb"], int(rng.integers(0, 60))))) for k in range(300)] + ODD + [(7, "same words " * 20)] * 3
    target = ["ab cd ab", None, "h1 aa É", ""]
    tables = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(t,) for t in target], "text string")
    columns = ("doc_id", "n_features", "weight", "score", "rank")
    got = importance_ngrams.resampled(*tables)
    assert got.columns == list(columns) and {t for _, t in got.dtypes} == {"bigint"}
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == plain_resampling(docs, target)
    none = tables[0].where("false")
    assert importance_ngrams.resampled(none, tables[1]).count() == 0
    alone = importance_ngrams.resampled(odd(spark), tables[1].where("false"))
    assert Counter(tuple(r[c] for c in columns) for r in alone.collect()) == plain_resampling(ODD, [])


def test_positions_hold_all_orders(spark):
    rows = spark.createDataFrame([(1, 10, "a b c"), (2, 20, "d"), (3, 30, None)], "row long, id long, text string")
    got = {(r["row"], r["pos"]): (r["g1"], r["g2"], r["g3"]) for r in importance_ngrams.positions(rows, 3).collect()}
    assert got == {(1, 0): ("a", "a b", "a b c"), (1, 1): ("b", "b c", None), (1, 2): ("c", None, None), (2, 0): ("d", None, None), (3, None): (None, None, None)}
    plan = importance_ngrams.bucketed(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the window finds its rows where the texts went


# ---- 12 ----


def plain_audit(docs, least=30, ranks=50):
    df, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        own = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text))
        df[lang].update(set(own))
        count[lang, source].update(own)
        groups[lang].add(source)
    out = Counter()
    bytewise = lambda x: x.encode()
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        v = len(kept)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (n + 5 * v) for t in kept}

        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted(((sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s), key=lambda x: (-x[0], bytewise(x[1])))
            terms = sorted(((p[s][t] - q[t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], bytewise(x[1])))
            out.update((lang, s, "pair", o, f, k + 1) for k, (f, o) in enumerate(pairs))
            out.update((lang, s, "term", t, f, k + 1) for k, (f, t) in enumerate(terms[:ranks]))
    return out


def audited(df, **options):
    got = divergence_audit.audit(df, **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    return Counter(tuple(r) for r in got.collect())


def corpus(rng, n):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(80)] + ["É", "ﬁ", "日本", "zz"]
    rows = []
    for _ in range(n):
        source = f"s{int(rng.integers(9))}" if rng.random() < 0.6 else "hot"
        text = " ".join(rng.choice(words, int(rng.integers(0, 40)), p=None)) + (" Only-%s" % source)
        rows.append((["en", "de", None, "x\0y"][int(rng.integers(4))], source, text.title() if rng.random() < 0.3 else text))
    return rows + [("en", None, None), (None, "lone", ""), ("fr", "a", "one two"), ("fr", "b", "two three"), ("solo", "s", "word")]


def test_audit_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    docs = corpus(rng, 600)
    df = spark.createDataFrame(docs, "lang string, source string, text string").withColumns({c: F.lit(1) for c in ("term", "part", "item", "value", "rank", "n", "place", "share", "i", "j", "a", "b", "h", "block")})
    want = plain_audit(docs)
    assert audited(df) == want and {x[2] for x in want} == {"pair", "term"}
    assert audited(df, least=3, ranks=7, side=4, share=10) == plain_audit(docs, 3, 7)  # tiles of four sources, in many shares
    monkeypatch.setattr(divergence_audit, "HELD", 50)  # blocks of a few documents
    assert audited(df.repartition(3)) == want
    assert audited(df.where("false")) == Counter()
    assert audited(odd(spark)) == plain_audit([(None, "s", t) for _, t in ODD])
    one = odd(spark, lang="en")
    assert audited(one.unionByName(one), least=4) == plain_audit([("en", "s", t) for _, t in ODD * 2], 4)


def test_runs_are_never_cut():
    rng = np.random.default_rng(3)
    keys = sorted(int(x) for x in rng.integers(0, 30, 400))
    rows = pa.RecordBatch.from_pydict({"k": keys, "v": list(range(400))})
    for size in (1, 3, 50, 400):
        batches = [rows.slice(k, size) for k in range(0, 400, size)] + [rows.slice(0, 0)]
        got = list(divergence_audit.whole_runs(iter(batches), ["k"]))
        assert [x for b in got for x in b.column("v").to_pylist()] == list(range(400))
        ends = [(b.column("k")[0].as_py(), b.column("k")[-1].as_py()) for b in got]
        assert all(a[1] != b[0] for a, b in zip(ends, ends[1:], strict=False))


# ---- 13 ----


def plain_groups(docs):
    groups = defaultdict(list)
    for n, (d, t) in enumerate(docs):
        groups[t or ""].append((d is not None, d or 0, -n))
    out, kept = Counter(), Counter()
    for t, own in groups.items():
        best = max(own)
        sha = hashlib.sha256(t.encode()).hexdigest()
        for x in own:
            out[x[1] if x[0] else None, best[1] if best[0] else None, len(own), sha] += 1
        kept[best[1] if best[0] else None, sha] += 1
    return out, kept


def marked(df, **options):
    rows = extendible_dedup.marked(df, **options).collect()
    return Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows), Counter((r["doc_id"], r["text_sha256"]) for r in rows if r["kept"])


def test_equal_texts_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    docs = [(int(k), " ".join(rng.choice(["a", "b"], int(rng.integers(0, 6))))) for k in rng.permutation(500)] + [(1000 + k, "hot copy " * 50) for k in range(300)] + [(2000 + k, f"one {k}") for k in range(100)] + ODD
    df = spark.createDataFrame(docs, SCHEMA).repartition(7)
    want = plain_groups(docs)
    assert marked(df) == want
    assert sum(want[1].values()) == len({t or "" for _, t in docs})
    assert marked(odd(spark)) == plain_groups(ODD)
    assert marked(df.where("false")) == (Counter(), Counter())
    # keys that collide: all texts of a length share a chain, and are told apart by their bytes
    assert marked(df, key=F.length("t").cast("long")) == want
    assert marked(df, key=F.lit(7).cast("long"), bucket=1) == want
    monkeypatch.setattr(extendible_dedup, "FLUSH", 100)
    assert marked(df, bucket=200, bits=1 << 15) == want


def test_the_directory_doubles_where_buckets_are_overfull(spark):
    rng = np.random.default_rng(5)
    near = (0x123 << 52) + rng.integers(0, 1 << 30, 400)  # of one beginning: split again and again
    keys = [(int(k), 10) for k in np.concatenate([near, rng.integers(-(1 << 63), (1 << 63) - 1, 400)])] + [(-5, 5000)]
    df = spark.createDataFrame(keys, "h long, size long")
    starts = extendible_dedup.grow(df, 2, bucket=1000, most=1 << 12)
    assert starts[0] == 0 and (np.diff(starts.astype(object)) > 0).all()
    h = np.array([k for k, _ in keys], np.int64).view(np.uint64)
    at = np.searchsorted(starts, h, side="right") - 1
    size = np.array([n for _, n in keys])
    for b in np.unique(at):
        assert size[at == b].sum() <= 1000 or len(np.unique(h[at == b])) == 1
    assert len(starts) < 200
    assert len(extendible_dedup.grow(df.where("false"), 2)) == 8
