"""The thin queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.llm._common import table


def op1_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteweave.llm import piece_viterbi

    return piece_viterbi.round_trip(table(spark, sf_dir, "documents"))


def op2_pivot_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteweave.llm import embedding_pivots

    return embedding_pivots.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op3_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteweave.llm import quality_bayes

    return quality_bayes.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteweave.llm import genetic_packing

    return genetic_packing.packed_documents(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteweave.llm import warc

    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteweave.llm import simhash_bk

    return simhash_bk.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "kept")


def op7_bottomk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteweave.llm import bottomk

    return bottomk.compared(table(spark, sf_dir, "documents"))


def op8_toxicity_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteweave.llm import toxicity_automata

    return toxicity_automata.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_secret_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteweave.llm import secret_trigrams

    return secret_trigrams.scanned(table(spark, sf_dir, "documents"))


def op10_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteweave.llm import bloom_lm

    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    return bloom_lm.scored(table(spark, sf_dir, "documents"), held_out, once=True)


def op11_importance_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteweave.llm import importance_ngrams

    return importance_ngrams.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteweave.llm import divergence_audit

    return divergence_audit.audit(table(spark, sf_dir, "documents"))


def op13_extendible_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteweave.llm import extendible_dedup

    return extendible_dedup.marked(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_piece_viterbi": op1_piece_viterbi,
    "op2_pivot_embeddings": op2_pivot_embeddings,
    "op3_quality_bayes": op3_quality_bayes,
    "op4_genetic_packing": op4_genetic_packing,
    "op5_warc": op5_warc,
    "op6_simhash": op6_simhash,
    "op7_bottomk": op7_bottomk,
    "op8_toxicity_automata": op8_toxicity_automata,
    "op9_secret_trigrams": op9_secret_trigrams,
    "op10_bloom_lm": op10_bloom_lm,
    "op11_importance_ngrams": op11_importance_ngrams,
    "op12_divergence_audit": op12_divergence_audit,
    "op13_extendible_dedup": op13_extendible_dedup,
}

LETTERS = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _resampling_sql() -> str:
    """CRC-32 by the table of its bytes' remainders, over the distinct features; words and pairs of words by position."""
    bits = "list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)"
    octets = "list_transform(string_split(regexp_replace(hex(encode(f)), '(..)', '\\1 ', 'g'), ' ')[:-2], lambda x: CAST('0x' || x AS BIGINT))"
    crc = f"xor(list_reduce({octets}, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295)"
    return (
        f"WITH z AS (SELECT list({bits} ORDER BY i) AS t FROM range(256) r(i)), "
        f"d AS (SELECT doc_id, list_filter(regexp_extract_all({LETTERS}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents), "
        f"a AS (SELECT regexp_extract_all({LETTERS}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark), "
        "runs AS (SELECT doc_id, true AS own, unnest(w || list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS f FROM d "
        "UNION ALL SELECT NULL, false, unnest(w || list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) FROM a), "
        "n AS (SELECT doc_id, own, f, count(*) AS n FROM runs GROUP BY ALL), "
        f"b AS (SELECT f, {crc} % 10000 AS b FROM (SELECT DISTINCT f FROM n), z), "
        "s AS (SELECT b, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM n JOIN b USING (f) GROUP BY b), "
        "g AS (SELECT b, floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM s) + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM s) + 10000 AS DOUBLE)))) AS g FROM s), "
        "w AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n, CAST(floor(sum(n * g) / sum(n)) AS BIGINT) AS w FROM n JOIN b USING (f) JOIN g USING (b) WHERE own GROUP BY doc_id), "
        "c AS (SELECT doc_id, len(d.w) AS words, coalesce(n, 0) AS n_features, coalesce(w.w, 0) AS weight, coalesce(w.w, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN w USING (doc_id)), "
        "o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM c WHERE words >= 20) "
        "SELECT doc_id, n_features, weight, score, CASE WHEN r <= floor(25 * o.n / 100) THEN r END AS rank FROM c LEFT JOIN o USING (doc_id)"
    )


AUDIT_SQL = (
    f"WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {LETTERS} AS t FROM documents), "
    "w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d), "
    "c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL), "
    "k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30), "
    "g AS (SELECT DISTINCT lang, source FROM d), "
    "x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)), "
    "p AS (SELECT *, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM x), "
    "q AS (SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM k), "
    "f AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL), "
    "u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source "
    "UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q) "
    "SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u) WHERE part = 'pair' OR rank <= 50"
)

def _secrets_sql() -> str:
    """Matches, and what lies between them, by each rule's expression; positions are sums of their lengths."""
    from siteweave.llm.secret_trigrams import BASE, RULES

    q = lambda x: "'" + x.replace("'", "''") + "'"
    steps, lists = [], []
    for k, r in enumerate(RULES):
        rx = q(r.re2 or r.pattern)
        steps.append(f"regexp_extract_all(t, {rx}) AS m{k}, string_split_regex(t, {rx}) AS g{k}")
        total = lambda c, to: f"coalesce(list_sum(list_transform({c}{k}[1:{to}], lambda x: length(x))), 0)"  # noqa: B023, E731
        start = f"CAST({total('g', 'i')} + {total('m', 'i - 1')} AS INT)"
        span = f"{{'s': {start}, 'o': {k}, 'e': CAST({start} + length(m{k}[i]) AS INT), 'k': {q(r.kind)}, 'n': length(regexp_extract(m{k}[i], {rx}, {r.group}))}}"
        lists.append(f"list_filter(list_transform(range(1, len(m{k}) + 1), lambda i: {span}), lambda x: x.n >= {r.least})")
    named = lambda c: f"array_to_string(list_transform({c}, lambda x: x.k || ':' || x.s || ':' || x.e), ',')"
    base = "list_filter(a, lambda x: x.k IN (" + ", ".join(map(q, BASE)) + "))"
    counts = ", ".join(f"CAST(len(list_filter(a, lambda x: x.k = {q(b)})) AS BIGINT) AS n_{b}" for b in BASE)
    return (
        f"WITH f AS (SELECT doc_id, {', '.join(steps)} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)), "
        f"l AS (SELECT doc_id, list_sort(flatten([{', '.join(lists)}])) AS a FROM f) "
        f"SELECT doc_id, {counts}, sha256({named(base)}) AS base_sha256, {named('a')} AS spans FROM l"
    )


ORACLE_SQL: dict[str, str] = {
    "op2_pivot_embeddings": "WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0), "
    "l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9), "
    "r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x), "
    "n AS (SELECT x, count(*) AS n FROM l GROUP BY x), c AS (SELECT x, min(y) AS c FROM r GROUP BY x) "
    "SELECT vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, vec_id = c.c AS kept FROM embeddings LEFT JOIN n ON n.x = vec_id JOIN c ON c.x = vec_id",
    "op5_warc": "SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN f < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN f < page_id THEN f END AS refers_to "
    "FROM (SELECT page_id, h, CASE WHEN strlen(h) >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS f FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))",
    "op9_secret_trigrams": _secrets_sql(),
    "op11_importance_ngrams": _resampling_sql(),
    "op12_divergence_audit": AUDIT_SQL,
    "op13_extendible_dedup": "SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256 FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW w AS (PARTITION BY t)",
}
