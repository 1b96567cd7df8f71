"""Secret scans by a trigram inverted index, in DataFrame operations only.

query_of() derives from each rule's regular expression a Boolean query over trigrams that every match must contain
(after Cox 2012). index() posts, for each trigram that some query asks for, the ids of the documents whose lower-cased
text has it. candidates() intersects the postings: the trigrams of an id are combined to a bit set before the shuffle,
and the queries are evaluated on it. scan() verifies the candidates with the expressions themselves; rules without a
mandatory trigram scan every text.

Candidates meet their texts in an equi-join, which Spark broadcasts only below its size limit and which else runs as a
sort-merge join with a runtime Bloom filter; ids only travel, but for the texts in the latter case.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.llm._common import discard, materialize


class Rule(NamedTuple):
    """A match of `pattern` counts if its group `group` has `least` characters or more. re2: the same expression for engines without possessive repetitions, if it has some."""

    kind: str
    pattern: str
    group: int
    least: int
    re2: str = ""


#: A private key through its END marker, which no other run of five dashes comes before; without one, with its header
#: lines and the base64 runs that follow. @ stands for a repetition that gives nothing back, as Java writes it with a +,
#: which needs no stack however long the key is. What follows each one begins with something that it cannot hold, so the
#: expression finds the same without, which is how RE2 reads it.
_PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]+@|-{1,4}@[^-])*@-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?:[ \t\r\n]*(?:Proc-Type|DEK-Info): ?[A-Za-z0-9,-]+){0,4}[ \t\r\n\\]*[A-Za-z0-9+/]{16}[A-Za-z0-9+/=]*@(?:[ \t\r\n\\]+@[A-Za-z0-9+/]{16}[A-Za-z0-9+/=]*@)*@(?:[ \t]*[\r\n\\]+[A-Za-z0-9+/]+={0,2})?)?"
)
PEM, PEM_RE2 = _PEM.replace("@", "+"), _PEM.replace("@", "")

#: The first three are the base kinds. Java and Python read these expressions alike.
RULES = (
    Rule("assign", r"""(?:(?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(?:(?i)", "(?i:"), 1, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # the runs of [0-9a-f]+ that have 16 characters
    Rule("pem", PEM, 0, 0, PEM_RE2),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}", 0, 0),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}", 0, 0),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}", 0, 0),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 0),
)
BASE = ("assign", "access", "hex")
MOST = 40  # strings that a part of an expression may stand for before they are given up


def _and(*qs):
    """None: everything matches."""
    qs = [q for q in qs if q is not None]
    return None if not qs else qs[0] if len(qs) == 1 else ("and", *qs)


def _or(*qs):
    """Without conjunctions of trigrams that another one is part of."""
    if any(q is None for q in qs):
        return None
    sets = [{q} if isinstance(q, str) else set(q[1:]) if q[0] == "and" and all(isinstance(x, str) for x in q[1:]) else None for q in qs]
    kept = [q for k, q in enumerate(qs) if sets[k] is None or not any(s is not None and (s < sets[k] or s == sets[k] and j < k) for j, s in enumerate(sets))]
    return kept[0] if len(kept) == 1 else ("or", *kept)


def _of(strings: set[str]):
    """Any of the strings occurs: for each, all its trigrams do."""
    each = [_and(*sorted({s[k : k + 3] for k in range(len(s) - 2)})) for s in sorted(strings)]
    return _or(*each)


def _exact(node) -> set[str] | None:
    """All strings, in lower case, that a node of the parsed expression matches, if they are few."""
    op, arg = node
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.IN:
        out: set[str] = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                out.add(chr(x).lower())
            elif kind is C.RANGE and x[1] - x[0] < MOST:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is C.SUBPATTERN:
        return _exact_all(arg[-1])
    if op is C.BRANCH:
        parts = [_exact_all(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (C.MAX_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, inner = arg
        own = _exact_all(inner)
        if own is None or high > 5:
            return None
        out, power = {""} if low == 0 else set(), {""}
        for k in range(1, high + 1):
            power = {a + b for a in power for b in own}
            if len(power) > MOST:
                return None
            if k >= low:
                out |= power
        return out
    return None


def _exact_all(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        own = _exact(node)
        if own is None:
            return None
        out = {a + b for a in out for b in own}
        if len(out) > MOST:
            return None
    return out


def _query(nodes):
    out, run = [], {""}
    for node in nodes:
        own = _exact(node)
        if own is not None and len(both := {a + b for a in run for b in own}) <= MOST:
            run = both
            continue
        out.append(_of(run))
        run = own if own is not None else {""}
        op, arg = node
        if own is None:
            if op is C.SUBPATTERN:
                out.append(_query(arg[-1]))
            elif op is C.BRANCH:
                out.append(_or(*[_query(x) for x in arg[1]]))
            elif op in (C.MAX_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] > 0:
                out.append(_query(arg[2]))
    return _and(*out, _of(run))


def query_of(pattern: str):
    """The Boolean trigram query of an expression: a trigram, ("and", ...), ("or", ...), or None if it has none."""
    return _query(parser.parse(pattern))


def trigrams_of(query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1:]))


def _evaluate(query, bits: dict[str, Column]) -> Column:
    if isinstance(query, str):
        return bits[query]
    parts = [_evaluate(q, bits) for q in query[1:]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


def _each(names: list[str]) -> str:
    """An expression that is found, empty, wherever one of the trigrams begins, and captures it: one pass finds all, overlapping ones too."""
    quote = lambda c: c if c.isalnum() else "\\" + c
    trie: dict[str, dict[str, str]] = {}
    for a, b, c in names:
        trie.setdefault(a, {})[b] = trie.get(a, {}).get(b, "") + quote(c)
    return "(?=(" + "|".join(quote(a) + "(?:" + "|".join(f"{quote(b)}[{c}]" for b, c in sorted(rest.items())) + ")" for a, rest in sorted(trie.items())) + "))"


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings (trigram, id): for each trigram that the rules' queries name, the documents that have it in lower case."""
    names = sorted(set().union(*[trigrams_of(query_of(r.pattern)) for r in rules]))
    low = F.lower(F.col("t"))
    found = F.array_distinct(F.regexp_extract_all(low, F.lit(_each(names)), F.lit(1))) if names else F.array().cast("array<string>")
    return docs.select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("t")).select("id", F.explode(found).alias("trigram"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, <kind> boolean ...) for the documents that fulfil the query of a rule, by intersecting the postings."""
    queries = {r.kind: q for r in rules if (q := query_of(r.pattern)) is not None}
    names = sorted(set().union(*map(trigrams_of, queries.values())))
    sets = [names[k : k + 60] for k in range(0, len(names), 60)]
    bit = lambda own: F.coalesce(*[F.when(F.col("trigram") == x, F.lit(1 << k)) for k, x in enumerate(own)], F.lit(0)).cast("long")
    held = postings.groupBy("id").agg(*[F.bit_or(bit(own)).alias(f"s{n}") for n, own in enumerate(sets)])
    has = {x: F.col(f"s{n}").bitwiseAND(F.lit(1 << k)) != 0 for n, own in enumerate(sets) for k, x in enumerate(own)}
    out = held.select("id", *[_evaluate(q, has).alias(kind) for kind, q in queries.items()])
    any_of = F.lit(False)
    for kind in queries:
        any_of = any_of | F.col(kind)
    return out.where(any_of)


def _spans(t: Column, rule: Rule, order: int) -> Column:
    """Matches of a rule as array<struct(start, order, end, kind)>, in code points: lengths of what lies between and of the matches, added up."""
    rx = F.lit(rule.pattern)
    found = F.regexp_extract_all(t, rx, F.lit(0))
    gaps = F.transform(F.split(t, rule.pattern, -1), F.length)
    sizes = F.transform(found, F.length)
    kind = "struct<start:int,order:int,end:int,kind:string,match:string>"
    empty = F.expr(f"cast(array() as array<{kind}>)")

    def step(acc, x):
        start = acc["at"] + x["gap"]
        one = F.struct(start.alias("start"), F.lit(order).alias("order"), (start + x["size"]).alias("end"), F.lit(rule.kind).alias("kind"), x["found"].alias("match"))
        return F.struct((start + x["size"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    rows = F.filter(F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), found.alias("found")), lambda x: x["found"].isNotNull())
    rows = F.transform(rows, lambda x: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), x["found"].alias("found")))
    all_of = F.aggregate(rows, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]
    own = F.filter(all_of, lambda x: F.length(F.regexp_extract(x["match"], rule.pattern, rule.group)) >= rule.least) if rule.least else all_of
    return F.transform(own, lambda x: F.struct(x["start"].alias("start"), x["order"].alias("order"), x["end"].alias("end"), x["kind"].alias("kind")))


EMPTY = "cast(array() as array<struct<start:int,order:int,end:int,kind:string>>)"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with one more column `__spans`: array<struct(start, order, end, kind)> by start, then rule.

    Start and end count code points, end exclusive. Null texts have none. Ids may be null or repeated: candidates are
    found by id and every row of a candidate id is verified. All columns of docs stay as they are.
    """
    postings = materialize(index(docs, doc_id, text, rules), "postings")
    # written first: a short list is then known to be one before the join, and no text moves to meet it
    found = materialize(candidates(postings, rules), "candidates")
    discard(postings)
    marked = {r.kind for r in rules if query_of(r.pattern) is not None}
    found = found.select(F.col("id").alias("__id"), F.struct(*sorted(marked)).alias("__rules"))
    joined = docs.join(found, docs[doc_id].eqNullSafe(found["__id"]), "left")
    t = F.coalesce(F.col(text), F.lit(""))
    parts = []
    for k, r in enumerate(rules):
        test = F.col(f"__rules.{r.kind}") if r.kind in marked else t.rlike(r.pattern)
        parts.append(F.coalesce(F.when(test, _spans(t, r, k)), F.expr(EMPTY)))
    return joined.select(*[docs[c] for c in docs.columns], F.array_sort(F.flatten(F.array(*parts))).alias("__spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat(x["kind"], F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def redacted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each secret of `text` replaced by [kind]; overlapping spans are replaced together, under the first's kind. Null texts stay null; other columns stay."""
    found = scan(docs, doc_id, text, rules)
    merged = F.aggregate(
        "__spans",
        F.expr(EMPTY),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > x["start"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(*[F.try_element_at(acc, F.lit(-1))[c].alias(c) for c in ("start", "order")], F.greatest(F.try_element_at(acc, F.lit(-1))["end"], x["end"]).alias("end"), F.try_element_at(acc, F.lit(-1))["kind"].alias("kind"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    spans = F.col("__merged")
    before = lambda k: F.coalesce(F.try_element_at(F.col("__merged"), k)["end"], F.lit(0))
    parts = F.transform(
        spans,
        lambda x, k: F.concat(F.col(text).substr(F.when(k > 0, before(F.when(k > 0, k).otherwise(1))).otherwise(0) + 1, x["start"] - F.when(k > 0, before(F.when(k > 0, k).otherwise(1))).otherwise(0)), F.lit("["), x["kind"], F.lit("]")),
    )
    rest = F.col(text).substr(F.element_at(spans, -1)["end"] + 1, F.length(text))
    clean = F.when(F.size(spans) > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(F.col(text))
    return found.withColumn("__merged", merged).withColumn(text, clean).select(*docs.columns)


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans per row of docs."""
    n = lambda kind: F.size(F.filter("__spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("__spans", lambda x: x["kind"].isin(*BASE))
    own = scan(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", rules)
    return own.select("doc_id", *[n(kind) for kind in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("__spans")).alias("spans"))
