"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

learn() finds the lexicon in labelled rows: words, and stems of word families, that toxic rows hold far more often than
others; the words of a family that toxic rows hold are entries of their own, of the family's evidence. The entries form a
trie. The Levenshtein automaton of a token intersected with that trie is run as a product
automaton over the token's characters - a state is the set of (trie node, edits so far) still alive - whose states and
steps are made when first needed. Words of five letters or more match within one edit, of nine or more within two;
stems match exactly, as beginnings. Tokens that clean rows hold are never misspellings.

Families are beginnings that clean rows hold too, but seldom in more than one word: where words are made of a few
syllables, one such word says little, several say much. Their evidence is pooled: the number of a text's different words
of all families, that number for each hundred tokens, and their misspellings are inputs of the model of their own.

Each hit is weighed by its context: a window of WINDOW tokens around it that quotes it (quotation marks open and close
around it) turns a hit into a quotation. Hits, misspelt hits and quotations are added
with weights chosen by likelihood; a logistic model of that sum gives the score.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from siteweave.llm import _logit
from siteweave.llm._common import materialize
from siteweave.llm.bottomk import sketch

#: Labelled rows that are learnt from, at most: one of each labelled id. Their texts bound the lexicon too.
SAMPLE = 20_000
WINDOW = 8
#: Evidence (a log likelihood ratio) from which a hit counts fully.
SURE = 25.0
#: Beginnings of words that may be families: lengths.
SHORTEST, LONGEST = 3, 7
STATES = 100_000
KNOWN = 500_000
TOKEN = re.compile(r"[^\W_]+(?:[@$!*0-9'’-]*[^\W_]+)*")


def tokens(text: str | None) -> list[re.Match]:
    return list(TOKEN.finditer((text or "").lower()))


class Lexicon(NamedTuple):
    words: dict[str, float]
    stems: dict[str, float]
    clean: frozenset[str]
    families: dict[str, float] = {}

    def in_family(self, word: str) -> bool:
        return any(word[:k] in self.families for k in range(SHORTEST, len(word) + 1))


class Automaton:
    """Product of the Levenshtein automata of tokens with the trie of a lexicon. match(): None, or (edits, entry)."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.children: list[dict[str, int]] = [{}]
        self.word: dict[int, str] = {}
        self.stem: dict[int, str] = {}
        self.most = [0]
        for s in sorted({*lexicon.stems, *lexicon.families}):
            self.stem[self._node(s, 0)] = s
        for w in sorted(lexicon.words):
            self.word[self._node(w, self.allowed(w))] = w
        self.reset()

    @staticmethod
    def allowed(word: str) -> int:
        return 2 if len(word) >= 9 else 1 if len(word) >= 5 else 0

    def _node(self, word: str, edits: int) -> int:
        at = 0
        self.most[0] = max(self.most[0], edits)
        for c in word:
            if c not in self.children[at]:
                self.children[at][c] = len(self.children)
                self.children.append({})
                self.most.append(0)
            at = self.children[at][c]
            self.most[at] = max(self.most[at], edits)
        return at

    def reset(self) -> None:
        self.names: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.final: list[tuple[int, str] | None] = []
        self.stems_at: list[str | None] = []
        self.dead = self._state(frozenset())
        self.start = self._state(self._closed({0: 0}))

    def _closed(self, alive: dict[int, int]) -> frozenset:
        """With letters of the entry left out."""
        todo = list(alive)
        while todo:
            n = todo.pop()
            e = alive[n] + 1
            for k in self.children[n].values():
                if e <= self.most[k] and e < alive.get(k, 9):
                    alive[k] = e
                    todo.append(k)
        return frozenset(alive.items())

    def _state(self, alive: frozenset) -> int:
        if alive in self.names:
            return self.names[alive]
        self.names[alive] = at = len(self.sets)
        self.sets.append(alive)
        self.next.append({})
        ends = sorted((e, self.word[n]) for n, e in alive if n in self.word and e <= self.allowed(self.word[n]))
        self.final.append(ends[0] if ends else None)
        begun = [self.stem[n] for n, e in alive if n in self.stem and e == 0]
        self.stems_at.append(max(begun, key=len) if begun else None)
        return at

    def _step(self, state: int, c: str) -> int:
        alive: dict[int, int] = {}
        for n, e in self.sets[state]:
            for letter, k in self.children[n].items():
                cost = e + (letter != c)
                if cost <= self.most[k] and cost < alive.get(k, 9):
                    alive[k] = cost
            if e + 1 <= self.most[n] and e + 1 < alive.get(n, 9):
                alive[n] = e + 1  # a letter too many
        return self._state(self._closed(alive))

    def match(self, token: str) -> tuple[int, str] | None:
        if len(self.sets) > STATES:
            self.reset()
        at, steps, begun = self.start, self.next, None
        for c in token:
            to = steps[at].get(c)
            if to is None:
                to = steps[at][c] = self._step(at, c)
            at = to
            if at == self.dead:
                break
            begun = self.stems_at[at] or begun
        if begun:
            return 0, begun
        found = self.final[at]
        return None if found is None or (found[0] and token in self.lexicon.clean) else found


class Reader:
    """Hits of texts: plain, misspelt and quoted ones."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.automaton = Automaton(lexicon)
        self.known: dict[str, tuple[int, str] | None] = {}

    def _found(self, low: str) -> tuple[list[tuple], int]:
        known, match = self.known, self.automaton.match
        if len(known) > KNOWN:
            known.clear()
        out, k = [], -1
        for k, m in enumerate(TOKEN.finditer(low)):
            w = m.group()
            if w in known:
                found = known[w]
            else:
                found = known[w] = match(w)
            if found:
                out.append((k, m.start(), m.end(), *found))
        return out, k + 1

    def _in_context(self, low: str, out: list[tuple]) -> list[tuple[int, int, int, str, bool]]:
        if not out:
            return []
        spans = [m.span() for m in TOKEN.finditer(low)]
        done = []
        for k, a, b, edits, entry in out:
            left, right = low[spans[max(0, k - WINDOW)][0] : a], low[b : spans[min(len(spans) - 1, k + WINDOW)][1] + 1]
            done.append((a, b, edits, entry, quoted(left, right)))
        return done

    def hits(self, text: str | None) -> list[tuple[int, int, int, str, bool]]:
        """(start, end, edits, entry, quoted)"""
        low = (text or "").lower()
        return self._in_context(low, self._found(low)[0])

    def counts(self, text: str | None) -> tuple[float, ...]:
        """Plain, misspelt and quoted hits, each weighed by how surely its entry is toxic. With families also their different words, their misspellings and the number of tokens."""
        out = [0.0, 0.0, 0.0]
        lexicon = self.automaton.lexicon
        low = (text or "").lower()
        found, tokens_of = self._found(low)
        forms, slips = set(), 0
        for a, b, edits, entry, inside in self._in_context(low, found):
            if entry in lexicon.families and not inside:
                forms.add(low[a:b])
            elif lexicon.families and edits and lexicon.in_family(entry):
                slips += not inside
            else:
                gain = lexicon.words.get(entry) or lexicon.stems.get(entry) or lexicon.families[entry]
                out[2 if inside else 1 if edits else 0] += min(1.0, gain / SURE)
        return (*out, len(forms), slips, tokens_of) if lexicon.families else tuple(out)


def quoted(left: str, right: str) -> bool:
    """Quotation marks open in the window before a hit, and close in that after it."""
    for a, b in (('"', '"'), ("“", "”"), ("„", "“"), ("«", "»"), ("‘", "’")):
        if a in left and b in right and (left.count(a) % 2 == 1 if a == b else left.rfind(a) > left.rfind(b)):
            return True
    return False


class Model(NamedTuple):
    lexicon: Lexicon
    misspelt: float
    quoted: float
    weights: np.ndarray

    def inputs(self, counts: np.ndarray) -> np.ndarray:
        s = counts[:, 0] + self.misspelt * counts[:, 1] + self.quoted * counts[:, 2]
        if not self.lexicon.families:
            return np.column_stack([np.minimum(1, s), np.log1p(s)])
        forms, slips, tokens_of = counts[:, 3], counts[:, 4], np.maximum(counts[:, 5], 1)
        return np.column_stack([np.minimum(1, s), np.log1p(s), np.log1p(forms), np.log1p(100 * forms / tokens_of), np.log1p(100 * slips / tokens_of)])

    def scores(self, counts: np.ndarray) -> np.ndarray:
        return _logit.sigmoid(self.inputs(counts) @ self.weights[:-1] + self.weights[-1])


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text, mod 3, is 1."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _terms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(term, kind, y, n, forms): words (kind 0), beginnings of words (1) and beginnings of two words of a text or more (2), each once a text; the empty term counts texts."""
    got: dict[int, Counter] = {0: Counter(), 1: Counter()}
    forms: defaultdict = defaultdict(set)
    for f in frames:
        for y, t in zip(f["y"], f["text"], strict=True):
            own = {m.group() for m in TOKEN.finditer((t or "").lower())}
            stems = Counter(w[:k] for w in own for k in range(SHORTEST, min(LONGEST + 1, len(w))))
            got[int(y)].update((w, 0) for w in own)
            got[int(y)].update((s, 1) for s in stems if len(s) > SHORTEST)
            got[int(y)].update((s, 2) for s, n in stems.items() if n > 1)
            got[int(y)][("", 0)] += 1
            if y:
                for w in own:
                    for k in range(SHORTEST, min(LONGEST + 1, len(w))):
                        if len(forms[w[:k]]) < 4:
                            forms[w[:k]].add(w)
    rows = [(t, kind, y, n, sorted(forms[t]) if kind and y else []) for y, c in got.items() for (t, kind), n in c.items()]
    yield pd.DataFrame(rows, columns=["term", "kind", "y", "n", "forms"])


def _families(rows: list, strong: dict[str, int]) -> dict[str, float]:
    """Of beginnings found twice (term, t, gain), the best ones of which none begins with another, or with one of `strong`, which tell toxic texts by themselves (their number of texts), or stands for one; each as long as nearly all of its texts share it."""
    out: dict[str, float] = {}
    longer = defaultdict(list)
    for r in rows:
        longer[r["term"][:-1]].append(r)
    for r in rows:
        s, t = r["term"], r["t"]
        if any(s.startswith(x) or x.startswith(s) for x in out) or any(s.startswith(x) or x.startswith(s) and n >= 0.9 * t for x, n in strong.items()):
            continue
        while (best := max(longer[s], key=lambda x: x["t"], default=None)) and best["t"] >= 0.9 * t:
            s = best["term"]
        out[s] = r["gain"]
    return out


def _distinct(rows: DataFrame) -> DataFrame:
    """Of rows (doc_id, y, text) those that share none of their four least shingle hashes with a row of a lower id: a group of near copies is no more evidence than one of it."""

    @F.pandas_udf(ArrayType(LongType()))
    def signs(texts: pd.Series) -> pd.Series:
        return pd.Series([sketch(t, 4).view(np.int64).tolist() for t in texts])

    signed = materialize(rows.select("doc_id", F.explode(signs("text")).alias("sign")), "signs")
    first = signed.groupBy("sign").agg(F.min("doc_id").alias("least"))
    copies = signed.join(first, "sign").where("least < doc_id").select("doc_id").distinct()
    return rows.join(copies, "doc_id", "left_anti")


def learn(docs: DataFrame, labels: DataFrame, from_rows: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """The lexicon and the model, from at most SAMPLE labelled rows for which from_rows (of doc_id) holds: those of the least hashes."""
    own = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & from_rows)
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)  # so many rows at most are broadcast
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(own), "doc_id")
    # of a repeated id the row whose text has the least hash
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "y")).alias("r")).select("doc_id", "r.text", "r.y")
    rows = materialize(_distinct(materialize(rows, "labelled")).select("y", "text"), "labelled")
    terms = rows.mapInPandas(_terms, "term string, kind int, y int, n long, forms array<string>").groupBy("term", "kind")
    terms = materialize(terms.agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c"), F.size(F.array_distinct(F.flatten(F.collect_list("forms")))).alias("forms")
    ), "terms")
    total = terms.where("term = ''").select("t", "c").collect()
    t_all, c_all = (total[0][0], total[0][1]) if total else (0, 0)
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    families: dict[str, float] = {}
    if t_all and c_all:
        base = t_all / (t_all + c_all)
        p = (F.col("t") + 0.1) / (F.col("t") + F.col("c") + 0.2)
        gain = F.col("t") * F.log(p / base) + F.col("c") * F.log((1 - p) / (1 - base))
        strong = terms.where("term <> ''").select("term", "kind", (F.col("kind") == 1).alias("stem"), "forms", "t", p.alias("p"), gain.alias("gain")).where(F.col("gain") > np.log(terms.where("kind < 2").count()) + 3)
        got = strong.where((F.col("p") > 0.9) & (F.col("kind") < 2)).orderBy(F.desc("gain"), "term", "kind").collect()
        twice = strong.where((F.col("p") > 0.8) & (F.col("kind") == 2) & (F.col("forms") >= 4)).orderBy(F.desc("gain"), F.length("term"), "term").collect()
        families = _families(twice, {r["term"]: r["t"] for r in got if r["stem"] and r["forms"] >= 4})
        for r in sorted(got, key=lambda r: (len(r["term"]), r["term"])):
            if r["stem"] and r["forms"] >= 4 and not any(r["term"][:k] in stems for k in range(4, len(r["term"]))):
                stems[r["term"]] = r["gain"]
        # a family's stem is the longest beginning that nearly all of it shares
        longer = defaultdict(list)
        for r in got:
            if r["stem"] and r["forms"] >= 4:
                longer[r["term"][:-1]].append(r)
        hits = {r["term"]: r["t"] for r in got if r["stem"]}
        for s in list(stems):
            now = s
            while (best := max(longer[now], key=lambda r: r["t"], default=None)) and best["t"] >= 0.95 * hits[now]:
                now = best["term"]
            stems[now] = stems.pop(s)
        for r in got:
            if not r["stem"] and len(r["term"]) >= 3:
                words[r["term"]] = r["gain"]
        begins = lambda x: any(x[:k] in families for k in range(SHORTEST, len(x) + 1))
        stems = {s: g for s, g in stems.items() if not begins(s)}
        # a family's words are matched with edits too: all that toxic rows hold and clean rows hardly do
        family = [F.substring("term", 1, k).isin([s for s in stems if len(s) == k]) for k in sorted({len(s) for s in stems})]
        if family:
            of = terms.where((F.col("kind") == 0) & (F.col("t") > 0) & (p > 0.9) & F.greatest(*family, F.lit(False))).select("term")
            for r in of.collect():
                s = next(s for k in range(len(r["term"]), 3, -1) if (s := r["term"][:k]) in stems)
                words[r["term"]] = max(words.get(r["term"], 0.0), stems[s])
    # what clean rows hold within the reach of an entry is no misspelling
    raw = Lexicon(words, stems, frozenset(), families)
    clean = rows.where("y = 0").select("text").mapInPandas(_near(raw), "term string").distinct().collect()
    lexicon = Lexicon(words, stems, frozenset(r["term"] for r in clean), families)

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(lexicon)
        for f in frames:
            yield pd.DataFrame({"y": f["y"], "counts": [[float(x) for x in reader.counts(t)] for t in f["text"]]})

    got = rows.mapInPandas(counted, "y int, counts array<double>").toPandas()
    if got["y"].nunique() < 2:
        return Model(lexicon, 0.9, 0.25, np.array([3.0, 1.0, *[0.0] * (3 if families else 0), -3.0]))
    x, y = np.stack(got["counts"].to_numpy()).astype(float), got["y"].to_numpy(float)
    best = None
    for fuzzy in (0.9, 1.0, 0.6):
        for quote in (0.25, 0.1, 0.5, 1.0):
            trial = Model(lexicon, fuzzy, quote, np.zeros(0))
            w = _logit.fit(trial.inputs(x), y, 0.01)
            now = _logit.loss(trial.inputs(x), y, w)
            if best is None or now < best[0] - 1e-6:
                best = (now, trial._replace(weights=w))
    return best[1]


def _near(lexicon: Lexicon):
    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, seen, out = Automaton(lexicon), set(), set()
        for f in frames:
            for t in f["text"]:
                for m in TOKEN.finditer((t or "").lower()):
                    w = m.group()
                    if w not in seen:
                        seen.add(w)
                        if (found := automaton.match(w)) and found[0]:
                            out.add(w)
        yield pd.DataFrame({"term": sorted(out)}, dtype="object")

    return near


def scores(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The column of scores of docs[text]; null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    readers: dict = {}

    @F.pandas_udf(DoubleType())
    def of(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = readers.setdefault(0, Reader(shared.value.lexicon))
        for texts in frames:
            counts = np.array([reader.counts(t) for t in texts], dtype=float).reshape(len(texts), -1)
            yield pd.Series(shared.value.scores(counts), dtype="float64")

    return of(docs[text])


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted per row of docs.

    Scores read the text only. Null texts are empty; an empty text has the score of one without hits. Without labels of
    both kinds the lexicon is empty. Null ids and repeated rows are scored like others. Other columns are not looked at.
    """
    model = learn(docs, labels, ~held_out(), doc_id, text)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return own.select("doc_id", held_out().alias("held_out"), scores(own, model).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
