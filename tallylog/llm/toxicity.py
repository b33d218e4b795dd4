"""Toxicity scores from a learned lexicon, matched through Levenshtein automata on its trie.

The lexicon is learned from labelled training rows: beginnings of words that occur
in significantly many toxic documents and hardly in others, lengthened as long as
that costs no support. A term is a whole word, or a stem that other
letters follow.

The trie of all terms and the automata that allow one wrong, missing, added or
swapped letter are made into one deterministic automaton, state by state as texts
need it; most words leave it after a few letters. Words that match only with an
error and occur in clean training documents don't count. Each match is weighed by
its context: between quotation marks or beside a word that reports speech, it
counts for less. A logistic model of exact, misspelled and quoted matches gives
the score.

Fitting takes a bounded sample: the first ``TOXIC`` toxic and ``CLEAN`` clean
labelled training rows in hash order, whole texts. Scores cover all rows and whole
texts; labels, language, source and id are no part of them. Defined results: null
and empty texts have no matches; null ids are not held out; an id labelled both ways
is toxic, and of an id's texts the smallest is learned from, each once; without labels
of both kinds the score is 0 for all; an empty table gives an empty result. Only the named
columns are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD_ALNUM, dropped, slices, written

TOXIC, CLEAN = 2000, 6000
#: Lengths of beginnings (longer words are terms as a whole), significance (log10) that a term needs.
SHORTEST, LONGEST, SIGNIFICANCE = 3, 32, -6.0
#: How much likelier a term is in toxic documents than in clean ones; below STRONG it is weak and counts only with others.
TELLING, STRONG = 8, 100
#: A term is lengthened while this share of its documents stays; words from FUZZY and stems from FUZZY_STEM letters on match with one error.
KEPT_SHARE, MAIN_SHARE, FUZZY, FUZZY_STEM = 0.95, 0.75, 5, 5
WINDOW = 6
#: Quotation marks, words that report speech (en, fr, de, es), and digits and signs in place of letters.
QUOTES = "\"“”„«»‘’‹›"
REPORTING = frozenset("said says called word term quote quoted wrote dit mot terme citation sagte wort begriff zitat dijo palabra término cita".split())
LOOKALIKES = str.maketrans("0134578@$", "oieastbas")
PIECES = re.compile(r"[^\W_]+")


#: Kinds of matches, the best first.
STRONGLY, WRONGLY, WEAKLY, NONE = range(4)


@dataclass
class Lexicon:
    """Terms in a trie; ``match`` runs the lazily built automaton."""

    words: list[str]
    stems: list[str]
    weak: frozenset[str] = frozenset()
    ignored: frozenset[str] = frozenset()
    moves: dict = field(default_factory=dict)
    sets: list = field(default_factory=list)
    inside: list = field(default_factory=list)
    nearly: list = field(default_factory=list)
    numbers: dict = field(default_factory=dict)

    def __post_init__(self):
        self.children, self.end, self.stem, self.fuzzy, self.faint, self.bent = [{}], [False], [False], [False], [False], [False]
        for terms, mark in ((self.words, self.end), (self.stems, self.stem)):
            for term in terms:
                at = 0
                for c in term:
                    if c not in self.children[at]:
                        self.children[at][c] = len(self.children)
                        self.children.append({})
                        for x in (self.end, self.stem, self.fuzzy, self.faint, self.bent):
                            x.append(False)
                    at = self.children[at][c]
                mark[at] = True
                self.faint[at] = term in self.weak
                self.fuzzy[at] |= mark is self.end and len(term) >= FUZZY and term not in self.weak
                self.bent[at] |= mark is self.stem and len(term) >= FUZZY_STEM and term not in self.weak
        self.start = self.number(frozenset([(0, 0, "")]))

    def __getstate__(self):
        return self.words, self.stems, self.weak, self.ignored

    def __setstate__(self, state):
        self.words, self.stems, self.weak, self.ignored = state
        self.moves, self.sets, self.inside, self.nearly, self.numbers = {}, [], [], [], {}
        self.__post_init__()

    def number(self, states: frozenset) -> int:
        """States are (trie node, errors, letter owed by a swap)."""
        if states not in self.numbers:
            self.numbers[states] = len(self.sets)
            self.sets.append(states)
            self.inside.append(next((STRONGLY if not self.faint[n] else WEAKLY for n, e, _ in states if self.stem[n] and not e), None))
            self.nearly.append(any(self.bent[n] and e and not o for n, e, o in states))
        return self.numbers[states]

    def step(self, at: int, c: str) -> int:
        found = set()
        for node, errors, owed in self.sets[at]:
            below = self.children[node]
            if owed:
                if owed == c:
                    found.add((node, errors, ""))
                continue
            if c in below:
                found.add((below[c], errors, ""))
            if not errors:
                found.add((node, 1, ""))  # an added letter
                for d, child in below.items():
                    found.add((child, 1, ""))  # a wrong letter
                    if c in self.children[child]:
                        found.add((self.children[child][c], 1, ""))  # a missing letter
                        if c != d:
                            found.add((self.children[child][c], 1, d))  # two letters swapped
        return self.number(frozenset(found))

    def match(self, word: str) -> int:
        """STRONGLY, WRONGLY (with an error), WEAKLY, or NONE."""
        at, wrong = self.start, False
        for c in word:
            wrong |= self.nearly[at]  # a stem with an error, and more letters
            if (kind := self.inside[at]) is not None:  # a stem, and more letters
                return kind
            nxt = self.moves.get((at, c))
            if nxt is None:
                nxt = self.moves[at, c] = self.step(at, c)
            at = nxt
            if not self.sets[at]:
                return WRONGLY if wrong and word not in self.ignored else NONE
        states = self.sets[at]
        for n, e, _ in states:
            if self.end[n] and not e:
                return WEAKLY if self.faint[n] else STRONGLY
        fuzzy = wrong or any(self.fuzzy[n] and not o for n, e, o in states) or any(not e and any(self.fuzzy[m] for m in self.children[n].values()) for n, e, _ in states)
        return WRONGLY if fuzzy and word not in self.ignored else NONE

    def chunk(self, chunk: str) -> tuple[int, str]:
        """The best match within a white-space separated chunk, and the piece that matches."""
        lowered = chunk.lower()
        pieces = PIECES.findall(lowered)
        folded = lowered.strip(".,;:!?()[]{}*#%&" + QUOTES).translate(LOOKALIKES)
        best = (NONE, "")
        for p in dict.fromkeys([*pieces, folded]):
            if p and (kind := self.match(p)) < best[0]:
                best = (kind, p)
        return best


def hits(texts: pa.Array, lexicon: Lexicon) -> list[list[tuple[int, float, str]]]:
    """For each text its matches: kind, weight by context, and the piece."""
    chunks = pc.ascii_split_whitespace(texts)
    coded = chunks.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    found = [lexicon.chunk(w) for w in words]
    kind = np.fromiter((k for k, _ in found), np.int64, len(found))
    which = coded.indices.to_numpy(zero_copy_only=False)
    at = np.flatnonzero(kind[which] < NONE) if len(which) else np.empty(0, np.int64)
    ends = chunks.offsets.to_numpy()
    text = np.searchsorted(ends, at, side="right") - 1
    out: list[list[tuple[int, float, str]]] = [[] for _ in range(len(texts))]
    for i, t in zip(at.tolist(), text.tolist(), strict=True):
        near = lambda a, b: [words[k] for k in which[max(a, ends[t]) : min(b, ends[t + 1])]]  # noqa: E731, B023
        k, piece = found[which[i]]
        out[t].append((k, context_weight(words[which[i]], near(i - WINDOW, i), near(i + 1, i + 1 + WINDOW)), piece))
    return out


def context_weight(own: str, before: list[str], after: list[str]) -> float:
    """1 for a match in plain words, less inside quotation marks or beside a reporting word."""
    quoted = lambda w, side: bool(w) and (w[0] if side else w[-1]) in QUOTES
    opened = quoted(own, True) or any(quoted(w, True) for w in before)
    closed = quoted(own, False) or any(quoted(w, False) for w in after)
    reported = any(w.lower().strip(".,:;" + QUOTES) in REPORTING for w in before[-3:])
    return (0.3 if opened and closed else 1.0) * (0.5 if reported else 1.0)


def summed(found: list[tuple[int, float, str]]) -> list[float]:
    """Strong and misspelled matches (one says nearly as much as many), weak ones, those after the first, and what context takes off."""
    strong, wrong, weak = (sum(w for k, w, _ in found if k == kind) for kind in (STRONGLY, WRONGLY, WEAKLY))
    return [1 - 0.25**strong, 1 - 0.25**wrong, math.log1p(weak), math.log1p(max(weak - 1, 0)), math.log1p(sum(1 - w for _, w, _ in found))]


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray | None  # intercept first; None: no labels to learn from

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(features))
        return 1 / (1 + np.exp(-(self.weights[0] + features @ self.weights[1:])))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Newton's method; the small ridge keeps separable labels finite."""
    x = np.concatenate((np.ones((len(x), 1)), x), axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (y - p) - ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.clip(np.linalg.solve(curve, slope), -2, 2)
    return w


def significance(a: int, b: int, share: float) -> float:
    """log10 of the chance that at least ``a`` of ``a + b`` documents are toxic at this share; the largest term bounds the tail closely enough."""
    n = a + b
    choose = math.lgamma(n + 1) - math.lgamma(a + 1) - math.lgamma(b + 1)
    return (choose + a * math.log(share) + b * math.log1p(-share)) / math.log(10)


def ratio(a: int, b: int, toxic: int, clean: int) -> float:
    return (a + 0.5) / (toxic + 1) * (clean + 1) / (b + 0.5)


def terms(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> Lexicon:
    """Words and stems from document counts (toxic, clean) of beginnings that more letters follow; whole words end in a blank."""
    share = toxic / (toxic + clean)
    good = {g for g, (a, b) in counts.items() if ratio(a, b, toxic, clean) >= TELLING and significance(a, b, share) <= SIGNIFICANCE}
    words, stems, weak, done = [], [], set(), set()
    for g in sorted(good, key=lambda g: (len(g.rstrip()), g)):
        bare = g.rstrip()
        if any(bare[:k] in done for k in range(1, len(bare) + 1)):
            continue
        while not g.endswith(" "):
            longer = [h for h in good if len(h) > len(g) and h.startswith(g) and h[-1] != " " and counts[h][0] >= KEPT_SHARE * counts[g][0]]
            if ratio(*counts[g], toxic, clean) < STRONG:  # a strong term that makes up most of a weak one stands for it
                longer += [h for h in good if len(h) > len(g) and h.startswith(g) and counts[h][0] >= MAIN_SHARE * counts[g][0] and ratio(*counts[h], toxic, clean) >= STRONG]
            if not longer:
                break
            g = max(longer, key=lambda h: (counts[h][0], -len(h)))
        if g.endswith(" "):
            words.append(g.rstrip())
        else:
            done.add(bare)  # and with it all beginnings of what it was lengthened to
            whole = [h for h in good if h.endswith(" ") and h.startswith(g) and counts[h][0] >= 0.9 * counts[g][0]]
            g = max(whole, key=lambda h: counts[h][0]) if whole else g
            (words if whole else stems).append(g.rstrip())
        if ratio(*counts[g], toxic, clean) < STRONG:
            weak.add(g.rstrip())
    return Lexicon(list(dict.fromkeys(words)), stems, frozenset(weak))


def fitted(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    marked = labels.filter(~F.coalesce(held_out, F.lit(False))).select(labels[id_col].alias("marked"), labels[label_col].alias("mark")).filter("mark IN (0, 1)")
    marked = marked.groupBy("marked").agg(F.max("mark").alias("mark"))
    first = lambda k, n: marked.filter(f"mark = {k}").orderBy(F.xxhash64("marked"), "marked").limit(n)
    chosen = F.broadcast(first(1, TOXIC).unionByName(first(0, CLEAN)))  # at most TOXIC + CLEAN rows of two numbers
    own = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    sample = written(own.join(chosen, own.id == chosen.marked).groupBy("id", "mark").agg(F.min("text").alias("text")).select("mark", "text"), "toxic-sample")
    number = {r.mark: r["count"] for r in sample.groupBy("mark").count().collect()}
    if len(number) < 2:
        dropped(sample)
        return Model(Lexicon([], []), None)
    word = F.regexp_extract_all(F.lower("text"), F.lit(WORD_ALNUM), F.lit(0))
    starts = F.expr(f"flatten(transform(words, w -> concat(array(concat(w, ' ')), CASE WHEN length(w) > {SHORTEST} THEN transform(sequence({SHORTEST}, least({LONGEST}, length(w) - 1)), k -> substring(w, 1, k)) ELSE array() END)))")
    begun = sample.select("mark", F.array_distinct(word).alias("words")).select("mark", F.explode(F.array_distinct(starts)).alias("start")).filter("length(start) >= 3")
    by_start = begun.groupBy("start").agg(F.sum("mark").alias("a"), F.sum(1 - F.col("mark")).alias("b"))
    likelier = F.col("a") * number[0] >= TELLING / 2 * F.col("b") * number[1]
    found = by_start.filter((F.col("a") >= 4) & likelier).collect()  # of a bounded sample
    lexicon = terms({r.start: (int(r.a), int(r.b)) for r in found}, number[1], number[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mark, own in zip(batch.column(0).to_pylist(), hits(batch.column(1), lexicon), strict=True):
                yield pa.RecordBatch.from_pydict({"mark": [mark], "kinds": [[k for k, _, _ in own]], "weights": [[w for _, w, _ in own]], "pieces": [[p for _, _, p in own]]}, MATCHES)

    # No more rows than the sample has.
    rows = sample.select(F.col("mark").cast("long"), "text").mapInArrow(run, "mark long, kinds array<long>, weights array<double>, pieces array<string>").collect()
    dropped(sample)
    clean = {p for r in rows if not r.mark for k, p in zip(r.kinds, r.pieces, strict=True) if k == WRONGLY}
    lexicon.ignored = frozenset(clean)
    x = np.array([summed([h for h in zip(r.kinds, r.weights, r.pieces, strict=True) if h[0] != WRONGLY or h[2] not in clean]) for r in rows])
    w = logistic(x, np.array([r.mark for r in rows], float))
    # Fixed, not fitted: misspellings are too rare in a sample to weigh, and those found in clean texts don't count; the others tell nearly as much as the words.
    w[2] = max(w[2], 0.9 * w[1])
    return Model(lexicon, w)


MATCHES = pa.schema([("mark", pa.int64()), ("kinds", pa.list_(pa.int64())), ("weights", pa.list_(pa.float64())), ("pieces", pa.list_(pa.string()))])


def toxicity(docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; ``held_out`` makes the condition from an id column."""
    model = fitted(docs, labels, held_out(labels[id_col]), id_col, text_col, label_col)
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(held_out(docs[id_col]), F.lit(False)).alias("held_out"), F.coalesce(docs[text_col], F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, stop in slices(batch.column(2)):
                part = batch.slice(begin, stop - begin)
                score = model.score(np.array([summed(own) for own in hits(part.column(2), model.lexicon)]).reshape(-1, 5))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
