"""Grouping of spelling variants by forward and backward minimal acyclic automata.

Two words are near if one inserted, deleted or replaced code point tells them apart. That
error lies in one half, so the other half matches exactly: from the front in an automaton
of the words, from the back in one of the reversed words. Each is walked along the exact
half and completed with one error; what both find counts once. States carry how many words
they lead to, so a path adds up to the number of its word.

Words meet by their exact half and its length, in whichever task that falls; a task builds
automata over CHUNK words at a time. Halves that more than CROWD words share are dealt out
in parts: each part's words go to one automaton, and all words that share the half are
looked up in every part. No group is larger than that, and no pair of words is made that is
not near.

Null texts have no words, null ids are written as nothing. Repeated rows are counted as
often as they occur. Equal counts go to the smaller word in code-point order. Empty tables
give no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dropped, lower_ascii, written

RUN = r"[A-Za-zÀ-ÿ]+"
#: Words to an automaton, and words that share a half from which on it is dealt out in parts.
CHUNK, CROWD = 50_000, 50_000
FOUND = "word string, near string, near_n long"
LETTERS = 0x110000


# --- words ------------------------------------------------------------------------------------------


def word_counts(docs: DataFrame, id_col: str, text_col: str, typo_of: int, least_chars: int, least_n: int) -> DataFrame:
    """(word, n): runs of letters of all texts, one in ``typo_of`` of a text's different runs with a code point deleted."""
    # What is deleted leaves at least ``least_chars``, so shorter runs go before they are counted.
    every = F.regexp_extract_all(lower_ascii(docs[text_col]), F.lit(RUN), F.lit(0))
    runs = docs.select(docs[id_col].cast("string").alias("id"), F.explode(F.filter(every, lambda r: F.length(r) >= least_chars)).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), "run").cast("binary")))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % typo_of == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_n)


# --- automata ---------------------------------------------------------------------------------------


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points (words, longest), padded with 0, and lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    cells = np.zeros((len(words), int(sizes.max(initial=0))), np.int64)
    of = np.repeat(np.arange(len(words)), sizes)
    cells[of, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return cells, sizes


def stirred(x: np.ndarray, k: int) -> np.ndarray:
    z = (x + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ z >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ z >> np.uint64(32)


class Automaton:
    """The minimal acyclic automaton of sorted, distinct words; word k is the one whose path adds up to k.

    States that accept the same endings are one; endings are compared by hashes of 128 bits.
    """

    def __init__(self, words: list[str]):
        cells, sizes = letters_of(words)
        n, longest = cells.shape
        same = (cells[1:] == cells[:-1]) & (np.arange(longest) < np.minimum(sizes[1:], sizes[:-1])[:, None])
        shared = np.concatenate(([0], np.cumprod(same, axis=1).sum(axis=1))) if n else np.zeros(0, np.int64)
        # The tree of beginnings: each state by the first word that runs through it, depth by depth.
        node, starts = np.zeros(n, np.int64), [np.zeros(1, np.int64)]
        parents, letters, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.array([bool(n) and sizes[0] == 0])]
        count = 1
        for d in range(1, longest + 1):
            first = (sizes >= d) & ((shared < d) | (np.arange(n) == 0))
            parents.append(node[first])
            letters.append(cells[first, d - 1])
            ends.append(sizes[first] == d)
            starts.append(count + np.arange(np.count_nonzero(first)))
            node = np.where(sizes >= d, count + np.cumsum(first) - 1, node)
            count += np.count_nonzero(first)
        end = np.concatenate(ends)
        below, marks = end.astype(np.int64), [stirred(end.astype(np.uint64), 1), stirred(end.astype(np.uint64), 2)]
        for d in range(longest, 0, -1):
            own = slice(starts[d][0], starts[d][-1] + 1) if len(starts[d]) else slice(0, 0)
            np.add.at(below, parents[d], below[own])
            for k, mark in enumerate(marks):
                np.add.at(mark, parents[d], stirred(mark[own] ^ stirred(letters[d].astype(np.uint64), 3 + k), 5 + k))
        _, keep, state = np.unique(np.stack(marks, axis=1), axis=0, return_index=True, return_inverse=True)
        parent, letter, child = np.concatenate(parents), np.concatenate(letters), np.arange(1, count)
        own = keep[state[parent]] == parent
        source, letter, target = state[parent[own]], letter[own], state[child[own]]
        order = np.lexsort((letter, source))
        source, self.letter, self.target = source[order], letter[order], target[order]
        self.start, self.end, self.below = int(state[0]), end[keep], below[keep]
        #: Arcs of a state lie together; ``key`` is in ascending order.
        self.key = source * LETTERS + self.letter
        self.first = np.searchsorted(source, np.arange(len(keep)))
        self.arcs = np.bincount(source, minlength=len(keep))
        over = np.cumsum(self.below[self.target]) - self.below[self.target]
        #: What an arc adds to the word's number: the words that end before it or take arcs before it.
        self.adds = over - over[self.first[source]] + self.end[source] if len(source) else over

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Arcs taken and which exist."""
        if not len(self.key):
            return np.zeros(len(state), np.int64), np.zeros(len(state), bool)
        key = state * LETTERS + letter
        arc = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return arc, self.key[arc] == key

    def near(self, cells: np.ndarray, size: int, exact: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, word number) of words that begin with the first ``exact`` letters of a query and then have one letter more or one other letter.

        ``cells`` are queries of ``size`` letters. What has a letter less is found from the other side.
        """
        query, state = np.arange(len(cells)), np.full(len(cells), self.start)
        number = np.zeros(len(cells), np.int64)
        late = (np.zeros(0, np.int64),) * 3  # query, state, number of what already has its error
        for at in range(size + 1):
            if at >= exact:
                of, arc = self.branches(state)
                more = query[of], self.target[arc], number[of] + self.adds[arc]  # an inserted letter
                late = tuple(np.concatenate(x) for x in zip(late, more, strict=True))
            if at == size:
                break
            q, s, w = late
            arc_late, ok = self.step(s, cells[q, at])
            late = q[ok], self.target[arc_late[ok]], w[ok] + self.adds[arc_late[ok]]
            if at >= exact:  # another letter in its place
                other = self.letter[arc] != cells[query[of], at]
                more = tuple(x[other] for x in more)
                late = tuple(np.concatenate(x) for x in zip(late, more, strict=True))
            arc, ok = self.step(state, cells[query, at])
            query, state, number = query[ok], self.target[arc[ok]], number[ok] + self.adds[arc[ok]]
        q, s, w = late
        return q[self.end[s]], w[self.end[s]]

    def branches(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All arcs of states: the place of the state among ``state`` and the arc."""
        n = self.arcs[state]
        of = np.repeat(np.arange(len(state)), n)
        return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + self.first[state][of]


# --- near words -------------------------------------------------------------------------------------


def shards(words: DataFrame, least_chars: int) -> DataFrame:
    """(side, half, part, known, asked, text, n): ``known`` words are for the automaton of their half and part, ``asked`` ones to be looked up there.

    A word of l letters is asked among words of l and l + 1; so it is also known where words of l - 1 are asked.
    """
    size = F.length("word")
    of = F.explode(F.filter(F.array(size, size - 1), lambda x: x >= least_chars)).alias("size")
    sides = F.explode(F.array(F.struct(F.lit("front").alias("side"), F.col("word").alias("text")), F.struct(F.lit("back").alias("side"), F.reverse("word").alias("text"))))
    both = words.select("n", "word", of).select("n", "size", sides.alias("x")).select("n", "size", "x.*")
    exact = exact_letters(F.col("side"), F.col("size"))
    keyed = both.select("side", F.concat_ws(":", "side", F.col("size").cast("string"), F.substring(F.col("text"), F.lit(1), exact)).alias("half"), "text", "n", (F.length("text") == F.col("size")).alias("asked"))
    crowds = keyed.groupBy("half").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > CROWD).select("half", F.ceil(F.col("many") / CROWD).cast("int").alias("parts"))
    dealt = keyed.join(crowds, "half", "left")
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("text"), parts).cast("int")
    every = F.when(F.col("asked"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own))
    return dealt.select("side", "half", "text", "n", "asked", own.alias("own"), F.explode(every).alias("part")).select("side", "half", "part", (F.col("own") == F.col("part")).alias("known"), "asked", "text", "n")


def exact_letters(side: Column, size: Column) -> Column:
    return F.when(side == "front", F.floor(size / 2)).otherwise(F.ceil(size / 2)).cast("int")


class Lookups:
    """The words of some halves of one side, and what is to be looked up among them."""

    def __init__(self, side: str):
        self.side, self.known, self.asked, self.automaton = side, {}, [], None

    def found(self) -> Iterator[pa.RecordBatch]:
        """Near pairs, both ways round if their lengths differ."""
        if not self.asked:
            return
        if self.automaton is None:
            self.words = sorted(self.known)
            self.counts = np.fromiter(map(self.known.__getitem__, self.words), np.int64, len(self.words))
            self.automaton = Automaton(self.words)
        by_size: dict[int, list[tuple[str, int]]] = {}
        for text, n in self.asked:
            by_size.setdefault(len(text), []).append((text, n))
        for size, own in by_size.items():
            cells, _ = letters_of([t for t, _ in own])
            queries, numbers = self.automaton.near(cells, size, size // 2 if self.side == "front" else -(-size // 2))
            word, near, near_n = [], [], []
            for q, k in zip(queries.tolist(), numbers.tolist(), strict=True):
                (text, n), other = own[q], self.words[k]
                word.append(text)
                near.append(other)
                near_n.append(int(self.counts[k]))
                if len(other) > size:
                    word.append(other)
                    near.append(text)
                    near_n.append(n)
            if self.side == "back":
                word, near = [x[::-1] for x in word], [x[::-1] for x in near]
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.string()), pa.array(near_n, pa.int64())], names=["word", "near", "near_n"])
        self.asked = []


def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of rows of ``shards``, sorted by half and part, known words first."""
    now, last = Lookups("front"), None
    for batch in batches:
        for side, half, part, known, asked, text, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (half, part) != last:
                if side != now.side or len(now.known) >= CHUNK or now.automaton is not None:
                    yield from now.found()
                    now = Lookups(side)
                last = half, part
            if known:
                now.known[text] = n
            if asked:
                now.asked.append((text, n))
                # Beyond the known words of a part come those of the other parts, as many as there are.
                if not known and len(now.asked) >= 2 * CHUNK:
                    yield from now.found()
    yield from now.found()


def near_words(words: DataFrame, least_chars: int) -> DataFrame:
    """(word, near, near_n): each pair of near words, both ways round, once or twice."""
    dealt = shards(words, least_chars).repartition("half", "part").sortWithinPartitions("side", "half", "part", F.desc("known"))
    return dealt.select("side", "half", "part", "known", "asked", "text", "n").mapInArrow(looked_up, FOUND)


# --- forms and roots --------------------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the end of the chain. Counts rise tenfold along it, so it is short; each round halves it."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if now.join(further, "root", "left_semi").isEmpty():
            return now
        after = written(now.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
        dropped(now)
        now = after


def variants(docs: DataFrame, typo_of: int = 31, least_chars: int = 7, least_n: int = 2, times: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of at least ``least_chars`` code points and ``least_n`` occurrences."""
    words = written(word_counts(docs, id_col, text_col, typo_of, least_chars, least_n), "spelling-words")
    # A word has few near words, some hundreds at most for each letter, so one shuffle by word serves both steps.
    pairs = near_words(words, least_chars).repartition("word").dropDuplicates(["word", "near", "near_n"])
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    near = written(best.select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form"), "spelling-near")
    joined = words.join(near, "word", "left")
    formed = F.col("form_n") >= times * F.col("n")
    judged = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("form")).alias("form"), F.when(formed, F.col("form_n")).alias("form_n")), "spelling-forms")
    ends = roots(judged.filter("form IS NOT NULL").select("word", "form"))
    dropped(words, near)
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
