"""Evaluation texts inside training texts: one Aho-Corasick automaton of the items, one scan of each document.

The automaton holds every pair of neighbouring words of the normalised questions and answers, so one scan of a text gives
all places where it goes along with any item; what may be changed, missing or added is settled on those places.
"""

from __future__ import annotations

import unicodedata
from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.runtime import ship, spread

#: Share of an item's words that a stretch must hold.
SHARE = 0.5
#: Words that the runs of equal words in a stretch have at least on average ("a few words may be changed").
RUN = 4
#: Words that may be changed, missing or added at one place, and the length of the one interruption by a sentence.
SLIP = 6
SENTENCE = 60
#: Characters of the items of one automaton; a larger registry is scanned for in parts, each by one pass over the documents.
PART = 8_000_000


class _Fold(dict):
    """Characters of words stay, invisible ones go, all others are blanks."""

    def __missing__(self, code: int):
        kind = unicodedata.category(chr(code))
        value = chr(code) if kind[0] in "LMN" else None if kind in ("Cf", "Cc", "Cs", "Co") and code not in (9, 10, 11, 12, 13, 0x85) else " "
        self[code] = value
        return value


_FOLD = _Fold()


def normalise(text: str) -> str:
    """Words in lower case with single blanks between, before and after; compatibility forms are composed."""
    folded = unicodedata.normalize("NFKC", text).casefold().translate(_FOLD)
    return f" {' '.join(folded.split())} "


def offsets(text: str) -> list[tuple[int, int]]:
    """Start and end in ``text`` of each word of ``normalise(text)``."""
    spans, start, last, pending = [], None, 0, ""
    for i, char in enumerate(text):
        for out in unicodedata.normalize("NFKC", char).casefold():
            kept = _FOLD[ord(out)]
            if kept == " ":
                if start is not None:
                    spans.append((start, last))
                start = None
            elif kept:
                if start is None:
                    start = i
                last = i + 1
    if start is not None:
        spans.append((start, last))
    return spans


class Registry:
    """Items with the automaton of their pairs of neighbouring words.

    A stretch that ``_stretch`` accepts is a chain of runs of equal words. Between two runs at most two equal words
    stand alone, and at least ``RUN`` words come on each run, so half of its words and two more lie in pairs of
    neighbouring words that both texts have. No stretch falls below that, whatever wording items share. Items of
    equal normalised text are one class, found once for all of them.
    """

    def __init__(self, items: list[tuple[int, str]]):
        self.members: dict[str, list[int]] = {}
        for item, text in items:
            self.members.setdefault(normalise(text), []).append(item)
        self.texts = list(self.members)
        own = [text.split() for text in self.texts]
        self.words = {item: own[k] for k, text in enumerate(self.texts) for item in self.members[text]}
        self.own = own
        self.lengths = np.array([len(words) for words in own], "i8")
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.owner = np.repeat(np.arange(len(own)), self.lengths)  # of each word of all items in one row
        places: dict[str, list[int]] = {}
        for k, words in enumerate(own):
            for i in range(len(words) - 1):
                places.setdefault(f" {words[i]} {words[i + 1]} ", []).append(int(self.starts[k]) + i)
        self.automaton = ahocorasick.Automaton()
        for gram, pair in enumerate(places):
            self.automaton.add_word(pair, gram)
        self.automaton.make_automaton()
        # the pair ``gram`` stands at ``places[first[gram] : first[gram + 1]]``
        self.first = np.cumsum([0, *map(len, places.values())])
        self.places = np.fromiter(chain.from_iterable(places.values()), "i8", self.first[-1])
        self.need = np.maximum(1, np.minimum(SHARE * self.lengths, SHARE * self.lengths / 2 + 2))
        self.mark = np.zeros(len(self.owner) + 1, "i8")

    def hits(self, folded: str) -> tuple[np.ndarray, np.ndarray]:
        """(word of the text, word of all items) where a pair of neighbouring words begins in both."""
        found = list(self.automaton.iter(folded)) if len(self.places) else []
        if not found:
            return np.zeros(0, "i8"), np.zeros(0, "i8")
        ends, grams = np.fromiter(chain.from_iterable(found), "i8", 2 * len(found)).reshape(-1, 2).T
        blanks = np.flatnonzero(np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), "u4") == 32)
        at = np.searchsorted(blanks, ends) - 2
        counts = self.first[grams + 1] - self.first[grams]
        rows = np.repeat(self.first[grams] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return np.repeat(at, counts), self.places[rows]

    def leaks(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item, share of its words held, first word, last word + 1) of each item that the text leaks."""
        if not text:
            return []
        folded = normalise(text)
        at, place = self.hits(folded)
        if not len(at):
            return []
        # words of each item in pairs that stand anywhere in the text; each counts once
        held = np.concatenate((place, place + 1))
        order = np.arange(len(held))
        self.mark[held] = order
        some = np.bincount(self.owner[held[self.mark[held] == order]], minlength=len(self.own)) >= self.need
        if not some.any():
            return []
        kept = np.flatnonzero(some[self.owner[place]])
        kept = kept[np.argsort(self.owner[place[kept]], kind="stable")]
        at, place = at[kept], place[kept]
        owner = self.owner[place]
        # runs that can be chained have pairs at most SLIP words apart, but for one interruption: hits split into
        # clusters at wider gaps, and a stretch lies in one cluster or in two, one of which has half of its words
        fresh = np.append(True, (np.diff(at) > SLIP + 2) | (np.diff(owner) != 0))
        lows = np.flatnonzero(fresh)
        highs = np.append(lows[1:], len(at)) - 1
        sizes = self._covered(np.cumsum(fresh) - 1, place, len(lows))
        spans: dict[int, list[list[int]]] = {}
        for c in np.flatnonzero(2 * sizes >= self.need[owner[lows]]).tolist():
            k = int(owner[lows[c]])
            first = last = c
            for step in (-1, 1):  # the cluster's partners on either side
                d = c + step
                while 0 <= d < len(lows) and owner[lows[d]] == k and (at[lows[d]] - at[highs[c]] if step > 0 else at[lows[c]] - at[highs[d]]) <= SENTENCE + 2:
                    if sizes[c] + sizes[d] >= self.need[k]:
                        first, last = min(first, d), max(last, d)
                    d += step
            if first < last or sizes[c] >= self.need[k]:
                low, high = int(lows[first]), int(highs[last]) + 1
                own = spans.setdefault(k, [])
                if own and low <= own[-1][1]:
                    own[-1] = [min(low, own[-1][0]), max(high, own[-1][1])]
                else:
                    own.append([low, high])
        found, words = [], folded.split() if spans else []
        for k, own in spans.items():
            for low, high in own:
                best = self._chained(k, words, at[low:high], place[low:high] - self.starts[k])
                if best[0] >= SHARE:
                    found += [(item, *best) for item in self.members[self.texts[k]]]
        return found

    def _covered(self, groups: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
        """Different words in each group's pairs, by their first words' places."""
        wide = int(self.lengths.sum()) + 1
        different = np.unique(groups * wide + places)
        group = different // wide
        alone = np.append(np.diff(different) != 1, True)  # its second word isn't the first of another pair
        return np.bincount(group, 1 + alone, n)

    def _stretch(self, item: int, words: list[str], low: int, high: int) -> tuple[float, int, int]:
        """The share of the item's words in its best stretch of ``words[low:high]``, and where that is."""
        k = self.texts.index(f" {' '.join(self.words[item])} ")
        at, place = self.hits(f" {' '.join(words[low:high])} ")
        own = np.flatnonzero(self.owner[place] == k)
        return self._chained(k, words, at[own] + low, place[own] - self.starts[k])

    def _chained(self, k: int, words: list[str], at: np.ndarray, place: np.ndarray) -> tuple[float, int, int]:
        """The best stretch of ``words`` for class ``k``, whose pairs begin at ``place`` and in the text at ``at``.

        Runs of at least two equal words are chained in the order of both texts; between two runs each text may
        have a few words more (and once a sentence may stand in between). Words at equal places between runs count.
        """
        own = self.own[k]
        if not len(at):
            return 0.0, 0, 0
        order = np.lexsort((at, at - place))  # by diagonal
        at, place = at[order], place[order]
        begins = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(place) != 1)))
        counts = np.diff(np.append(begins, len(at))) + 1
        covered = set()
        runs = sorted(zip(at[begins].tolist(), place[begins].tolist(), counts.tolist()))
        for _, p, n in runs:
            covered.update(range(p, p + n))
        if len(covered) < min(SHARE * len(own), SHARE * len(own) / 2 + 2):  # words between runs may add the others
            return 0.0, 0, 0
        best: list[tuple[tuple[int, int, int], tuple[int, int, int]]] = []  # by run, without and with interruption: words, runs, start
        top = (0.0, 0, 0)
        for r, (i, p, n) in enumerate(runs):
            plain, broken = (n, 1, i), (-1, 1, i)
            for j in range(r - 1, -1, -1):
                a, b, m = runs[j]
                if i - a > len(own) + SENTENCE:
                    break
                # runs that overlap by common words are cut
                over = max(0, a + m - i, b + m - p)
                if over >= n or a + m - i > m - 1 or b + m - p > m - 1 or b >= p:
                    continue
                doc_gap, item_gap = i + over - (a + m), p + over - (b + m)
                if item_gap > SLIP:
                    continue
                between = sum(x == y for x, y in zip(words[a + m : i], own[b + m : p])) if 0 < doc_gap == item_gap else 0
                gain = n - over + between
                if doc_gap <= SLIP:
                    for old, is_broken in ((best[j][0], False), (best[j][1], True)):
                        if old[0] > 0 and old[0] + gain > (broken if is_broken else plain)[0]:
                            grown = (old[0] + gain, old[1] + 1, old[2])
                            plain, broken = (plain, grown) if is_broken else (grown, broken)
                elif doc_gap <= SENTENCE and best[j][0][0] + gain > broken[0]:
                    broken = (best[j][0][0] + gain, best[j][0][1] + 1, best[j][0][2])
            best.append((plain, broken))
            for score, parts, first in (plain, broken):
                if score / len(own) > top[0] and score >= parts * min(RUN, SHARE * len(own)):
                    top = (score / len(own), first, i + n)
        return top


def registry_parts(registry: DataFrame, part: int = PART) -> list[DataFrame]:
    """Items of the registry, repeated rows once, in parts of about ``part`` characters, as every executor holds one."""
    rows = registry.filter("item_id is not null and text is not null").select("item_id", "text").distinct()
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-size // part)
    return [rows.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == k) for k in range(parts)]


def leaks(documents: DataFrame, registry: DataFrame, part: int = PART) -> DataFrame:
    """Stretches of held-out items in documents: ``doc_id, item_id, share, start, end``.

    ``share`` is the part of the item's words that the stretch holds in their order, ``start`` and ``end`` are
    offsets in the document's own text. Null and empty texts and items, and items of one word, match nothing; an item
    that is repeated counts once a document with its best stretch, however many items have its text or wording; an
    item with several texts counts once for each part that holds one; other columns are ignored. One pass over the
    documents for each ``part`` characters of the registry (one for all usual ones), whose automaton each worker
    builds from the broadcast items; no shuffle of texts.
    """
    spark = documents.sparkSession
    ship(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("share", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])
    kinds = "doc_id bigint, item_id bigint, share double, start bigint, end bigint"
    rows = spread(documents.select("doc_id", "text").filter("text is not null"))

    def scan(items: DataFrame) -> DataFrame:
        pairs = [(r[0], r[1]) for r in items.orderBy("item_id", "text").collect()]
        ids = [item for item, _ in pairs]
        shared = spark.sparkContext.broadcast([(k, text) for k, (_, text) in enumerate(pairs)])

        def run(batches):
            index = Registry(shared.value)
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    best: dict[int, tuple] = {}
                    found = index.leaks(value := text.as_py())
                    if found:
                        spans = offsets(value)
                    for k, share, first, last in found:
                        if ids[k] not in best or best[ids[k]][0] < share:
                            best[ids[k]] = (share, spans[first][0], spans[min(last, len(spans)) - 1][1])
                    rows += [(doc, item, *x) for item, x in best.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], schema.field(c).type) for c in range(5)], schema=schema)

        return rows.mapInArrow(run, kinds)

    scanned = [scan(items) for items in registry_parts(registry, part)]
    if not scanned:
        return spark.createDataFrame([], kinds)
    if len(scanned) == 1:
        return scanned[0]
    # an item with several texts may stand in several parts
    best = reduce(DataFrame.unionByName, scanned).groupBy("doc_id", "item_id").agg(F.max(F.struct("share", -F.col("start"), "end")).alias("b"))
    return best.select("doc_id", "item_id", "b.share", (-F.col("b.col2")).alias("start"), "b.end")
