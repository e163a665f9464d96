"""Languages of documents and of their segments by a linear-chain conditional random field over words.

Words are observed through hashed character n-grams (those at an edge are affixes) and through themselves (a lexicon);
the field's transitions, learned with them, keep neighbouring words in one language unless the words speak against it.
Labels of single words are marginals of forward-backward, run for many documents at once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import labels
from quern.runtime import ship, spread

LANGUAGES = labels.LANGUAGES
#: The field is fitted on at most so many labelled rows a language, and at most so many characters of each.
SAMPLE_ROWS = 200
SAMPLE_CHARS = 2000
BINS = 1 << 16
GRAMS = 4
#: A document's set holds the languages of at least this share of its letters; texts of fewer letters have none.
SHARE = 0.15
LEAST_LETTERS = 40
#: Runs of fewer words in another language (names, loans) are no segment of their own.
LEAST_WORDS = 3
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_NEUTRAL = re.compile(r"[\d_/\\@=<>{}\[\]()#$%&*+|~^`]")
_STORE = 300_000
#: Longer texts are labelled in stretches of so many words, with some words more on both sides.
STRETCH = 1024
MARGIN = 64
_B = np.uint64(0x100000001B3)


def core(token: str) -> str:
    """The word of a blank-separated token; '' if it is no word (number, address, code, symbol)."""
    low = token.casefold()
    if not low.isalnum():
        start, end = 0, len(low)
        while start < end and not (low[start].isalpha()):
            start += 1
        while end > start and not (low[end - 1].isalnum() or "ऀ" <= low[end - 1] <= "෿" and low[end - 1] not in "।॥"):
            end -= 1
        low = low[start:end]
    return "" if not low or _NEUTRAL.search(low) or not any(c.isalpha() for c in low) else low


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all words' features and, of each feature, the number of its word."""
    ends = np.cumsum([len(w) + 2 for w in words])
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), "u4").astype("u8") + np.uint64(1)
    owner = np.repeat(np.arange(len(words)), np.diff(np.r_[0, ends]))
    bins, owners = [], []
    grams = np.zeros(len(points), "u8")
    for n in range(1, GRAMS + 1):
        size = len(points) - n + 1
        if size <= 0:
            break
        grams = grams[:size] * _B + points[n - 1 :]
        inside = owner[:size] == owner[n - 1 :]
        mixed = grams[inside] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
        bins.append(mixed >> np.uint64(48))
        owners.append(owner[:size][inside])
    # the word itself
    bins.append(np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), "u8", len(words)) >> np.uint64(48))
    owners.append(np.arange(len(words)))
    return np.concatenate(bins).astype("i8") & (BINS - 1), np.concatenate(owners)


class Field:
    """Weights of the field: features by language, transitions between languages."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray):
        self.weights, self.transitions = weights, transitions

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each word by language; 0 for ''."""
        out = np.zeros((len(words), len(LANGUAGES)), "f4")
        real = [i for i, w in enumerate(words) if w]
        for at in range(0, len(real), 20_000):
            some = real[at : at + 20_000]
            bins, owners = features([words[i] for i in some])
            order = np.argsort(owners, kind="stable")
            starts = np.searchsorted(owners[order], np.arange(len(some)))
            out[some] = np.add.reduceat(self.weights[bins[order]], starts, axis=0)
        return out


def marginals(potentials: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """Posteriors of each word, of texts sorted by falling length: ``potentials[text, place, language]`` (exponentials).

    With ``pairs``, also the expected number of transitions between languages.
    """
    texts, width, kinds = potentials.shape
    move = np.exp(transitions).astype("f4")
    active = np.searchsorted(-lengths, -np.arange(1, width + 1), side="right")
    forward = np.zeros((width, texts, kinds), "f4")
    now = np.full((texts, kinds), 1 / kinds, "f4") * potentials[:, 0]
    now /= now.sum(axis=1, keepdims=True)
    forward[0] = now
    for t in range(1, width):
        n = active[t]
        now = (now[:n] @ move) * potentials[:n, t]
        now /= now.sum(axis=1, keepdims=True)
        forward[t, :n] = now
    out = np.zeros((texts, width, kinds), "f4")
    expected = np.zeros((kinds, kinds))
    back = np.ones((texts, kinds), "f4")
    for t in range(width - 1, -1, -1):
        n = active[t]
        if t + 1 < width and active[t + 1]:
            m = active[t + 1]
            ahead = potentials[:m, t + 1] * back[:m]
            if pairs:
                joint = forward[t, :m]
                scale = np.einsum("ij,ij->i", joint @ move, ahead)
                expected += (joint / scale[:, None]).T @ ahead * move
            step = ahead @ move.T
            back[:m] = step / step.sum(axis=1, keepdims=True)
        mixed = forward[t, :n] * back[:n]
        out[:n, t] = mixed / mixed.sum(axis=1, keepdims=True)
    return (out, expected) if pairs else out


def potentials(scores: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(scores - scores.max(axis=-1, keepdims=True), -30, 0)).astype("f4")


def fit(rows: list[tuple[str, str]], seed: int = 11, epochs: int = 2) -> Field:
    """Field of labelled texts (language, text); some labels may be wrong.

    Texts are cut into stretches that are joined, in about half of the training sequences, to code-switched ones. After
    an epoch, texts whose words contradict their label are left out of the next.
    """
    rng = np.random.default_rng(seed)
    texts = [(LANGUAGES.index(k), [w for w in map(core, t[:SAMPLE_CHARS].split()) if w]) for k, t in rows]
    texts = [(k, w) for k, w in texts if len(w) >= 5]
    field = Field(np.zeros((BINS, len(LANGUAGES)), "f4"), np.zeros((len(LANGUAGES), len(LANGUAGES)), "f4"))
    if not texts:
        return field
    squares, move_squares = np.full(BINS, 1e-6, "f8"), 1.0
    vocabulary: dict[str, int] = {}
    for _, words in texts:
        for w in words:
            vocabulary.setdefault(w, len(vocabulary))
    bins, owners = features(list(vocabulary))
    order = np.argsort(owners, kind="stable")
    bins = bins[order]
    starts = np.r_[np.searchsorted(owners[order], np.arange(len(vocabulary))), len(bins)]
    coded = [(k, np.array([vocabulary[w] for w in words])) for k, words in texts]
    good = list(range(len(coded)))
    width = 80
    for epoch in range(epochs):
        late, mean_moves, batches = np.zeros_like(field.weights, dtype="f8"), np.zeros_like(field.transitions, dtype="f8"), 0
        pieces = []
        for i in good:
            k, words = coded[i]
            at = 0
            while at < len(words):
                n = int(rng.integers(4, 40)) if rng.random() < 0.5 else width
                pieces.append((k, words[at : at + n]))
                at += n
        by_language = {k: [j for j, p in enumerate(pieces) if p[0] == k] for k in {p[0] for p in pieces}}
        for chosen in by_language.values():
            rng.shuffle(chosen)
        rounds = max(map(len, by_language.values()))
        stream = [chosen[r % len(chosen)] for r in range(rounds) for chosen in by_language.values() if r < 2 * len(chosen)]
        rng.shuffle(stream)
        sequences, words_now, labels_now = [], [], []
        for j in stream:
            k, words = pieces[j]
            words_now.append(words)
            labels_now.append(np.full(len(words), k))
            if sum(map(len, words_now)) >= width or rng.random() < 0.4:
                sequences.append((np.concatenate(words_now)[:width], np.concatenate(labels_now)[:width]))
                words_now, labels_now = [], []
        for at in range(0, len(sequences), 64):
            batch = sorted(sequences[at : at + 64], key=lambda s: -len(s[0]))
            lengths = np.array([len(s[0]) for s in batch])
            used, inverse = np.unique(np.concatenate([s[0] for s in batch]), return_inverse=True)
            spans = [bins[starts[w] : starts[w + 1]] for w in used]
            flat = np.concatenate(spans)
            of = np.repeat(np.arange(len(used)), [len(x) for x in spans])
            scores = np.add.reduceat(field.weights[flat], np.r_[0, np.cumsum([len(x) for x in spans])[:-1]], axis=0)
            padded = np.zeros((len(batch), lengths[0], len(LANGUAGES)), "f4")
            inside = np.arange(lengths[0])[None, :] < lengths[:, None]
            padded[inside] = scores[inverse]
            posterior, expected = marginals(potentials(padded), lengths, field.transitions, pairs=True)
            wrong = posterior[inside].astype("f8")
            truth = np.concatenate([s[1] for s in batch])
            wrong[np.arange(len(truth)), truth] -= 1
            by_word = np.zeros((len(used), len(LANGUAGES)))
            np.add.at(by_word, inverse, wrong)
            held, place = np.unique(flat, return_inverse=True)
            gradient = np.stack([np.bincount(place, by_word[of, k], len(held)) for k in range(len(LANGUAGES))], axis=1) / len(batch)
            squares[held] += (gradient**2).sum(axis=1)
            step = (0.1 * gradient / np.sqrt(squares[held])[:, None]).astype("f4")
            field.weights[held] -= step
            late[held] += batches * step  # what the mean over batches lacks of this step
            observed = np.zeros_like(expected)
            for _, y in batch:
                np.add.at(observed, (y[:-1], y[1:]), 1)
            step = (expected - observed) / len(batch)
            move_squares += (step**2).sum()
            field.transitions -= (0.5 * step / np.sqrt(move_squares)).astype("f4")
            mean_moves += field.transitions
            batches += 1
        field = Field((field.weights + late / batches).astype("f4"), (mean_moves / batches).astype("f4"))
        if epoch + 1 < epochs:
            scores = np.add.reduceat(field.weights[bins], starts[:-1], axis=0)
            agree = np.zeros(len(coded))
            order = sorted(range(len(coded)), key=lambda i: -len(coded[i][1]))
            for at in range(0, len(order), 128):
                some = order[at : at + 128]
                lengths = np.array([len(coded[i][1]) for i in some])
                inside = np.arange(lengths[0])[None, :] < lengths[:, None]
                padded = np.zeros((len(some), lengths[0], len(LANGUAGES)), "f4")
                padded[inside] = scores[np.concatenate([coded[i][1] for i in some])]
                right = marginals(potentials(padded), lengths, field.transitions).argmax(axis=2) == np.array([coded[i][0] for i in some])[:, None]
                agree[some] = (right & inside).sum(axis=1) / lengths
            usual = {k: min(0.9, float(np.median([a for a, c in zip(agree, coded) if c[0] == k]))) for k, _ in coded}
            good = [i for i, (k, _) in enumerate(coded) if agree[i] >= usual[k]]
    return field


class Labeller:
    """Runs the field over batches of texts; keeps the potentials of tokens it has seen."""

    def __init__(self, field: Field):
        self.field = field
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, len(LANGUAGES)), "f4")
        self.letters = np.zeros(1024, "i8")
        self.counted = np.zeros(1024, "i8")

    def _learn(self, tokens: list[str]) -> None:
        words = [core(t) for t in tokens]
        rows = potentials(self.field.emissions(words))
        first = len(self.index)
        size = first + len(tokens)
        if size > len(self.table):
            room = max(size, 2 * len(self.table))
            self.table = np.concatenate([self.table, np.zeros((room - len(self.table), len(LANGUAGES)), "f4")])
            self.letters, self.counted = (np.concatenate([x, np.zeros(room - len(x), "i8")]) for x in (self.letters, self.counted))
        self.table[first:size] = rows
        alphabetic = np.array([sum(map(str.isalpha, t)) for t in tokens])
        self.letters[first:size] = alphabetic
        self.counted[first:size] = np.where([bool(w) for w in words], alphabetic, 0)
        self.index.update((t, first + i) for i, t in enumerate(tokens))

    def _best(self, coded: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Likeliest language of each token of each text, and its posterior; long texts go in overlapping stretches."""
        cuts = [(i, low, max(0, low - MARGIN), min(len(x), low + STRETCH + MARGIN)) for i, x in enumerate(coded) for low in range(0, len(x), STRETCH)]
        cuts.sort(key=lambda c: c[2] - c[3])
        best, sure = [np.zeros(len(x), "i8") for x in coded], [np.zeros(len(x), "f4") for x in coded]
        k = 0
        while k < len(cuts):
            width = cuts[k][3] - cuts[k][2]
            some = cuts[k : k + max(1, min(512, 150_000 // width))]
            k += len(some)
            lengths = np.array([stop - start for _, _, start, stop in some])
            inside = np.arange(width)[None, :] < lengths[:, None]
            ids = np.zeros((len(some), width), "i8")
            ids[inside] = np.concatenate([coded[i][start:stop] for i, _, start, stop in some])
            posterior = marginals(self.table[ids], lengths, self.field.transitions)
            kinds, values = posterior.argmax(axis=2), posterior.max(axis=2)
            for j, (i, low, start, _) in enumerate(some):
                high = min(len(coded[i]), low + STRETCH)
                best[i][low:high] = kinds[j, low - start : high - start]
                sure[i][low:high] = values[j, low - start : high - start]
        return best, sure

    def label(self, texts: list[str | None]):
        """(tokens, letters, language of each token, its posterior, counted letters of each token) of each text."""
        out: list = [None] * len(texts)
        at = 0
        while at < len(texts):  # in groups, so that the store may be emptied between them
            stop, size, split = at, 0, []
            while stop < len(texts) and (not split or size < 400_000):
                split.append((texts[stop] or "").split())
                size += len(split[-1])
                stop += 1
            if len(self.index) > _STORE:
                self._clear()
            new = list(dict.fromkeys(t for tokens in split for t in tokens if t not in self.index))
            if new:
                self._learn(new)
            coded = [np.fromiter(map(self.index.__getitem__, tokens), "i8", len(tokens)) for tokens in split]
            best, sure = self._best(coded)
            for i, tokens in enumerate(split):
                if len(tokens):
                    out[at + i] = (tokens, int(self.letters[coded[i]].sum()), best[i], sure[i], self.counted[coded[i]])
            at = stop
        return out


def summary(labelled) -> tuple[int, list[tuple[int, float, float]]]:
    """Letters of a text, and its languages by falling share: (language, share of letters, mean posterior)."""
    if labelled is None:
        return 0, []
    _, letters, best, sure, counted = labelled
    total = counted.sum()
    if not total:
        return letters, []
    weight = np.bincount(best, counted, len(LANGUAGES))
    certain = np.bincount(best, counted * sure, len(LANGUAGES))
    return letters, [(int(k), weight[k] / total, certain[k] / weight[k]) for k in np.argsort(-weight, kind="stable") if weight[k]]


def segments(text: str, labelled) -> list[tuple[int, int, int, float]]:
    """(start, end, language, confidence) of the stretches of a text in one language, in order, without gaps.

    A run of fewer than LEAST_WORDS words joins the stretch before it (at the beginning, the one after it).
    """
    tokens, _, best, sure, counted = labelled
    words = np.flatnonzero(counted)
    if not len(words):
        return []
    spoken = best[words]
    cuts = np.r_[0, np.flatnonzero(spoken[1:] != spoken[:-1]) + 1, len(words)]
    runs: list[list[int]] = []  # first word, language
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a >= LEAST_WORDS and (not runs or runs[-1][1] != spoken[a]):
            runs.append([a if runs else 0, int(spoken[a])])
    if not runs:
        runs = [[0, int(np.bincount(spoken, counted[words]).argmax())]]
    if len(runs) == 1:
        own = words[spoken == runs[0][1]]
        return [(0, len(text), runs[0][1], float(np.average(sure[own], weights=counted[own])))]
    cuts = np.array([a for a, _ in runs] + [len(words)])
    begins = {int(words[c]) for c in cuts[1:-1]}
    starts, place = [0], 0
    for i, token in enumerate(tokens):
        place = text.index(token, place)
        if i in begins:
            starts.append(place)
        place += len(token)
    starts.append(len(text))
    out = []
    for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        own = words[a:b][spoken[a:b] == runs[s][1]]
        out.append((starts[s], starts[s + 1], runs[s][1], float(np.average(sure[own], weights=counted[own]))))
    return out


def sample(documents: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """At most ``rows`` labelled texts of each language, chosen by a hash of their ids: (language, text)."""
    named = documents.select("doc_id", "text", labels.language(F.col("lang")).alias("language"), F.coalesce(F.lower(F.trim("domain")), F.lit("")).alias("domain")).filter(F.col("language").isin(*LANGUAGES) & (F.col("domain") != "code") & (F.length("text") >= 100))
    counts = {r[0]: r[1] for r in named.groupBy("language").count().collect()}  # at most ten rows
    if not counts:
        return []
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1 << 30, int((1 << 30) * 1.5 * rows / n)))])
    some = named.filter(hashed < share[F.col("language")]).select("language", hashed.alias("h"), F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    taken: dict[str, int] = {}
    out = []
    for r in some.orderBy("h", "text").limit(3 * rows * len(LANGUAGES)).collect():
        taken[r.language] = taken.get(r.language, 0) + 1
        if taken[r.language] <= rows:
            out.append((r.language, r.text))
    return out


SEGMENTS = "array<struct<start:int,end:int,lang:string,confidence:double>>"


def label_languages(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """Languages of each document.

    ``doc_id, language, confidence, letters, languages ARRAY<STRUCT<lang, share, confidence>>, segments ARRAY<STRUCT<start,
    end, lang, confidence>>``. ``language`` is that of most letters, whatever the labels say; texts without words (null,
    empty, numbers only) have a NULL language and no segments. ``start`` and ``end`` are offsets in the text; a document
    in one language is one segment. Whole texts are read, of any length; repeated rows give repeated results; ties go
    to the language listed first; other columns are ignored. One pass without a shuffle, after the field was fitted on
    a bounded sample (``SAMPLE_ROWS`` a language); a table without labelled texts leaves all languages equally likely.
    """
    spark = documents.sparkSession
    ship(spark)
    own = field or fit(sample(documents))
    shared = spark.sparkContext.broadcast((own.weights, own.transitions))
    piece = pa.struct([("lang", pa.string()), ("share", pa.float64()), ("confidence", pa.float64())])
    stretch = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("language", pa.string()), ("confidence", pa.float64()), ("letters", pa.int64()), ("languages", pa.list_(piece)), ("segments", pa.list_(stretch))])

    def run(batches):
        labeller = Labeller(Field(*shared.value))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = []
            for doc, text, labelled in zip(batch.column(0).to_pylist(), texts, labeller.label(texts)):
                letters, found = summary(labelled)
                if not found:
                    rows.append((doc, None, None, letters, [], []))
                    continue
                if len(found) == 1:
                    parts = [{"start": 0, "end": len(text), "lang": LANGUAGES[found[0][0]], "confidence": found[0][2]}]
                else:
                    parts = [{"start": a, "end": b, "lang": LANGUAGES[k], "confidence": c} for a, b, k, c in segments(text, labelled)]
                rows.append((doc, LANGUAGES[found[0][0]], found[0][2], letters, [{"lang": LANGUAGES[k], "share": s, "confidence": c} for k, s, c in found], parts))
            made = [pa.array([r[i] for r in rows], schema.field(i).type) for i in range(6)]
            yield pa.RecordBatch.from_arrays(made, schema=schema)

    return spread(documents.select("doc_id", "text")).mapInArrow(run, f"doc_id bigint, language string, confidence double, letters bigint, languages array<struct<lang:string,share:double,confidence:double>>, segments {SEGMENTS}")


def mislabelled(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """``doc_id, lang``: the languages (at least ``SHARE`` of the letters) of documents whose label names others.

    A label may be spelled in any way; null, empty and placeholder labels name no language. Documents of the domain
    ``code`` and texts of fewer than ``LEAST_LETTERS`` letters are never listed. Labels go through the same pass, so
    nothing shuffles; rows without an id are left out; a repeated row is listed as often as it stands in the table.
    """
    spark = documents.sparkSession
    ship(spark)
    own = field or fit(sample(documents))
    shared = spark.sparkContext.broadcast((own.weights, own.transitions))

    def run(batches):
        labeller = Labeller(Field(*shared.value))
        for batch in batches:
            docs, langs = [], []
            for doc, named, labelled in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), labeller.label(batch.column(1).to_pylist())):
                letters, found = summary(labelled)
                held = [LANGUAGES[k] for k, share, _ in found if share >= SHARE] if letters >= LEAST_LETTERS else []
                if held and held != [named]:
                    docs += [doc] * len(held)
                    langs += held
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(langs, pa.string())], ["doc_id", "lang"])

    code = F.coalesce(F.lower(F.trim("domain")) == "code", F.lit(False))
    marked = documents.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~code)
    return spread(marked.select("doc_id", "text", labels.language(F.col("lang")).alias("named"))).mapInArrow(run, "doc_id bigint, lang string")
