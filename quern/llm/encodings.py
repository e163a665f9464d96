"""Texts that were decoded with a wrong character encoding: found by a trained classifier, restored by inversion.

The table's own undamaged records are garbled through every known chain of encodings, and a multinomial classifier over
hashed bigrams of the words' bytes learns to tell the chains (and undamaged words) apart. Only the chain it predicts, and
close runner-ups, are inverted and must decode strictly; what was replaced or dropped can only be reported.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.runtime import materialise, ship, spread

#: Records that the classifier is fitted on, at most (chosen by a hash of their ids), and different words of them.
SAMPLE_RECORDS = 6000
SAMPLE_WORDS = 40_000
BINS = 1 << 14
#: Log-likelihood by which a chain must beat undamaged text, in all its words of a record together.
MARGIN = 6.0
#: One in so many blanks of the sample becomes one that doesn't break.
JOINED = 40
#: Log-likelihood within which of the predicted chain a runner-up is tried too (a word of few letters fits several chains).
RUNNER_UP = 12.0
#: Times that a word must be more usual than what is left of it when characters were dropped.
RARER = 5
#: Bits of the filter that tells which words of a record have rows of evidence (more of them than needed, never fewer).
BITS = 1 << 23
#: Encodings that texts are wrongly read as, by what they really are.
READ_AS = {
    "utf-8": ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "iso8859-15", "iso8859-2", "koi8-r"),
    "cp1252": ("mac_roman", "cp437", "cp850", "cp1251", "cp1250", "koi8-r", "iso8859-2", "iso8859-5"),
    "mac_roman": ("cp1252",),
    "cp437": ("cp1252",),
    "cp850": ("cp1252",),
}
CLEAN, LOST = "clean", "lost"
_TOKEN = re.compile(r"[^ \t\r\n]+")
_TRIM = re.compile(r"^[^\w]+|[^\w]+$")
_CONTROLS = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
_EDGE = re.compile(r"^[\"'“”„«»‘’(\[{¿¡—–-]+|[\"'“”„«»‘’)\]}.,;:!?।…—–-]+$")


class Codec:
    """A single-byte encoding whose undefined bytes stand for themselves, as most programs read them."""

    def __init__(self, name: str):
        self.chars = [bytes([b]).decode(name, "ignore") or chr(b) for b in range(256)]
        self.bytes = {c: b for b, c in reversed(list(enumerate(self.chars)))}

    def decode(self, raw: bytes) -> str:
        chars = self.chars
        return "".join([chars[b] for b in raw])

    def encode(self, text: str) -> bytes:
        """Raises KeyError for a character that the encoding lacks."""
        table = self.bytes
        return bytes([table[c] for c in text])


_CODECS = {name: Codec(name) for names in [*READ_AS.values(), tuple(READ_AS)] for name in names if name != "utf-8"}


def _encode(text: str, name: str) -> bytes:
    return text.encode("utf-8") if name == "utf-8" else _CODECS[name].encode(text)


def _decode(raw: bytes, name: str) -> str:
    return raw.decode("utf-8") if name == "utf-8" else _CODECS[name].decode(raw)


def _chains() -> dict[str, tuple[tuple[str, str], ...]]:
    chains = {f"{true}>{read}": ((true, read),) for true, reads in READ_AS.items() for read in reads}
    for read in ("cp1252", "latin-1", "mac_roman"):
        chains[f"utf-8>{read}>utf-8>{read}"] = ((("utf-8", read),) * 2)
    return chains


CHAINS = _chains()
#: The chain after which control characters were stripped, so that it can't be inverted.
STRIPPED = "utf-8>latin-1>stripped"
CLASSES = [CLEAN, *CHAINS, STRIPPED]


def garble(text: str, chain: str) -> str | None:
    """``text`` after a chain; None where its characters can't go through it."""
    try:
        if chain == STRIPPED:
            return _CONTROLS.sub("", _decode(text.encode("utf-8"), "latin-1"))
        for true, read in CHAINS[chain]:
            text = _decode(_encode(text, true), read)
        return text
    except (KeyError, UnicodeError):
        return None


def invert(text: str, chain: str) -> str | None:
    """What ``text`` was before the chain; None unless every step decodes strictly."""
    if chain == STRIPPED:
        return None
    try:
        for true, read in reversed(CHAINS[chain]):
            text = _decode(_encode(text, read), true)
    except (KeyError, UnicodeError):
        return None
    return None if _CONTROLS.search(text) else text


def bigrams(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the bigrams of bytes that hold one above 127, and their places."""
    raw = raw.astype("u4")
    pair = (raw[:-1] << np.uint32(8)) | raw[1:]
    at = np.flatnonzero((raw[:-1] > 127) | (raw[1:] > 127))
    return ((pair[at] * np.uint32(2654435761)) >> np.uint32(18)).astype("i4"), at


def features(word: str) -> np.ndarray:
    """Hashed bigrams of the word's bytes, with its edges."""
    return bigrams(np.frombuffer(b"\x02" + word.encode("utf-8", "surrogatepass") + b"\x03", "u1"))[0]


def bare(word: str) -> str:
    return _EDGE.sub("", word)


def without_accents(word: str) -> str | None:
    """A word without its non-ASCII characters, if what is left is long enough to be a sign that they were dropped."""
    rest = word.encode("ascii", "ignore").decode()
    return rest if len(rest) >= 3 and rest.isalpha() and sum(c.isascii() for c in word) * 2 >= len(word) else None


class Classifier:
    """Multinomial model of the chains with the vocabulary of the records it was fitted on."""

    def __init__(self, texts: list[str]):
        counts: Counter[str] = Counter()
        for text in texts:
            counts.update(_TOKEN.findall(text))
        # blanks that don't break are rare in a sample but usual in damage, so some of its blanks become such
        trained = counts.copy()
        for text in texts:
            own = text.split()
            for at in range(len(text) % JOINED, len(own) - 1, JOINED):
                trained[f"{own[at]}\xa0{own[at + 1]}"] += 1
        words = [w for w in trained if not w.isascii()]
        words = sorted(words, key=lambda w: (-trained[w], w))[:SAMPLE_WORDS]
        table = np.full((BINS, len(CLASSES)), 0.05)
        weights = 1 + np.log(np.array([trained[w] for w in words], "f8")) if words else np.zeros(0)
        for k, name in enumerate(CLASSES):
            changed = words if k == 0 else [garble(w, name) for w in words]
            kept = [i for i, (x, w) in enumerate(zip(changed, words)) if x and (k == 0 or x != w)]
            # all words of a class at once: edges of words are no features, as they are below 128
            raw = [b"\x02" + changed[i].encode("utf-8", "surrogatepass") + b"\x03" for i in kept]
            bins, at = bigrams(np.frombuffer(b"".join(raw), "u1"))
            table[:, k] += np.bincount(bins, np.repeat(weights[kept], [len(x) for x in raw])[at], BINS)
        self.log = (np.log(table) - np.log(table.sum(axis=0))).astype("f4")
        seen_in = Counter(c for text in texts for c in set(text) if not c.isascii())
        self.alphabet = frozenset(c for c, n in seen_in.items() if n > 2)
        known = Counter()
        for word, n in counts.items():
            known[bare(word)] += n
        self.known = {w: n for w, n in known.items() if w and n > 1}
        # a known word without its non-ASCII characters, which is no word itself or far less usual (records that lost
        # characters count too): a sign of dropped characters
        self.lossy = frozenset(rest for w, n in known.items() if n > 2 and not w.isascii() and (rest := without_accents(w)) and n >= RARER * known[rest])

    def scores(self, word: str) -> np.ndarray:
        return self.log[features(word)].sum(axis=0)


def predicted(scores: np.ndarray) -> list[int]:
    """The chain that the classifier holds most likely and its close runner-ups, none where undamaged text is likelier."""
    least = max(float(scores[0]), float(scores.max()) - RUNNER_UP)
    return [k for k in np.argsort(-scores, kind="stable").tolist() if k and scores[k] > scores[0] and scores[k] >= least]


class Detector:
    """Chain and restored text of records; keeps the scores of words it has seen."""

    STORE = 200_000

    def __init__(self, model: Classifier):
        self.model = model
        self.known, self.lossy = model.known, model.lossy
        #: Results of words with numbers of their own, which hold for these words only.
        self.told: dict[str, list[tuple[str, float, str | None, bool]]] = {}
        self.kept: dict[str, list[tuple[str, float, str | None, bool]]] = {}

    def word(self, word: str) -> list[tuple[str, float, str | None, bool]]:
        """(chain, margin, restored word or None, whether the restored word is known or its decoding is proof)."""
        found = self.told[word] if word in self.told else self.kept.get(word)
        if found is None:
            found = []
            known = self.known
            seen = known.get(_EDGE.sub("", word), 0)
            is_known = seen > 2
            scores = self.model.scores(word)
            letters = any(c.isalpha() for c in word)
            for k in predicted(scores):
                name, margin = CLASSES[k], float(scores[k] - scores[0])
                before = invert(word, name)
                if name.startswith("utf-8"):
                    # strict decoding into characters that undamaged records use
                    proof = before is not None and self._proof(word, before)
                    if proof or (name == STRIPPED and not is_known):
                        found.append((name, margin, before, proof))
                elif before is not None and letters:
                    # the sample may hold damaged words too, so the restored word must be far more usual
                    plain = _EDGE.sub("", before)
                    proof = known.get(plain, 0) >= 5 * (seen + 1) and (len(plain) > 2 or known[plain] >= 50) and len(plain) + before.startswith(("¿", "¡")) >= len(_EDGE.sub("", word))
                    if len(plain) == 1 and seen:
                        proof = False  # a letter that stands alone in other records too
                    if proof or not is_known:
                        found.append((name, margin, before, proof))
            if len(self.kept) >= self.STORE:
                self.kept.clear()
            self.kept[word] = found
        return found

    def _proof(self, word: str, before: str) -> bool:
        """Whether ``before``, strictly decoded, is shorter and of characters that undamaged records use."""
        return len(before) < len(word) and all(c.isascii() or c in self.model.alphabet for c in before)

    def informed(self, word: str, known: dict[str, int]) -> list[tuple[str, float, str | None, bool]]:
        """As ``word``, by numbers of the corpus."""
        other = Detector(self.model)
        other.known = known
        return other.word(word)

    def needs(self, word: str) -> set[str]:
        """Words whose numbers in the corpus decide about ``word``."""
        scores = self.model.scores(word)
        letters = any(c.isalpha() for c in word)
        positive = [CLASSES[k] for k in predicted(scores)]
        if not positive:
            return set()
        # over all records, words of records read from UTF-8 are usual too: those that are provably damaged restore nothing
        befores = [b for name in positive if not name.startswith("utf-8") and (b := invert(word, name)) is not None]
        return {bare(word), *(bare(b) for b in befores if not any(proof for *_, proof in self.word(b)))} - {""}

    def record(self, text: str | None, replaced: int | None, restore: bool = True) -> tuple[str, str | None]:
        """(chain, or ``lost``, or ``clean``; restored text or None)."""
        if not text:
            return (LOST if replaced else CLEAN), None
        lost = bool(replaced) or "�" in text
        words = _TOKEN.findall(text)
        best = None
        if not text.isascii():
            evidence: dict[str, float] = {}
            proofs: Counter[str] = Counter()
            for word in words:
                if not word.isascii():
                    for name, margin, before, proof in self.word(word):
                        if before is not None or name == STRIPPED:
                            evidence[name] = evidence.get(name, 0.0) + min(margin, 30.0) + (4.0 if proof else 0.0)
                            proofs[name] += proof
            inverted = any(n != STRIPPED and proofs[n] for n in evidence)  # a chain that can be undone goes before one that can't
            for name in sorted(evidence, key=lambda n: (n == STRIPPED and inverted, -evidence[n], n)):
                needs = 1 if proofs[name] else 5 if name == STRIPPED else None
                enough = needs is not None and evidence[name] >= needs * MARGIN
                if enough:
                    best = name
                    break
        if best is not None:
            return best, self._restore(text, best) if restore and best != STRIPPED else None
        if lost:
            return LOST, None
        missing = sum(_EDGE.sub("", w) in self.lossy for w in words)
        return (LOST if missing >= 2 else CLEAN), None

    def _restore(self, text: str, chain: str) -> str:
        def back(match: re.Match) -> str:
            word = match.group()
            if word.isascii():
                return word
            for name, _, before, _ in self.word(word):
                if name == chain and before is not None:
                    return before
            # the record's chain is known by its other words; what decodes strictly by it was UTF-8
            before = invert(word, chain) if chain.startswith("utf-8") else None
            return before if before is not None and self._proof(word, before) else word

        return _TOKEN.sub(back, text)


_DAMAGED = re.compile(r"[\x80-\x9f]|[Ãâ][\x80-\xbf€™œ“”šž]|à[¤¥¦§®¯°±]|[ÐÑ][\x80-\xbf]")


def _undamaged(text: str) -> bool:
    return "\ufffd" not in text and not _DAMAGED.search(text)


def sample(records: DataFrame, size: int = SAMPLE_RECORDS) -> list[str]:
    """Texts of at most ``size`` records without signs of damage, the same for the same table."""
    usable = records.filter("id is not null and text is not null and text <> ''").select("id", "text", F.coalesce("broken_utf_replacement_chars", F.lit(0)).alias("b")).filter("b = 0")
    rank = F.xxhash64("id")
    total = usable.count()
    # a threshold on the hash first, so that no more than about twice the sample is ordered
    share = min(1.0, 2.0 * size / max(1, total))
    some = usable.filter(F.pmod(rank, F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(rank, "text").limit(size)
    return [r.text for r in some.select("text").collect() if _undamaged(r.text)]


def _table(rows: list[tuple], types: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(types)], [name for name, _ in types])


def corpus_counts(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbers over all records: ``word, bare, n`` (``n`` in undamaged ones; ASCII words by ``bare`` only), ``char, n``."""
    types = [("kind", pa.int32()), ("word", pa.string()), ("bare", pa.string()), ("n", pa.int64())]

    def count(batches):
        for batch in batches:
            words, others, chars = Counter(), set(), Counter()
            for text, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = _TOKEN.findall(text)
                if not b and _undamaged(text):
                    words.update(found)
                    if not text.isascii():
                        chars.update(c for c in set(text) if not c.isascii())
                else:
                    others.update(w for w in found if not w.isascii())
            own: Counter[tuple] = Counter()
            for word, n in words.items():
                own[None if word.isascii() else word, bare(word)] += n
            for word in others:
                own[word, bare(word)] += 0
            yield _table([(0, *k, n) for k, n in own.items()] + [(1, c, c, n) for c, n in chars.items()], types)

    rows = spread(records.filter("id is not null and text <> ''").select("text", F.coalesce("broken_utf_replacement_chars", F.lit(0)).alias("b"))).mapInArrow(count, "kind int, word string, bare string, n bigint")
    rows = materialise(rows.groupBy("kind", "word", "bare").agg(F.sum("n").alias("n")), "counts")
    return rows.filter("kind = 0").select("word", "bare", "n"), rows.filter("kind = 1").select(F.col("word").alias("char"), "n")


def evidence(counts: DataFrame, shared) -> DataFrame:
    """``word, known ARRAY<STRUCT<word, n>>, lossy`` of the words about which the corpus' numbers decide."""
    known = counts.groupBy("bare").agg(F.sum("n").alias("n")).filter("n > 0 and bare <> ''")

    def asks(batches):
        detector = Detector(shared.value)
        for batch in batches:
            yield _table([(w, x) for w in batch.column(0).to_pylist() for x in detector.needs(w)], [("word", pa.string()), ("bare", pa.string())])

    def decides(batches):
        for batch in batches:
            detector, rows = Detector(shared.value), []
            for word, numbers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if detector.informed(word, {x["bare"]: x["n"] for x in numbers}) != detector.word(word):
                    rows.append((word, numbers, False))
            yield _table(rows, [("word", pa.string()), ("known", batch.schema.field(1).type), ("lossy", pa.bool_())])

    def shorn(batches):
        for batch in batches:
            yield _table([(rest, n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if not w.isascii() and (rest := without_accents(w))], [("bare", pa.string()), ("most", pa.int64())])

    schema = "word string, known array<struct<bare: string, n: bigint>>, lossy boolean"
    asked = counts.filter("word is not null").select("word").mapInArrow(asks, "word string, bare string")
    told = asked.join(known.filter("n > 1"), "bare").groupBy("word").agg(F.collect_list(F.struct("bare", "n")).alias("known")).mapInArrow(decides, schema)
    rests = known.filter("n > 2").mapInArrow(shorn, "bare string, most bigint").groupBy("bare").agg(F.max("most").alias("most"))
    lossy = rests.join(known, "bare", "left").filter(F.col("most") >= RARER * F.coalesce("n", F.lit(0))).select(F.col("bare").alias("word"), F.lit(None).cast("array<struct<bare: string, n: bigint>>").alias("known"), F.lit(True).alias("lossy"))
    return told.unionByName(lossy)


def _damaged(records: DataFrame, model: Classifier | None, restore: bool) -> DataFrame:
    spark = records.sparkSession
    ship(spark)
    rows = spread(records.filter("id is not null").select("id", "text", F.col("broken_utf_replacement_chars").alias("b")))
    types = [("id", pa.string()), ("chain", pa.string()), ("restored_text", pa.string())]
    schema = "id string, chain string, restored_text string"
    own = model is None
    bits = None
    if own:
        model = Classifier(sample(records))
        counts, chars = corpus_counts(records)
        # the characters of Unicode bound this one; words stay in tables
        model.known, model.lossy, model.alphabet = {}, frozenset(), frozenset(r.char for r in chars.filter("n > 2").collect())
    shared = spark.sparkContext.broadcast(model)
    if own:
        facts = materialise(evidence(counts, shared), "evidence")
        bits = np.zeros(BITS, "?")
        bits[[r[0] for r in facts.select(F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(BITS))).distinct().collect()]] = True
        bits = np.packbits(bits)
    marks = spark.sparkContext.broadcast(bits)

    def marker():
        if marks.value is None:
            return lambda text: []
        held, kept = np.unpackbits(marks.value).tobytes(), {}

        def marked(text: str | None) -> list[str]:
            """Words of the text that may have evidence."""
            found = set()
            for word in _TOKEN.findall(text or ""):
                keys = kept.get(word)
                if keys is None:
                    keys = [k for k in {word, bare(word)} if k and held[zlib.crc32(k.encode("utf-8", "surrogatepass")) % BITS]]
                    if len(kept) >= Detector.STORE:
                        kept.clear()
                    kept[word] = keys
                if keys:
                    found.update(keys)
            return list(found)

        return marked

    def run(batches):
        detector, marked = Detector(shared.value), marker()
        for batch in batches:
            rows = []
            for key, text, replaced in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not marked(text):
                    chain, restored = detector.record(text, replaced, restore)
                    if chain != CLEAN:
                        rows.append((key, chain, restored))
            yield _table(rows, types)

    def mark(batches):
        marked = marker()
        for batch in batches:
            found = [(*r, words) for r in zip(*(batch.column(i).to_pylist() for i in range(3))) if (words := marked(r[1]))]
            yield _table(found, [("id", pa.string()), ("text", pa.string()), ("b", batch.schema.field(2).type), ("words", pa.list_(pa.string()))])

    def informed(batches):
        detector, results = Detector(shared.value), {}
        for batch in batches:
            rows = []
            for key, text, replaced, facts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if len(results) >= Detector.STORE:
                    results.clear()
                detector.told, detector.lossy = {}, set()
                for fact in facts or ():
                    word = fact["word"]
                    if fact["lossy"]:
                        detector.lossy.add(word)
                    else:
                        if word not in results:
                            results[word] = detector.informed(word, {x["bare"]: x["n"] for x in fact["known"]})
                        detector.told[word] = results[word]
                chain, restored = detector.record(text, replaced, restore)
                if chain != CLEAN:
                    rows.append((key, chain, restored))
            yield _table(rows, types)

    alone = rows.mapInArrow(run, schema)
    if not own:
        return alone
    kind = rows.schema["b"].dataType.simpleString()
    some = materialise(rows.mapInArrow(mark, f"id string, text string, b {kind}, words array<string>").withColumn("place", F.monotonically_increasing_id()), "marked")
    told = some.select("place", F.explode("words").alias("word")).join(facts, "word").groupBy("place").agg(F.collect_list(F.struct("word", "known", "lossy")).alias("facts"))
    return alone.unionByName(some.join(told, "place", "left").select("id", "text", "b", "facts").mapInArrow(informed, schema))


def inspect(records: DataFrame, model: Classifier | None = None) -> DataFrame:
    """Damaged records: ``id, chain, restored_text``.

    ``chain`` names the encodings (``utf-8>cp1252``: UTF-8 read as cp1252), or is ``lost`` where characters were
    replaced (U+FFFD, counted in ``broken_utf_replacement_chars``) or dropped; ``restored_text`` is NULL where the text
    can't be had back. Null and empty texts are damaged only where the counter says so; a null counter says nothing;
    repeated rows count once; an empty table gives no rows; other columns are ignored. The classifier is fitted on a
    bounded sample; words and characters are counted over all records, and joined to the records whose words they
    decide about. Texts of those records shuffle, the others are seen in passes only.
    """
    return _damaged(records, model, True).distinct()


def found(records: DataFrame) -> DataFrame:
    """``id`` of each damaged record; texts aren't restored, so only ids shuffle."""
    return _damaged(records, None, False).select("id").distinct()
