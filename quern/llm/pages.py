"""Main bodies of web pages: two passes of rules over the lines of a page's text, by statistics of the whole table.

The first pass decides by stop-word density, length and link density. Extracted text has no links, so what is linked is
learned: parts of lines (between separators, sentence ends and colons) that recur on a large share of the pages of the
sites that use them. Stop words are the words that most sentences of the table hold. The second pass gives each line that
is left (titles, subheadings, list items, short notes) the label of its nearest decided neighbour.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.runtime import materialise, ship, spread

#: Words that the most sentences hold, so many of them, are stop words; a line of a language is dense from this share on.
STOP_WORDS = 2000
DENSE = 0.15
#: Parts that recur on this share of the pages of their sites (and on at least SEEN pages) are linked.
LINKED = 0.25
#: Parts that recur on less than this share are the page's own; from half of it on they may end a main body only in a list.
OWN = 0.1
SEEN = 3
#: Recurring parts that one worker holds; with more, pages are read in blocks of sites, each with its own parts.
PARTS = 4_000_000
#: Characters from which on a line is no list of links, no notice and no heading.
LONG = 400
#: Characters within which a line that recurs nowhere still belongs to main text (titles and lists beside it).
REACH = 200

# Headings of lists of other pages.
TEASERS = r"(you may also like|trending now|trending|most read|most popular|related|related stories|related articles|more stories|latest from .{2,40}|recommended( for you)?|das könnte sie auch interessieren|meistgelesen|mehr zum thema|auch interessant|les plus lus|sur le même sujet|à lire aussi|à voir aussi|también le puede interesar|lo más leído|más noticias|noticias relacionadas|सबसे ज़्यादा पढ़ा गया|यह भी पढ़ें|और पढ़ें)"
# Phrases of notices, prompts, advertising and footers.
NOTICES = "|".join(
    (
        r"^©|^\(c\) ?\d{4}|\ball rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|सर्वाधिकार सुरक्षित",
        r"^powered by |is a project of the .*foundation",
        r"\bthis (web)?site uses cookies|\b(we|they) use cookies|\bwhich cookies we\b|\byour privacy matters|\bwe and our partners\b|\bmeasure how pages are used|you agree to our (policy|terms)",
        r"verwende[nt] cookies|ihre privatsphäre ist uns|stimmen sie unserer .*(richtlinie|datenschutz)",
        r"utilis(ons|e) des cookies|acceptez notre politique|respectons votre vie privée",
        r"\busa(mos)? cookies|acepta nuestra política|su privacidad nos importa",
        r"कुकीज़ का उपयोग|गोपनीयता नीति से सहमत",
        r"^get our .*(digest|newsletter)|in your inbox$|^sign up for |^subscribe (to|now|for)|^join [\d.,]+ readers",
        r"im postfach$|rundbrief bestellen|newsletter (bestellen|abonnieren)",
        r"^recevez (la|notre) lettre|^inscrivez-vous( gratuitement)?$|^abonnez-vous",
        r"^reciba (el|nuestro) bolet[ií]n|^suscríbase",
        r"साप्ताहिक पत्र पाएँ",
        r"^(search|suche nach|buscar en|rechercher (dans|sur)) .{1,40}(…|\.\.\.)$",
        r"^(tags|topics|keywords|schlagwörter|themen|mots-clés|étiquettes|etiquetas|temas|विषय|टैग) ?:",
    )
)
# Advertising and pointers to other pages that stand inside main bodies, so say nothing about their neighbours.
INSIDE = r"(advertisement|story continues below|anzeige|werbung|weiter nach der werbung|publicité|la suite après la publicité|publicidad|sigue tras la publicidad|continúa después de la publicidad|विज्ञापन)|(sponsored|advertisement|promoted|read also|see also|gesponsert|anzeige|lesen sie auch|sponsorisé|publicité|lire aussi|patrocinado|publicidad|lea también|le puede interesar|प्रायोजित|यह भी पढ़ें) ?: .*"
# A part of each phrase of NOTICES; a line without any of them is no notice.
_SIGNS = tuple(
    "©|(c)|rights reserved|rechte vorbehalten|droits réservés|derechos reservados|सर्वाधिकार|powered by|foundation|cookie|kies|privacy|partners|pages are used|agree to our|privatsphäre|stimmen sie|acceptez|respectons|acepta|privacidad|कुकीज़|गोपनीयता|get our|inbox|sign up|subscribe|join |postfach|rundbrief|newsletter|recevez|inscrivez|abonnez|reciba|suscríbase|साप्ताहिक|…|...|tags|topics|keywords|schlagwörter|themen|mots-clés|étiquettes|etiquetas|temas|विषय|टैग".split("|")
)
_TEASER = re.compile(TEASERS + r"\s*:?")
_NOTICE = re.compile(NOTICES)
_INSIDE = re.compile(INSIDE)
_TAG = re.compile(r"</?[a-zA-Z!][^<>]{0,200}>")
_MARKER = re.compile(r"^\s*(\d{1,3}[.)]|[*•·–-])\s+")
_JOINT = re.compile(r"\s[|·•/»›>]\s|\t|\s{3,}")
_SENTENCE = re.compile(r"[.!?।؟。][\"'”’»)\]]*(?=\s|$)")
_CUT = re.compile(r"\s[|·•/»›>]\s|\t|\s{3,}|(?<=[.!?।؟。…])\s+|\s?:\s+")
_DIGITS = re.compile(r"\d+")
_POINTS = ".,;:!?।\"'“”„«»()¿¡…"

GOOD, BAD, OPEN, SEMI, USUAL, FLAGGED, HEADING = "main", "chrome", "open", "rather usual", "usual", "flagged", "teaser heading"


def plain(line: str) -> str:
    """A line without left-over tags and outer blanks."""
    return (_TAG.sub(" ", line) if "<" in line else line).replace(" ", " ").strip()


def _parts(raw: str) -> tuple[tuple[int, int], ...]:
    """(hash, length) of the parts of a line that might be linked; digits don't count, and long lines have none."""
    if len(raw) >= LONG:
        return ()
    low = _DIGITS.sub("#", raw.casefold())
    found = []
    for part in _CUT.split(low):
        part = " ".join(part.split()).strip("#*•·–-☰≡×✕.,:;!?…|/»›> ")
        if part:
            found.append((xxhash.xxh3_64_intdigest(part), len(part)))
    return tuple(found)


_kept = lru_cache(maxsize=100_000)(_parts)


def parts(raw: str) -> tuple[tuple[int, int], ...]:
    return _kept(raw) if len(raw) < 120 else _parts(raw)


def is_sentence(raw: str, words: list[str]) -> bool:
    return len(words) >= 8 and _SENTENCE.search(raw) is not None


def script(word: str) -> int:
    """A number for the block of 128 characters of a word's first letter; all of Latin has one."""
    for c in word:
        if c.isalpha():
            return 0 if c < "ɐ" else ord(c) >> 7
    return -1


class Template:
    """What a table of pages has in common: its stop words, and the parts of lines that recur, with their shares."""

    def __init__(self, words: list[str], hashes: np.ndarray, shares: np.ndarray):
        self.words = frozenset(words)
        self.scripts = frozenset(map(script, words))
        order = np.argsort(hashes)
        self.hashes, self.shares = hashes[order], shares[order]
        self.share = lru_cache(maxsize=200_000)(self._share)
        self.decided = lru_cache(maxsize=100_000)(self.decide)

    def _share(self, part: int) -> float:
        at = int(np.searchsorted(self.hashes, np.uint64(part)))
        return float(self.shares[at]) if at < len(self.hashes) and self.hashes[at] == part else 0.0

    def dense(self, words: list[str]) -> bool:
        """Whether words are of running text; in scripts that hold no stop word there is no telling, so they are."""
        low = [w.strip(_POINTS) for w in words]
        if sum(map(self.words.__contains__, low)) >= DENSE * len(words):
            return True
        return not any(script(w) in self.scripts for w in low)

    def decide(self, line: str) -> str:
        """First pass over one line (which isn't blank); what it leaves open may carry a mark for the second."""
        raw = plain(line)
        if not raw:
            return OPEN
        own = parts(raw)
        shares = [self.share(h) for h, _ in own]
        low = " ".join(raw.casefold().split())
        heading = len(low) < LONG and _TEASER.fullmatch(low) is not None
        if own:
            size = sum(n for _, n in own)
            linked = [share >= LINKED for share in shares]
            if sum(n for (_, n), x in zip(own, linked) if x) * 2 >= size:
                return HEADING if heading else BAD
            pieces = [p for p in _JOINT.split(raw) if p.strip()]
            if len(pieces) > 1 and len(_SENTENCE.findall(raw)) <= 1:
                if sum(linked) * 2 >= len(own) or (len(pieces) >= 3 and all(len(p.split()) <= 4 for p in pieces) and not _SENTENCE.search(raw)):
                    return BAD
            elif linked[0] and len(own) > 1 and ":" in raw[: own[0][1] + 8]:
                return BAD  # a linked word with a colon, and what it names
        words = low.split()
        text = _MARKER.sub("", raw)
        usual = own and sum(n for (_, n), share in zip(own, shares) if share >= OWN) * 2 >= size
        if not usual and (is_sentence(text, words) or len(words) >= 40) and self.dense(words):
            return GOOD
        if heading:
            return HEADING
        if _INSIDE.fullmatch(low) or (any(sign in low for sign in _SIGNS) and _NOTICE.search(low)):
            return FLAGGED
        return USUAL if usual else SEMI if max(shares, default=0) >= OWN / 2 and not _MARKER.match(raw) else OPEN

    def chrome(self, text: str | None) -> list[int]:
        """Numbers (from 0, lines split at ``\\n``) of the lines that aren't blank and don't belong to the main body."""
        if not text:
            return []
        lines = [(n, line) for n, line in enumerate(text.split("\n")) if line.strip()]
        first = [self.decided(line) if len(line) < 120 else self.decide(line) for _, line in lines]
        count = len(first)
        ends = np.cumsum([len(line) for _, line in lines]).tolist()
        # nearest decided lines on both sides: (label, characters between)
        above: list = [None] * count
        below: list = [None] * count
        for side, order in ((above, range(count)), (below, range(count - 1, -1, -1))):
            last = None
            for k in order:
                if last is not None:
                    side[k] = (first[last], ends[k - 1] - ends[last] if last < k else ends[last - 1] - ends[k])
                if first[k] in (GOOD, BAD, HEADING):
                    last = k
        out = []
        for k, (n, _) in enumerate(lines):
            label = first[k]
            if label in (OPEN, SEMI, USUAL):
                before, after = first[k - 1] if k else BAD, first[k + 1] if k + 1 < count else BAD
                if label == USUAL and (after == USUAL or before in (BAD, USUAL) and after != GOOD) and above[k] is not None and above[k][0] != GOOD:
                    label = BAD  # a block of buttons
                elif label == USUAL and after in (OPEN, SEMI):
                    label = OPEN  # as the list under it
                elif label == SEMI:
                    label = USUAL if after == BAD else OPEN
                if label in (OPEN, USUAL):
                    label = _inherited(label, above[k], below[k])
            if label != GOOD:
                out.append(n)
        return out


def _inherited(label: str, above: tuple[str, int] | None, below: tuple[str, int] | None) -> str:
    """Second pass: the label of the nearest decided line.

    Below a heading of teasers stand teasers. A line that recurs is a heading if main text follows. One that recurs
    nowhere belongs to main text within REACH.
    """
    if above is not None and above[0] == HEADING:
        return BAD
    kinds = {x[0] == GOOD for x in (above, below) if x is not None}
    if kinds != {True, False}:
        return GOOD if True in kinds or not kinds else BAD
    if label == USUAL:
        return below[0]
    good, bad = (above[1], below[1]) if above[0] == GOOD else (below[1], above[1])
    return GOOD if good <= max(bad, REACH) else BAD


def _line_statistics(pages: DataFrame) -> DataFrame:
    """``kind, site, part, page, word, n``: parts of each page (kind 0, the page itself as part 0), words of sentences (1)."""
    types = [("kind", pa.int32()), ("site", pa.string()), ("part", pa.int64()), ("page", pa.int64()), ("word", pa.string()), ("n", pa.int64())]

    def run(batches):
        for batch in batches:
            held, words = set(), Counter()
            for key, site, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                page = xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass")) - (1 << 63)
                held.add((site, 0, page))
                for line in text.split("\n"):
                    raw = plain(line)
                    if not raw:
                        continue
                    held.update((site, part - (1 << 63), page) for part, _ in parts(raw))
                    if is_sentence(raw, found := raw.casefold().split()):
                        words.update({w.strip(_POINTS) for w in found})
            rows = [(0, *x, None, 1) for x in held] + [(1, None, None, None, w, n) for w, n in words.items() if w]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(types)], [name for name, _ in types])

    return spread(pages).mapInArrow(run, "kind int, site string, part bigint, page bigint, word string, n bigint")


def templates(pages: DataFrame, most: int = PARTS) -> list[tuple[int, int, tuple[list[str], np.ndarray, np.ndarray]]]:
    """Statistics of ``pages`` (``id, site, text``) in blocks of sites: (block, number of blocks, words and parts).

    A part's share is the number of pages that hold it over the pages of all sites that use it. Of parts only those that
    recur go to the driver, at most about ``most`` of them at once (about 16 bytes each).
    """
    rows = materialise(_line_statistics(pages), "lines")
    top = rows.filter("kind = 1").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "word").limit(STOP_WORDS)
    words = [r.word for r in top.collect()]
    held = rows.filter("kind = 0").select("site", "part", "page").distinct().groupBy("site", "part").agg(F.count("*").alias("c"))
    held = materialise(held, "parts")
    sizes = held.filter("part = 0").select("site", F.col("c").alias("pages"))
    shares = held.filter("part <> 0").join(sizes, "site").groupBy("part").agg(F.sum("c").alias("c"), F.sum("pages").alias("pages"))
    shares = materialise(shares.filter((F.col("c") >= SEEN) & (F.col("c") >= OWN / 2 * F.col("pages"))).select("part", (F.col("c") / F.col("pages")).alias("share")), "shares")
    number = -(-shares.count() // most) or 1
    out = []
    for block in range(number):
        some = shares
        if number > 1:
            some = shares.join(held.filter(_block(number) == block).select("part").distinct(), "part", "left_semi")
        table = some.toPandas()
        out.append((block, number, (words, table["part"].to_numpy("i8").view("u8") ^ np.uint64(1 << 63), table["share"].to_numpy("f8"))))
    return out


def _block(number: int):
    return F.pmod(F.xxhash64("site"), F.lit(number))


def _by_pages(pages: DataFrame, extra: str, build, most: int) -> DataFrame:
    """``build(template, text)`` of each page, with the page's id."""
    spark = pages.sparkSession
    ship(spark)
    usable = pages.filter("id is not null and text is not null").select("id", F.coalesce("site", F.lit("")).alias("site"), "text")
    kind = pa.int64() if extra.endswith("bigint") else pa.string()
    name = extra.split()[0]

    def scan(block: int, number: int, statistics) -> DataFrame:
        shared = spark.sparkContext.broadcast(statistics)

        def run(batches):
            template = Template(*shared.value)
            for batch in batches:
                ids, rest = [], []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for x in build(template, text):
                        ids.append(key)
                        rest.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(rest, kind)], ["id", name])

        own = usable if number == 1 else usable.filter(_block(number) == block)
        return spread(own.select("id", "text")).mapInArrow(run, f"id string, {extra}")

    return reduce(DataFrame.unionByName, [scan(*x) for x in templates(usable, most)])


def chrome_lines(pages: DataFrame, most: int = PARTS) -> DataFrame:
    """``id, line_no`` of the lines of page chrome; a repeated row counts once.

    Null, empty and blank texts have no such lines; blank lines are never listed; rows without an id are no pages; pages
    without a site are those of one site. Of an id with several texts the lines of all are listed. Any length of text and
    line is read; other columns are ignored. Two passes over the texts, one for the table's statistics; hashes of
    parts and (id, line) pairs shuffle, texts don't.
    """
    return _by_pages(pages, "line_no bigint", Template.chrome, most).distinct()


def main_body(template: Template, text: str | None) -> str:
    """A page's text without the lines of chrome, without left-over tags, and without runs of blank lines."""
    if not text:
        return ""
    drop = set(template.chrome(text))
    kept = [_TAG.sub("", line).rstrip() for n, line in enumerate(text.split("\n")) if n not in drop]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip("\n")


def once(pages: DataFrame) -> DataFrame:
    """``pages`` with each (id, text) once; only texts of rows that are repeated shuffle."""
    keyed = pages.withColumn("_h", F.xxhash64("text"))
    several = materialise(keyed.groupBy("id", "_h").agg(F.count("*").alias("_c")).filter("_c > 1").select("id", "_h"), "repeated")
    repeated = keyed.join(several, ["id", "_h"], "left_semi").dropDuplicates(["id", "_h"])
    return keyed.join(several, ["id", "_h"], "left_anti").unionByName(repeated).drop("_h")


def bodies(pages: DataFrame, most: int = PARTS) -> DataFrame:
    """``id, body`` of each page: the text that ``chrome_lines`` leaves; '' where nothing is left. Repeated rows give one."""
    usable = pages.filter("id is not null and text is not null").select("id", "site", "text")
    return _by_pages(once(usable), "body string", lambda template, text: [main_body(template, text)], most)
