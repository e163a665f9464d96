"""Column functions that clean and describe texts. All but ``canonical`` stay in the JVM."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters removed from every text (control and zero-width ones; the joiners U+200C, U+200D stay).
CONTROL = r"\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f"
ZERO_WIDTH = r"\x{200b}\x{200e}\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}"
# Words that mark roles and boundaries in chat formats.
ROLES = "user system assistant human bot ai instruction inst input output response prompt context question answer endoftext startoftext pad unk bos eos sep cls mask im_start im_end sys".split()
# Signs of program code, of which three make a text code.
CODE_HINTS = r"(?m)(^[ \t]{2,}\S)|(\bdef \w+\(.*\):)|(\bimport \w+)|(;\s*$)|(=>|::)|(\{\s*$)"
# Unicode blocks of the scripts, in the order that breaks ties.
SCRIPTS = {
    "devanagari": ("0900", "097F"), "bengali": ("0980", "09FF"), "gurmukhi": ("0A00", "0A7F"), "gujarati": ("0A80", "0AFF"), "oriya": ("0B00", "0B7F"),
    "tamil": ("0B80", "0BFF"), "telugu": ("0C00", "0C7F"), "kannada": ("0C80", "0CFF"), "malayalam": ("0D00", "0D7F"), "latin": ("0041", "024F"),
}
# Whole lines of page boilerplate.
BOILERPLATE = (
    r"we use cookies.{0,80}",
    r"accept (all )?cookies.{0,40}",
    r"this (website|site) uses cookies.{0,80}",
    r"subscribe to our newsletter.{0,80}",
    r"sign up for our newsletter.{0,80}",
    r"all rights reserved\.?",
    r"copyright \x{a9}? ?\d{4}.{0,80}",
    r"skip to (main )?content",
    r"home\s*\|\s*about\s*\|\s*contact.{0,40}",
)
# Tags that only whole pages have, and the share of tag characters that makes a long text a page.
PAGE_TAGS = r"(?i)<!doctype\s+html|<html[\s>]|</?(?:html|body|head|nav|footer|header|aside|script|style|form|main|article)\b"
TAG_SHARE, TAG_LENGTH = 0.02, 200
# Beginnings of responses in instruction texts.
MARKERS = ("response:", "output:", "answer:", "assistant:")
# Language codes of the Indic lane.
INDIC = ("bn", "mr", "hi", "gu", "kn", "ml", "or", "ta", "pa", "ne", "as", "te", "sa")


def role_pattern(extra: tuple[str, ...] = ()) -> str:
    return "|".join(sorted((*ROLES, *extra), key=lambda w: (-len(w), w)))


def ghost_patterns() -> dict[str, str]:
    """Pattern of each form of a role token: ``<|user|>``, ``[USER]``, ``|<user>|``, ``<user>`` and ``<<SYS>>``."""
    roles = role_pattern()
    return {
        "pipe_angle": rf"<\|/?(?:{roles})\|>",
        "bracket_upper": rf"\[/?(?:{roles})\]",
        "pipe_wrapped_angle": rf"\|</?(?:{roles})>\|",
        "angle_bare": rf"</?(?:{role_pattern(('s',))})>",
        "double_angle_sys": r"<<\s*/?SYS\s*>>",
    }


@F.pandas_udf(StringType())
def canonical(texts: pd.Series) -> pd.Series:
    """NFC, then HTML entities in one pass; Spark has neither."""
    return texts.map(lambda t: None if t is None else html.unescape(unicodedata.normalize("NFC", t)))


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(t))


def strip(text: Column) -> Column:
    """Without blanks (of any kind) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def drop_replacement(text: Column) -> Column:
    return F.replace(text, F.lit("�"), F.lit(""))


def drop_noise(text: Column) -> Column:
    return F.regexp_replace(text, f"[{CONTROL}{ZERO_WIDTH}]", "")


def joined_lines(text: Column) -> Column:
    """Words broken by a hyphen at a line's end are whole again (between lower-case letters only)."""
    return F.regexp_replace(text, r"(?<=[a-z])-\r?\n(?=[a-z])", "")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def tidy_code(text: Column) -> Column:
    """Line ends as LF, no blanks at line ends, at most one blank line in a row, no outer blank lines."""
    lines = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    trimmed = F.regexp_replace(lines, r"(?U)[\s&&[^\n]]+(?=\n|\z)", "")
    return F.regexp_replace(F.regexp_replace(trimmed, r"\n{3,}", "\n\n"), r"^\n+|\n+\z", "")


def content_type(text: Column) -> Column:
    """``code`` for three signs of code, else ``prose``; of the raw text."""
    return F.when(F.regexp_count(text, F.lit("(?U)" + CODE_HINTS)) >= 3, "code").otherwise("prose")


def ghosts(text: Column) -> Column:
    """Map of the patterns that match to all their matches."""
    patterns = ghost_patterns()
    entries = [x for name, p in patterns.items() for x in (F.lit(name), F.regexp_extract_all(text, F.lit("(?iu)" + p), 0))]
    return F.map_filter(F.create_map(*entries), lambda _, found: F.size(found) > 0)


def cleaned(canon: Column, kind: Column) -> Column:
    """The clean text of a canonical one: replacement and noise characters go, blanks by content type."""
    bare = drop_noise(drop_replacement(canon))
    return F.when(kind == "code", tidy_code(bare)).otherwise(collapsed(joined_lines(bare)))


def script_counts(text: Column) -> dict[str, Column]:
    """Characters of each script; texts without any Indic character are counted for Latin only."""
    indic = text.rlike(r"[\x{0900}-\x{0D7F}]")
    count = {name: F.regexp_count(text, F.lit(rf"[\x{{{low}}}-\x{{{high}}}]")) for name, (low, high) in SCRIPTS.items()}
    return {name: n if name == "latin" else F.when(indic, n).otherwise(0) for name, n in count.items()}


def dominant(counts: dict[str, Column]) -> Column:
    """The script of most characters, the first in order at a tie; '' for none."""
    most = F.greatest(*counts.values())
    chosen = F.lit("")
    for name, n in reversed(counts.items()):
        chosen = F.when(n == most, name).otherwise(chosen)
    return F.when(most > 0, chosen).otherwise("")


def purity(counts: dict[str, Column]) -> Column:
    """Share of the dominant script; 0.0 where there is none."""
    total = sum(counts.values(), F.lit(0))
    return F.when(total > 0, F.greatest(*counts.values()) / total).otherwise(0.0)


def is_page(text: Column) -> Column:
    tags = F.length(text) - F.length(F.regexp_replace(text, "<[^>]+>", ""))
    return F.coalesce(text.rlike(PAGE_TAGS) | ((F.length(text) >= TAG_LENGTH) & (tags / F.length(text) > TAG_SHARE)), F.lit(False))


def without_boilerplate(text: Column) -> Column:
    pattern = r"(?iU)^\s*(" + "|".join(BOILERPLATE) + r")\s*$"
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.rlike(pattern)), "\n")


def without_tags(text: Column) -> Column:
    """Tables go, other tags become blanks, boilerplate lines go."""
    return without_boilerplate(F.regexp_replace(F.regexp_replace(text, r"(?is)<table\b[^>]*>.*?</table>", " "), "<[^>]+>", " "))


def lane(domain: Column, language: Column) -> Column:
    """Capability lane; the language goes before the domain."""
    return (
        F.when(language.isin(*INDIC), "indic")
        .when(domain.isin("code", "qa"), "code")
        .when(domain.isin("math", "science"), "math_science")
        .when(domain == "instruction", "instruction")
        .otherwise("general_web")
    )


def marker(text: Column) -> Column:
    """Where (from 0) the earliest response marker stands; NULL for none."""
    low = F.lower(text)
    return F.least(*[F.nullif(F.locate(m, low), F.lit(0)) for m in MARKERS], F.lit(None).cast("int")) - 1


def faithful_units(text: Column) -> Column:
    """Runs of letters, marks and digits, and each other character that is no blank."""
    return F.regexp_count(text, F.lit(r"(?U)[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]"))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def tidy_markdown(text: Column) -> Column:
    """No-break spaces as blanks, at most two blank lines in a row, no blanks at line ends, one line end at the end."""
    plain = F.regexp_replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), r"\n{4,}", "\n\n\n")
    return F.concat(strip(F.regexp_replace(plain, r"[ \t]+\n", "\n")), F.lit("\n"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def first_difference(a: Column, b: Column) -> Column:
    """Index (from 0) of the first character that differs, the shorter length for a prefix; NULL for equal texts.

    The common prefix is found by halving, so a text is compared about 31 times whatever its length.
    """
    pair = lambda low, high: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.ceil((s["low"] + s["high"]) / 2).cast("int")
        equal = F.substring(a, F.lit(1), middle) == F.substring(b, F.lit(1), middle)
        return F.when(s["low"] >= s["high"], s).when(equal, pair(middle, s["high"])).otherwise(pair(s["low"], middle - 1))

    common = F.aggregate(F.sequence(F.lit(1), F.lit(32)), pair(F.lit(0), F.least(F.length(a), F.length(b))), halve)["low"]
    return F.when(a != b, common)


def repaired(name: str) -> Column:
    """A text column repaired by ftfy if it is installed, else as it is."""
    try:
        import ftfy
    except ImportError:
        return F.col(name)

    @F.pandas_udf("string")
    def fix(values: pd.Series) -> pd.Series:
        return values.map(lambda x: ftfy.fix_text(x) if isinstance(x, str) else None)

    return fix(name)
