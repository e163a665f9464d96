"""Loosely spelled labels: languages, sources, lanes and domains in one spelling."""

from __future__ import annotations

import os
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ISO 639 codes (and the languages' names) of the ten languages of the corpus.
LANGUAGE_CODES = {
    "en": "en", "eng": "en", "english": "en",
    "de": "de", "deu": "de", "ger": "de", "german": "de", "deutsch": "de",
    "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr", "français": "fr", "francais": "fr",
    "es": "es", "spa": "es", "spanish": "es", "español": "es", "espanol": "es",
    "pt": "pt", "por": "pt", "portuguese": "pt", "português": "pt", "portugues": "pt",
    "hi": "hi", "hin": "hi", "hindi": "hi", "हिन्दी": "hi",
    "mr": "mr", "mar": "mr", "marathi": "mr", "मराठी": "mr",
    "bn": "bn", "ben": "bn", "bengali": "bn", "bangla": "bn", "বাংলা": "bn",
    "ta": "ta", "tam": "ta", "tamil": "ta", "தமிழ்": "ta",
    "te": "te", "tel": "te", "telugu": "te", "తెలుగు": "te",
}
#: Labels that name no language.
PLACEHOLDERS = ("", "und", "xx", "unk", "unknown", "n/a", "na", "none", "null", "nil", "nan", "zxx", "mis", "mul", "other", "-", "--", "?", "tbd", "undefined")
LANGUAGES = ("en", "de", "fr", "es", "pt", "hi", "mr", "bn", "ta", "te")


def language(label: Column) -> Column:
    """Two-letter code of a label in any spelling (``EN``, ``eng``, ``en_US``, `` en``); NULL for none.

    A label of a language outside the ten keeps its own code in lower case.
    """
    plain = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    base = F.regexp_extract(plain, r"^([^\-_@.]+)", 1)
    codes = F.create_map(*[F.lit(x) for x in chain.from_iterable(LANGUAGE_CODES.items())])
    return F.when(label.isNull() | plain.isin(*PLACEHOLDERS) | base.isin(*PLACEHOLDERS), F.lit(None).cast("string")).otherwise(
        F.coalesce(F.try_element_at(codes, plain), F.try_element_at(codes, base), base)
    )


def slug(label: Column, joint: str = "-") -> Column:
    """Lower case, outer blanks dropped, inner blanks, hyphens and underscores as ``joint``; NULL for nothing."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", "")), r"(?U)[\s_\-]+", joint)
    return F.when(plain == "", F.lit(None).cast("string")).otherwise(plain)


def tokenizer_folder(folder: str | None = None) -> str:
    """Folder of the public tokenizers' files: the argument, ``QUERN_TOKENIZERS``, the installed package, or /opt."""
    if folder:
        return folder
    if os.environ.get("QUERN_TOKENIZERS"):
        return os.environ["QUERN_TOKENIZERS"]
    try:
        import public_tokenizers

        return os.path.dirname(public_tokenizers.__file__)
    except ImportError:
        return "/opt/tokenizers"
