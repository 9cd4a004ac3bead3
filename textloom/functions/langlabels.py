"""Spellings of language labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = ("en", "el", "fr", "de", "es", "it")

#: Languages that detection by stop words tells apart.
DETECTED = (*LANGUAGES, "pt", "nl")

#: ISO 639 codes of two and three letters, English and own names.
SPELLINGS = {
    "en": ("en", "eng", "english"),
    "el": ("el", "ell", "gre", "gr", "greek", "ελληνικά", "ελληνικα"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "it": ("it", "ita", "italian", "italiano"),
}


def language_code(label: Column) -> Column:
    """The two-letter code a label spells, whatever its case, region or form; null for all else."""
    plain = F.lower(F.trim(F.regexp_extract(label, r"^\s*([\p{L}]+)", 1)))
    out = F.lit(None).cast("string")
    for code, forms in SPELLINGS.items():
        out = F.when(plain.isin(*forms), F.lit(code)).otherwise(out)
    return out
