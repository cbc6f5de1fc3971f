"""Column expressions for text: normalisation, house numbers, names.  All but truth_key() of text beyond ASCII stay in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F


def _folding() -> tuple[str, str]:
    """Letters with diacritics and their bases, from their canonical decompositions."""
    src, dst = [], []
    for block in (range(0xC0, 0x250), range(0x400, 0x500), range(0x1E00, 0x1F00)):
        for o in block:
            base = "".join(c for c in unicodedata.normalize("NFD", chr(o)) if not unicodedata.combining(c))
            if len(base) == 1 and base != chr(o):
                src.append(chr(o))
                dst.append(base)
    return "".join(src) + "đ", "".join(dst) + "d"


_FROM, _TO = _folding()
SEPARATORS = "[-'’`./,;()ʻʼ‘]"


def plain(c: Column) -> Column:
    """Lower case without diacritics."""
    return F.regexp_replace(F.translate(F.lower(c), _FROM, _TO), r"\p{M}", "")


def spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, " +", " "))


def norm(c: Column) -> Column:
    """The build side's key of a name: plain, separators as spaces."""
    return spaced(F.regexp_replace(plain(c), SEPARATORS, " "))


def normalize(c: Column) -> Column:
    """The query side's form: number ranges keep the first number, block codes and glued postcodes are split right."""
    c = F.regexp_replace(c, r"(?<=[0-9])-[0-9]+", "")
    c = F.regexp_replace(c, r"(?<![\p{L}\p{N}])(\p{L})-(?=[0-9])", "$1")
    blank = SEPARATORS[:-1] + r"\s\p{Cc}\x{200B}-\x{200F}\x{2028}-\x{202E}\x{FE00}-\x{FE0F}\x{2190}-\x{2BFF}\x{1F000}-\x{1FFFF}]"
    c = spaced(F.regexp_replace(plain(c), blank, " "))
    return F.regexp_replace(c, r"([0-9]{4,})(?=\p{L})", "$1 ")


def phonetic(c: Column) -> Column:
    """Letters that sound alike are one, doubled letters are single; for Latin words in norm() form."""
    return F.regexp_replace(F.translate(c, "aoueiyqkxhwv", "oooiiikkhhvv"), r"([^ ])\1+", "$1")


def unglue(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=^| )(\p{L}{1,2})([0-9]{1,4})(?= |$)", "$1 $2")


def strip_phone_runs(c: Column) -> Column:
    return spaced(F.regexp_replace(c, r"(?:^|(?<= ))(?:[0-9]{1,4}(?: |$)){4,}", ""))


def has_cyrillic(c: Column) -> Column:
    return c.rlike(r"[\x{0400}-\x{04FF}]")


def word_key(c: Column) -> Column:
    """A name's words in sorted order, so that word order doesn't matter."""
    return F.array_join(F.array_sort(F.split(c, " ")), " ")


def title_case(c: Column) -> Column:
    """Names written all in capitals, longer than three characters, as titles."""
    return F.when((c == F.upper(c)) & (F.length(c) > 3), F.initcap(F.lower(c))).otherwise(c)


def leading_number(c: Column) -> Column:
    return F.regexp_extract(c, "^[0-9]+", 0).try_cast("int")


def any_number(c: Column) -> Column:
    return F.regexp_extract(c, "[0-9]+", 0).try_cast("int")


def trailing_suffix(c: Column) -> Column:
    """What follows a leading number, without separators in front; null if nothing does."""
    rest = F.regexp_replace(F.regexp_extract(c, r"^[0-9]+(.*)$", 1), r"^[\s/\-]+", "")
    return F.nullif(F.lower(F.trim(rest)), F.lit(""))


def either_suffix(c: Column) -> Column:
    """The suffix behind the number, or the letters in front of it; canonical."""
    part = F.when(c.rlike("^[0-9]"), F.regexp_extract(c, r"^[0-9]+(.*)$", 1)).otherwise(F.regexp_extract(c, r"^([^0-9]{1,4})", 1))
    return F.nullif(F.lower(canonical(part)), F.lit(""))


def canonical(c: Column) -> Column:
    """A suffix without spaces, hyphens, slashes and dots."""
    return F.regexp_replace(c, r"[\s\-/\.ʻʼ‘]", "")


def plausible_postcode(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[0-9][0-9A-Za-z ]{0,7}$"), F.lit(False))


def fit_bytes(c: Column, most: int = 255) -> Column:
    """At most ``most`` bytes, cut between characters."""
    ends = F.filter(F.sequence(F.lit(0), F.least(F.length(c), F.lit(most))), lambda n: F.octet_length(F.substring(c, F.lit(1), n)) <= most)
    return F.when(F.octet_length(c) <= most, c).otherwise(F.substring(c, F.lit(1), F.array_max(ends)))


def address_key(c: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def truth_key(c: Column) -> Column:
    """Words of letters and digits after case folding and compatibility composition, one space between them.

    ASCII text stays in column functions; only other text goes through Python, where Unicode's tables are.
    """

    @F.pandas_udf("string")
    def folded(s: pd.Series) -> pd.Series:
        def one(x):
            whole = unicodedata.normalize("NFKC", x.casefold())
            return " ".join("".join(ch if ch.isalnum() else " " for ch in whole).split())

        return s.map(one, na_action="ignore")

    plain = F.coalesce(c.rlike(r"^[\x00-\x7F]*\z"), F.lit(True))
    return F.when(plain, F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))).otherwise(folded(F.when(~plain, c)))


def without_numbers(c: Column) -> Column:
    return spaced(F.regexp_replace(c, r"\b\d+[\w/-]*\b", " "))


def compose(*parts: Column) -> Column:
    """Parts joined by commas, blank ones left out."""
    return F.concat_ws(", ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def lat_lon(c: Column) -> Column:
    """``LAT,LON`` as a struct; null unless it is one comma between two numbers in range."""
    parts = F.split(c, ",")
    lat, lon = (F.trim(F.get(parts, F.lit(i))).try_cast("double") for i in (0, 1))
    ok = (F.size(parts) == 2) & lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(ok, F.struct(lat.alias("lat"), lon.alias("lon")))


def arrondissement(postcode: Column, otherwise: Column) -> Column:
    """The commune of a postcode within Paris, Lyon or Marseille."""
    pc = F.regexp_extract(postcode, "^[0-9]{5}", 0)
    out = otherwise
    for city, low, high in (("Marseille", "13001", "13016"), ("Lyon", "69001", "69009"), ("Paris", "75001", "75020")):
        ordinal = F.when(pc == low, "er").otherwise("e")
        name = F.concat(F.lit(city + " "), (pc.try_cast("int") % 100).cast("string"), ordinal, F.lit(" Arrondissement"))
        out = F.when(pc.between(low, high), name).otherwise(out)
    return out
