"""Titles, names, keys, links and markup."""

from __future__ import annotations

import html
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Latin letters of one base letter and marks, and those base letters, from the Unicode decompositions."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = [c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != chr(code) and base[0].isascii():
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()
#: Letters that stand for two, or that don't decompose.
SPELLED = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "þ": "th", "Þ": "TH", "ð": "d", "Ð": "D", "ı": "i"}

# What a title's brackets and version marks look like.
MARKS = r"(?s)\s*[\(\[][^\)\]]*[\)\]]\s*|\s+-\s+(remaster|remastered|mono|stereo|live|radio edit|single version|album version).*$"
# The threshold of a fallback key's duration buckets, and the length of its digest.
KEY_BUCKET_MS, KEY_HEX = 5_000, 24
# Named entities.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
# Kinds and forms of links.
KINDS = "track|album|artist|playlist|user"
URI = rf"^spotify:({KINDS}):([A-Za-z0-9]+)$"
WEB = rf"open\.spotify\.com/(?:intl-[a-z]{{2}}/)?({KINDS})/([A-Za-z0-9]+)"
TRACK_URI = r"spotify:track:(.+)$"


def unaccent(text: Column) -> Column:
    """Letters without their marks; ß, æ, œ, þ become two letters."""
    for letter, spelled in SPELLED.items():
        if len(spelled) > 1:
            text = F.replace(text, F.lit(letter), F.lit(spelled))
    single = {k: v for k, v in SPELLED.items() if len(v) == 1}
    return F.translate(text, ACCENTED + "".join(single), PLAIN + "".join(single.values()))


def norm_title(title: Column) -> Column:
    """A title in plain lower-case words, without brackets and version marks. Null is empty."""
    plain = F.lower(unaccent(F.coalesce(title, F.lit(""))))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, MARKS, " "), "[^a-z0-9]+", " "))


def norm_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(unaccent(F.coalesce(name, F.lit("")))), "[^a-z0-9]+", " "))


def fallback_key(title: Column, duration_ms: Column, artists: Column, track_id: Column) -> Column:
    """Key of a recording without a code: title, duration bucket and artists; its own id if the title has no word."""
    name = norm_title(title)
    bucket = F.call_function("div", F.coalesce(duration_ms, F.lit(0)).cast("long"), F.lit(KEY_BUCKET_MS).cast("long"))
    own = F.when((name == "") & track_id.isNotNull(), F.concat(F.lit("id:"), track_id))
    listed = F.concat(name, F.lit("|"), bucket.cast("string"), F.lit("|"), F.concat_ws(",", F.coalesce(artists, F.array().cast("array<string>"))))
    return F.concat(F.lit("fb:"), F.substring(F.sha2(F.coalesce(own, listed), 256), 1, KEY_HEX))


def contains(column: Column, wanted: str) -> Column:
    """Case-insensitive substring search; %, _ and \\ mean themselves."""
    return column.ilike("%" + re.sub(r"([\\%_])", r"\\\1", wanted) + "%")


def any_contains(wanted: str, *columns: Column) -> Column:
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(contains(c, wanted), F.lit(False))
    return found


def track_id_of_uri(uri: Column) -> Column:
    return F.nullif(F.regexp_extract(uri, TRACK_URI, 1), F.lit(""))


def link_target(link: Column) -> Column:
    """kind and id of a link or URI; null where it is neither."""
    both = [F.struct(F.regexp_extract(link, p, 1).alias("kind"), F.regexp_extract(link, p, 2).alias("id")) for p in (URI, WEB)]
    return F.when(link.rlike(URI), both[0]).when(link.rlike(WEB), both[1])


#: A numeric entity, and the greatest code point.
NUMERIC, LAST_CODE = r"&#(x[0-9a-fA-F]+|[0-9]+);", 0x10FFFF


def _numeric_entities(text: Column) -> Column:
    """Each numeric entity replaced once, in one pass: what stands between entities, and their characters. Codes that are no characters stay."""

    def shown(entity: Column) -> Column:
        digits = F.regexp_extract(entity, "^&#x?0*([0-9a-fA-F]*);$", 1)
        short = F.when(F.length(digits) <= 7, digits)  # longer ones are beyond the last code
        hexed = F.when(entity.startswith("&#x"), short).otherwise(F.hex(short.try_cast("long")))
        code = F.conv(hexed, 16, 10).cast("long")
        known = (code <= LAST_CODE) & ~code.between(0xD800, 0xDFFF)
        return F.coalesce(F.when(known, F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.when(hexed == "", "0").otherwise(hexed), 8, "0"))), "UTF-32")), entity)

    found = F.regexp_extract_all(text, F.lit(NUMERIC), F.lit(0))
    between = F.split(text, NUMERIC, -1)
    joined = F.array_join(F.zip_with(between, found, lambda t, e: F.concat(t, F.coalesce(shown(e), F.lit("")))), "")
    return F.when(text.contains("&#"), joined).otherwise(text)


def plain_text(markup: Column, numeric: bool = True) -> Column:
    """Text without tags, entities resolved once, white space folded. Null is empty.

    With numeric=False numeric entities stay.
    """
    text = F.regexp_replace(F.coalesce(markup, F.lit("")), "<[^>]*>", "")
    if numeric:
        text = _numeric_entities(text)
    for name, shown in ENTITIES.items():
        if name != "amp":
            text = F.regexp_replace(text, f"(?i)&{name};", shown)
    text = F.regexp_replace(text, "(?i)&amp;", "&")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug(name: str) -> str:
    """A name as an id: decomposed, lower case, runs of other characters as one dash, at most 48 characters."""
    kept = re.sub(r"[^a-z0-9]+", "-", unicodedata.normalize("NFKD", name.lower()))
    return re.sub(r"^-|-$", "", kept)[:48] or "collection"


def entity(name: str) -> str:
    """A named entity's character, for tests and callers outside Spark."""
    return ENTITIES.get(name.lower()) or html.unescape(f"&{name};")


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of each word, with two blanks before it and one behind."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3))))))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams of all trigrams."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))
