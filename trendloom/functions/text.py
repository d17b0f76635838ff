"""Text, identity and tokeniser column expressions (all JVM side)."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendloom.constants import TRACKING_PARAMS

# One class for every character Unicode treats as white space; valid for Java and RE2 alike.
WHITESPACE = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
# The same characters as a plain set, for trimming at the ends.
WHITESPACE_CHARS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WORD = r"[\p{L}\p{N}_]{2,}"
SIGNAL_TOKEN = r"[a-z0-9äöüß-]+"
LEXICON_TOKEN = r"[a-zA-Z][a-zA-Z-]{2,}"
OVERLAP_TOKEN = r"[a-z0-9]{3,}"
GATE_TOKEN = r"[a-z]{4,}"
EXPANSION_TOKEN = r"[a-zA-Z][a-zA-Z-]{3,}"
DOI = r"(?i)(10\.\d{4,9}/[-._;()/:A-Z0-9]+)"
URL_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def find_all(value: Column, pattern: str) -> Column:
    return F.regexp_extract_all(value, F.lit(pattern), F.lit(0))


def let(value: Column, body) -> Column:
    """Evaluate `value` once per row and hand it to `body`.

    A lambda body evaluates outer expressions again for every element, so anything costly that a
    lambda needs is bound to a lambda variable first.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def strip(value: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.btrim(value, F.lit(WHITESPACE_CHARS))


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, dict[str, str], str]:
    """Case folding by rule, from the Unicode tables of the Python that plans the query: letters that fold to one letter and their folds,
    letters that fold to several, and a pattern of all that `lower` with the two replacements of `fold_case` does not fold."""
    single, several, rest = {}, {}, []
    for code in range(0x110000):
        letter = chr(code)
        if 0xD800 <= code < 0xE000:
            continue
        folded = letter.casefold()
        if folded != letter:
            (single if len(folded) == 1 else several)[letter] = folded
        unknown = unicodedata.category(letter) == "Cn"  # a later Unicode may have a lower case for it
        if letter not in "ßςΣ" and (unknown or folded != letter.lower() or (code >= 0x530 and folded != letter)):
            rest.append(code)
    ranges = []
    for code in rest:
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    listed = lambda low, high: "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges if low <= a < high)
    pattern = f"[{listed(0, 0x530)}]|[\\x{{530}}-\\x{{10FFFF}}&&[{listed(0x530, 0x110000)}]]"
    return "".join(single), "".join(single.values()), several, pattern


def fold_case(value: Column) -> Column:
    """Full Unicode case folding. Most texts need lower case and two replacements; one with other folding letters goes letter by letter."""
    source, target, several, rest = _folding()
    plain = F.translate(F.replace(F.lower(value), F.lit("ß"), F.lit("ss")), "ς", "σ")
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    letters = F.regexp_extract_all(F.translate(value, source, target), F.lit("(?s)."), F.lit(0))
    full = F.array_join(F.transform(letters, lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    only_ascii = F.octet_length(value) == F.char_length(value)
    return F.when(only_ascii, F.lower(value)).when(F.rlike(value, F.lit(rest)), full).otherwise(plain)


def normalize_text(value: Column) -> Column:
    return F.trim(F.regexp_replace(fold_case(value), WHITESPACE, " "))


def content_fingerprint(title: Column, text: Column) -> Column:
    return F.sha2(F.concat(normalize_text(title), F.lit("\n"), normalize_text(text)), 256)


def extract_doi(external_id: Column, url: Column, text: Column, text_chars: int | None = None) -> Column:
    """First DOI in external id, url or the text (or its first `text_chars` characters)."""
    places = (external_id, url, text if text_chars is None else F.substring(text, 1, text_chars))
    found = [F.nullif(F.regexp_extract(F.coalesce(p, F.lit("")), DOI, 1), F.lit("")) for p in places]
    return fold_case(F.regexp_replace(F.coalesce(*found), r"[.,;)]+$", ""))


def _query_part(value: Column) -> Column:
    return F.coalesce(F.try_url_decode(value), F.translate(value, "+", " "))


def _query_quote(value: Column) -> Column:
    return F.replace(F.replace(F.url_encode(value), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def canonicalize_url(value: Column) -> Column:
    """Stable form of a URL; null without a host."""
    url = strip(value)
    part = lambda i: F.regexp_extract(url, URL_PARTS, i)
    pairs = F.transform(
        F.filter(F.split(part(4), "&"), lambda p: p != ""),
        lambda p: F.struct(
            _query_part(F.substring_index(p, "=", 1)).alias("k"),
            _query_part(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, r"^[^=]*=", "")).otherwise("")).alias("v"),
        ),
    )
    kept = F.filter(
        pairs, lambda p: ~F.startswith(F.lower(p["k"]), F.lit("utm_")) & ~F.lower(p["k"]).isin(*TRACKING_PARAMS)
    )
    query = F.array_join(
        F.transform(F.array_sort(kept), lambda p: F.concat(_query_quote(p["k"]), F.lit("="), _query_quote(p["v"]))), "&"
    )
    path = F.regexp_replace(part(3), r"/+$", "")
    scheme = F.when(part(1) == "", F.lit("https")).otherwise(F.lower(part(1)))
    whole = F.concat(
        scheme, F.lit("://"), F.lower(part(2)),
        F.when(path == "", F.lit("/")).otherwise(path),
        F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
    )
    return F.when(part(2) != "", whole)


def identity_key(doi: Column, url: Column, source: Column, external_id: Column, content_hash: Column) -> Column:
    external = blank_to_null(external_id)
    return F.coalesce(
        F.concat(F.lit("doi:"), doi),
        F.concat(F.lit("url:"), url),
        F.concat(F.lit("source:"), fold_case(source), F.lit(":"), fold_case(external)),
        F.concat(F.lit("sha256:"), content_hash),
    )


def words(value: Column) -> Column:
    return find_all(F.lower(value), WORD)


def word_set(value: Column) -> Column:
    return F.array_distinct(words(value))


def signal_tokens(keywords: Column, title: Column, summary: Column, evidence_titles: Column, most_titles: int | None = None) -> Column:
    """Distinct classifier tokens; `most_titles` limits the evidence titles that count."""
    titles = evidence_titles if most_titles is None else F.slice(evidence_titles, 1, most_titles)
    joined = F.concat_ws(
        " ", F.array_join(keywords, " "), title, F.coalesce(summary, F.lit("")),
        F.array_join(titles, " "),
    )
    return F.array_distinct(find_all(F.lower(joined), SIGNAL_TOKEN))


def lexicon_tokens(title: Column, text: Column) -> Column:
    return F.array_distinct(F.transform(find_all(F.concat_ws(" ", title, text), LEXICON_TOKEN), F.lower))


def overlap_tokens(title: Column, keywords: Column, stop: tuple[str, ...]) -> Column:
    text = F.lower(F.concat_ws(" ", title, F.array_join(F.coalesce(keywords, F.array().cast("array<string>")), " ")))
    return F.array_except(F.array_distinct(find_all(text, OVERLAP_TOKEN)), literal_array(stop))


def gate_tokens(*parts: Column) -> Column:
    return F.array_distinct(find_all(F.lower(F.concat_ws(" ", *parts)), GATE_TOKEN))


def expansion_words(title: Column, stop: tuple[str, ...]) -> Column:
    lowered = F.transform(find_all(F.coalesce(title, F.lit("")), EXPANSION_TOKEN), F.lower)
    return F.filter(lowered, lambda w: ~w.isin(*stop))


def adjacent_pairs(tokens: Column) -> Column:
    """Neighbouring tokens as array<struct<w1, w2>>; bind a computed token array with `let` first."""
    following = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1)))
    pairs = F.zip_with(tokens, following, lambda a, b: F.struct(a.alias("w1"), b.alias("w2")))
    return F.filter(pairs, lambda p: p["w2"].isNotNull())


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def capitalize(value: Column) -> Column:
    return F.concat(F.upper(F.substring(value, 1, 1)), F.lower(F.substr(value, F.lit(2))))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)
