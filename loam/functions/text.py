"""Text analysis as column expressions; only the stemmer is Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = tuple("the and for are but not you all can her was one our out day get has him his how man new now old see two way who boy did its let put say she too use".split())
MIN_BYTES = 3


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of at least three bytes, stop words removed, not stemmed; null gives none."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{IsAlphabetic}\p{N}]+")
    # that many literals become one look-up in a set
    return F.filter(words, lambda w: (F.octet_length(w) >= MIN_BYTES) & ~w.isin(*STOP_WORDS))


def squeeze(text: Column) -> Column:
    """White space runs (Unicode) to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def content_hash(title: Column, headings: Column, content: Column) -> Column:
    """Hash that tells whether a document changed: title, headings and content, each ended by a zero byte but the last."""
    zero = F.expr("X'00'")
    start = F.concat(F.encode(title, "UTF-8"), zero)
    middle = F.aggregate(headings, start, lambda a, h: F.concat(a, F.encode(h, "UTF-8"), zero))
    return F.sha2(F.concat(middle, F.encode(content, "UTF-8")), 256)


def cache_key(query: Column) -> Column:
    """Of a result cache."""
    return F.lower(query)


def embedding_key(text: Column) -> Column:
    """Of an embedding cache."""
    return F.sha2(text, 256)


def embedding_text(title: Column, content: Column) -> Column:
    """What is embedded: title and content, cut to 2,000 characters, then to 2,000 bytes at a character's end, trimmed."""
    text = F.substring(F.concat_ws(" ", title, content), 1, 2000)
    cut = F.encode(text, "UTF-8")
    last = lambda k: (F.conv(F.hex(F.substring(cut, k, 1)), 16, 10).cast("int"))
    # a byte after the cut that continues a character (10xxxxxx) means that the character goes as a whole
    back = F.when(last(2001).bitwiseAND(0xC0) != 0x80, 0).when(last(2000).bitwiseAND(0xC0) != 0x80, 1).when(last(1999).bitwiseAND(0xC0) != 0x80, 2).otherwise(3)
    return F.trim(F.when(F.octet_length(text) <= 2000, text).otherwise(F.decode(F.substring(cut, F.lit(1), 2000 - back), "UTF-8")))


def snippet(content: Column, query_tokens: Column, context: int = 20) -> Column:
    """The window of 2*context words that holds most query tokens, the earliest of ties, begun ten words early.

    A token counts if the lower-cased window contains it, once per occurrence in the query. Matches are wrapped
    in ** for each query token in turn; "..." marks cut ends.
    """
    width = 2 * context
    ws = words(content)
    n = F.size(ws)
    at = F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)))
    hits = F.transform(at, lambda i: F.struct(F.size(F.filter(query_tokens, lambda t: F.contains(F.lower(F.array_join(F.slice(ws, i + 1, width), " ")), t))).alias("c"), (-i).alias("i")))
    best = F.array_max(hits)
    start = F.when((best["c"] > 0) & (n >= width), F.greatest(-best["i"] - 10, F.lit(0))).otherwise(F.lit(0))
    body = F.array_join(F.slice(ws, start + 1, width), " ")
    marked = F.aggregate(query_tokens, body, lambda s, t: F.regexp_replace(s, F.concat(F.lit(r"(?iu)("), F.regexp_replace(t, r"([\\.\[\]{}()*+?^$|])", r"\\$1"), F.lit(")")), F.lit("**$1**")))
    return F.when(n == 0, "").otherwise(F.concat(F.when(start > 0, "...").otherwise(""), marked, F.when(start + width < n, "...").otherwise("")))
