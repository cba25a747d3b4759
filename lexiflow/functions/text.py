"""Text column expressions: normalisation, tokenising, token filters, n-grams, counting.

All functions return ``pyspark.sql.Column`` objects built from built-in functions, so
they stay inside whole-stage code generation. Regular expressions are written so that
Java regex (Spark) and RE2 (the DuckDB oracle) read them the same way.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------
# Punctuation characters that the cleaning step replaces by a space unless they are
# kept (same set and meaning as the reference's cleaning step).
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'"
# ASCII characters Python's ``str.split()`` treats as whitespace. Java's ``\s`` misses
# \x1c-\x1f, so the class is spelled out.
WHITESPACE_CHARS = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f"
WHITESPACE_RE = "[\\t\\n\\x0b\\x0c\\r \\x1c-\\x1f]+"
NON_ASCII_RE = "[^\\x00-\\x7f]"
DIGIT_RE = "[0-9]"
# A short default stopword list used by the registered demo queries. The reference's
# own list is a file parameter: load it with ``lexiflow.sources.files.scan_stopwords``.
DEFAULT_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is",
    "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "will", "with",
)
# -----------------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def char_class(chars: Iterable[str]) -> str | None:
    """Regex character class matching exactly ``chars`` (every member escaped)."""
    chars = sorted(set(chars))
    if not chars:
        return None
    return "[" + "".join("\\" + c if not c.isalnum() else c for c in chars) + "]"


def strip_class(keep_nonalphanumerics=True) -> str | None:
    """Class of punctuation to replace by a space.

    ``True`` keeps everything (no class), ``False`` strips the whole punctuation set,
    a list strips the set minus the listed characters.
    """
    if keep_nonalphanumerics is True:
        return None
    if keep_nonalphanumerics is False:
        return char_class(PUNCTUATION)
    keep = set("".join(keep_nonalphanumerics))
    return char_class(c for c in PUNCTUATION if c not in keep)


def normalize_text(text, remove_numbers: bool = True, keep_nonalphanumerics=True) -> Column:
    """lower -> drop non-ASCII characters -> digits to space -> punctuation to space."""
    t = F.regexp_replace(F.lower(_col(text)), NON_ASCII_RE, "")
    if remove_numbers:
        t = F.regexp_replace(t, DIGIT_RE, " ")
    cls = strip_class(keep_nonalphanumerics)
    if cls is not None:
        t = F.regexp_replace(t, cls, " ")
    return t


def tokenize(text) -> Column:
    """Whitespace tokenizer; empty pieces dropped (``str.split()`` semantics)."""
    return F.filter(F.split(_col(text), WHITESPACE_RE), lambda x: F.length(x) > 0)


def filter_tokens(tokens, min_len: int = 2, max_len: int = 15,
                  stopwords: Sequence[str] = DEFAULT_STOPWORDS) -> Column:
    """Keep tokens with ``min_len <= length <= max_len`` that are not stopwords.

    Order and duplicates are preserved; the stopword literal list becomes an ``InSet``.
    """
    stop = list(stopwords or ())

    def keep(x):
        cond = (F.length(x) >= min_len) & (F.length(x) <= max_len)
        if stop:
            cond = cond & ~x.isin(stop)
        return cond

    return F.filter(_col(tokens), keep)


def clean_tokens(text, min_len: int = 2, max_len: int = 15, keep_nonalphanumerics=True,
                 remove_numbers: bool = True,
                 stopwords: Sequence[str] = DEFAULT_STOPWORDS,
                 lemmas: Mapping[str, str] | None = None, do_stemming: bool = False) -> Column:
    """Full cleaning chain to a token array: normalise, tokenise, filter, then replace
    tokens by their lemma (a table ``surface -> lemma``) and by their English stem."""
    norm = normalize_text(text, remove_numbers, keep_nonalphanumerics)
    tokens = filter_tokens(tokenize(norm), min_len, max_len, stopwords)
    return token_normaliser(lemmas, do_stemming)(tokens) if lemmas or do_stemming else tokens


def token_normaliser(lemmas: Mapping[str, str] | None = None, do_stemming: bool = True):
    """Arrow UDF over token arrays; each distinct token of a batch is normalised once."""
    from lexiflow.functions.snowball import stem
    table = dict(lemmas or {})

    def one(token):
        token = table.get(token, token)
        return stem(token) if do_stemming else token

    @F.pandas_udf("array<string>")
    def normalise(tokens: pd.Series) -> pd.Series:
        seen: dict[str, str] = {}
        for row in tokens:
            for t in row if row is not None else ():
                if t not in seen:
                    seen[t] = one(t)
        return tokens.map(lambda row: None if row is None else [seen[t] for t in row])

    return normalise


def clean_text(text, **options) -> Column:
    """Cleaning chain re-joined with single spaces (``return_tokens=False``)."""
    return F.array_join(clean_tokens(text, **options), " ")


def bind(expr, fn) -> Column:
    """Evaluate ``expr`` once per row and hand it to ``fn`` as a lambda variable.

    Catalyst inlines projected expressions into higher-order-function lambdas, where
    they would be recomputed for every array element; binding prevents that.
    """
    return F.element_at(F.transform(F.array(_col(expr)), fn), 1)


def ngrams(tokens, n: int = 2) -> Column:
    """Contiguous n-grams joined by one space; empty when fewer than n tokens."""
    def grams(t):
        g = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1),
                        lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, g).otherwise(F.array().cast("array<string>"))
    return bind(tokens, grams)


def substring_count(text, query) -> Column:
    """Non-overlapping literal occurrences, left to right (Python ``str.count``)."""
    t, q = _col(text), _col(query)
    return F.when(
        F.length(q) > 0,
        F.floor((F.length(t) - F.length(F.replace(t, q, F.lit("")))) / F.length(q)),
    ).otherwise(F.lit(None)).cast("bigint")


def padded_count(text, query) -> Column:
    """Reference counting: the query padded with one space on both ends, counted in the
    cleaned text (hits at the very start/end of the text cannot match)."""
    return substring_count(text, F.concat(F.lit(" "), _col(query), F.lit(" ")))


def token_count(text, query) -> Column:
    """Greedy non-overlapping count of a token sequence in a single-space joined text.

    Separators are doubled and the text padded, so each hit consumes only its own
    separators: hits at the edges count and adjacent repeats are not merged.
    """
    t2 = F.concat(F.lit(" "), F.replace(_col(text), F.lit(" "), F.lit("  ")), F.lit(" "))
    q2 = F.concat(F.lit(" "), F.replace(_col(query), F.lit(" "), F.lit("  ")), F.lit(" "))
    return substring_count(t2, q2)


def has_digits(text) -> Column:
    return _col(text).rlike("[0-9]")


def has_non_alphanumerics(text) -> Column:
    """True when any character is not a letter or digit (a space counts)."""
    return _col(text).rlike("[^\\p{L}\\p{N}]")


def non_alphanumeric_chars(text) -> Column:
    """Sorted distinct characters that are neither letters, digits nor space."""
    chars = F.filter(F.split(_col(text), ""), lambda c: c.rlike("^[^\\p{L}\\p{N} ]$"))
    return F.array_sort(F.array_distinct(chars))
