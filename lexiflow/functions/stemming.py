"""The English Snowball stemmer as steps of SQL over a table of distinct terms.

Every step is a projection of a few ``CASE`` and regular expressions; longest suffixes are
found by one alternation anchored at the end. :func:`steps` gives the expressions for
Spark or DuckDB, so a vocabulary is stemmed inside the JVM and the same rules can be run
by another engine. Tables of suffixes are those of ``snowball``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.functions import snowball as S

V = "[aeiouy]"
C = "[^aeiouy]"


def _found(x: str, pattern: str) -> str:
    return f"regexp_extract({x}, {pattern}, 0)"


def _has(x: str, pattern: str) -> str:
    return f"{_found(x, repr(pattern))} <> ''"


def _cut(x: str, n) -> str:
    return f"left({x}, greatest(length({x}) - {n}, 0))"


def _suffix(suffixes) -> str:
    return _found("w", f"'({'|'.join(suffixes)})$'")


def _short_end(x: str) -> str:
    return f"({_has(x, f'^{V}{C}$')} OR {_has(x, f'{C}{V}[^aeiouywxY]$')})"


def _one_of(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _replaced(pairs) -> str:
    """The base with each suffix's replacement."""
    return "CASE suf " + " ".join(f"WHEN '{a}' THEN concat(base, '{b}')" for a, b in pairs) + " ELSE w END"


def steps(dialect: str = "spark") -> list[dict[str, str]]:
    """Projections over ``(term)``, each ``{column: expression}`` replacing or adding columns; the last gives ``stem``."""
    def marked(x, before):
        return (f"regexp_replace({x}, '({before})y', '$1<')" if dialect == "spark"
                else f"regexp_replace({x}, '({before})y', '\\1<', 'g')")

    base = {"base": "left(w, length(w) - length(suf))"}
    first = f"'^{C}*{V}+{C}'"
    region = lambda x: f"CASE WHEN {_found(x, first)} <> '' THEN length({_found(x, first)}) ELSE length({x}) END"
    quote = "chr(39)"
    vowel = _has("base", V)
    return [
        {"w": f"CASE WHEN left(term, 1) = {quote} THEN substr(term, 2) ELSE term END"},
        {"w": "CASE WHEN left(w, 1) = 'y' THEN concat('Y', substr(w, 2)) ELSE w END"},
        {"w": marked("w", V)},  # y after a vowel; every second one of a run is met by the next step
        {"w": f"replace({marked('w', '[aeiouy<]')}, '<', 'Y')"},
        {"r1": f"CASE WHEN {_has('w', '^(' + '|'.join(S.R1_PREFIXES) + ')')} "
               f"THEN length({_found('w', repr('^(' + '|'.join(S.R1_PREFIXES) + ')'))}) ELSE {region('w')} END"},
        {"r2": f"r1 + {region('substr(w, r1 + 1)')}"},
        {"suf": _found("w", f"concat('(', {quote}, 's', {quote}, '|', {quote}, 's|', {quote}, ')$')")},
        {"w": "left(w, length(w) - length(suf))"},
        {"w": f"CASE WHEN w LIKE '%sses' THEN {_cut('w', 2)} "
              f"WHEN w LIKE '%ied' OR w LIKE '%ies' THEN CASE WHEN length(w) > 4 THEN {_cut('w', 2)} ELSE {_cut('w', 1)} END "
              f"WHEN w LIKE '%us' OR w LIKE '%ss' THEN w "
              f"WHEN w LIKE '%s' AND {_has(_cut('w', 2), V)} THEN {_cut('w', 1)} ELSE w END"},
        {"early": f"CASE WHEN w IN {_one_of(S.AFTER_1A)} THEN w END", "suf": _suffix(("eedly", "ingly", "edly", "eed", "ing", "ed"))},
        base,
        {"w": f"CASE WHEN suf = '' THEN w WHEN suf IN ('eed', 'eedly') THEN CASE WHEN length(base) >= r1 THEN concat(base, 'ee') ELSE w END "
              f"WHEN NOT {vowel} THEN w WHEN {_has('base', '(at|bl|iz)$')} THEN concat(base, 'e') "
              f"WHEN {_has('base', '(' + '|'.join(S.DOUBLES) + ')$')} THEN {_cut('base', 1)} "
              f"WHEN r1 >= length(base) AND {_short_end('base')} THEN concat(base, 'e') ELSE base END"},
        {"w": f"CASE WHEN length(w) > 2 AND {_has('w', f'{C}[yY]$')} THEN concat({_cut('w', 1)}, 'i') ELSE w END"},
        {"suf": _suffix(a for a, _ in S.STEP2)}, base,
        {"w": f"CASE WHEN suf = '' OR length(base) < r1 OR (suf = 'ogi' AND base NOT LIKE '%l') "
              f"OR (suf = 'li' AND NOT {_has('base', f'[{S.LI_ENDINGS}]$')}) THEN w ELSE {_replaced(S.STEP2)} END"},
        {"suf": _suffix(a for a, _ in S.STEP3)}, base,
        {"w": f"CASE WHEN suf = '' OR length(base) < r1 OR (suf = 'ative' AND length(base) < r2) THEN w ELSE {_replaced(S.STEP3)} END"},
        {"suf": _suffix(S.STEP4)}, base,
        {"w": f"CASE WHEN suf = '' OR length(base) < r2 OR (suf = 'ion' AND NOT {_has('base', '[st]$')}) THEN w ELSE base END"},
        {"w": f"CASE WHEN w LIKE '%e' AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT {_short_end(_cut('w', 1))})) THEN {_cut('w', 1)} "
              f"WHEN w LIKE '%ll' AND length(w) - 1 >= r2 THEN {_cut('w', 1)} ELSE w END"},
        {"stem": "CASE WHEN length(term) <= 2 THEN term " + " ".join(f"WHEN term = '{a}' THEN '{b}'" for a, b in S.EXCEPTIONS.items())
                 + " ELSE replace(coalesce(early, w), 'Y', 'y') END"},
    ]


def stem_terms(terms: DataFrame, col: str = "term") -> DataFrame:
    """``(term, stem)`` of the distinct terms of a column."""
    out = terms.select(F.col(col).alias("term")).distinct()
    for step in steps():
        out = out.select(*[c for c in out.columns if c not in step], *[F.expr(e).alias(c) for c, e in step.items()])
    return out.select("term", "stem")


def stem_ctes(source: str, name: str = "stems") -> str:
    """DuckDB CTEs that end in ``name(term, stem)`` of the distinct terms of CTE ``source`` (column term)."""
    parts, columns, last = [], ["term"], f"{name}_0"
    parts.append(f"{last} AS (SELECT DISTINCT term FROM {source})")
    for i, step in enumerate(steps("duckdb"), 1):
        kept = [c for c in columns if c not in step]
        parts.append(f"{name}_{i} AS (SELECT {', '.join([*kept, *(f'{e} AS {c}' for c, e in step.items())])} FROM {last})")
        columns, last = [*kept, *step], f"{name}_{i}"
    return ",\n".join([*parts, f"{name} AS (SELECT term, stem FROM {last})"])
