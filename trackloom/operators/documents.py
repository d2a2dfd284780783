"""Text and JSON document checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from trackloom import contracts as C


#: A JSON string, with the colon that follows it if it is a key. Possessive, so texts of any length are safe.
_STRING = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:[\x20\t\r\n]*+:)?+'


def forbidden_keys(docs: DataFrame, keys: Sequence[str], key: str = "doc_id", raw: str = "raw") -> DataFrame:
    """Denied keys met anywhere in a JSON document, at any nesting; (key, NULL) if a document is no JSON.

    In a document that parses, quotes only delimit strings and a string before a colon is a key, so one
    pass over the text finds the keys of all levels; those written with escapes are decoded first.
    """
    parsed = F.try_parse_json(raw).isNotNull()
    literal = F.transform(
        F.filter(F.regexp_extract_all(raw, F.lit(_STRING), F.lit(0)), lambda s: s.endswith(":")), lambda s: F.rtrim(F.substr(s, F.lit(1), F.length(s) - 1), F.lit(" \t\r\n"))
    )
    names = F.transform(
        literal, lambda s: F.when(F.contains(s, F.lit("\\")), F.try_variant_get(F.try_parse_json(s), "$", "string")).otherwise(F.substr(s, F.lit(2), F.length(s) - 2))
    )
    denied = F.filter(F.array_distinct(names), lambda n: n.isin(*keys))
    found = F.when(parsed, denied).otherwise(F.array(F.lit(None).cast("string")))
    some = docs.filter(F.col(raw).isNotNull())
    return some.select(F.col(key), F.explode(found).alias("key")).distinct()


def scan_text(
    docs: DataFrame,
    patterns: Mapping[str, str] | None = None,
    key: str = "path",
    text: str = "text",
    size: str | None = None,
    script: str | None = None,
) -> DataFrame:
    """Findings (key, finding) from a regex deny-list, a size cap and a line-ending rule."""
    patterns = dict(patterns or C.SECRET_PATTERNS)
    found = [F.when(F.col(text).rlike(p), F.lit(name)) for name, p in sorted(patterns.items())]
    if size:
        found.append(F.when(F.col(size) >= C.OVERSIZE_BYTES, F.lit("oversized")))
    if script:
        found.append(F.when(F.col(script) & F.contains(F.col(text), F.lit("\r\n")), F.lit("crlf")))
    return docs.select(key, F.explode(F.array_compact(F.array(*found))).alias("finding"))


#: Folders of a person's machine that published text should not name.
MACHINE_PATHS = {
    "data_mount": r"/mnt/data/[A-Za-z0-9_.-]+",
    "home_path": r"/home/[A-Za-z0-9_][A-Za-z0-9_.-]*",
    "windows_path": r"(?i)[a-z]:\\users\\[^\\\s]+",
}


def machine_paths(docs: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Findings (key, finding) of personal folders in a text."""
    return scan_text(docs, MACHINE_PATHS, key, text)


def legacy_tokens(docs: DataFrame, tokens: Sequence[str], key: str = "path", text: str = "text") -> DataFrame:
    """Literal tokens that occur in a text."""
    hits = F.filter(
        F.array(*[F.lit(t) for t in tokens]), lambda t: F.contains(F.col(text), t)
    )
    return docs.select(key, F.explode(hits).alias("token"))
