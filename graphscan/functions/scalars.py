"""Scalar functions of the query languages and of code text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHOWN = 400
LARGEST_CHUNK = 10_000


def cat(*values: Column) -> Column:
    """Concatenation; null is empty."""
    return F.concat(*[F.coalesce(v.cast("string"), F.lit("")) for v in values])


def path_cat(*values: Column) -> Column:
    """Parts without their quotes, joined by a slash; null is empty but keeps its slash."""
    return F.concat_ws("/", *[F.coalesce(F.replace(v.cast("string"), F.lit('"'), F.lit("")), F.lit("")) for v in values])


def full_text(text: Column, start: Column, end: Column) -> Column:
    """Characters start (from 0) to end (exclusive)."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def extracted(text: Column, start: Column, end: Column) -> Column:
    return F.substring(full_text(text, start, end), F.lit(1), F.lit(SHOWN))


def checksum(text: Column, start: Column, end: Column) -> Column:
    """base64 of SHA-256 of the whole, uncut text."""
    return F.base64(F.unhex(F.sha2(full_text(text, start, end), 256)))


def nearby(text: Column, first: Column, last: Column) -> Column:
    """Lines two before to two after (from 1, inclusive); null if too long."""
    begin = F.greatest(first - 2, F.lit(1))
    chunk = F.array_join(F.slice(F.split(text, "\n", -1), begin, last + 2 - begin + 1), "\n")
    return F.when(F.length(chunk) <= LARGEST_CHUNK, chunk)


def index_key(org: Column, name: Column, repo_id: Column, index_id: Column) -> Column:
    return F.concat_ws("/", org, name, repo_id.cast("string"), index_id.cast("string"))


def repo_of_key(key: Column) -> Column:
    return F.element_at(F.split(key, "/"), -2).cast("int")


def range_text(l1: Column, c1: Column, l2: Column, c2: Column) -> Column:
    return F.format_string("L%d:%d-L%d:%d", l1, c1, l2, c2)


def remote_owner(url: Column) -> Column:
    return F.regexp_extract(url, r"(?:https?://(?:[^@/]+@)?|git@|ssh://git@)(?:www\.)?(?:github\.com|bitbucket\.org)[/:]([^/]+)/", 1)


def remote_name(url: Column) -> Column:
    return F.regexp_extract(url, r"(?:github\.com|bitbucket\.org)[/:][^/]+/([^/]+?)(?:\.git)?/?$", 1)


def module_path(path: Column) -> Column:
    """A path as an import names it."""
    return F.regexp_replace(path, r"(?:/index)?\.(?:tsx?|jsx?)$", "")


def letters(n: int) -> str:
    """0 -> A, 25 -> Z, 26 -> AA."""
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def letters_number(text: str) -> int:
    n = 0
    for c in text:
        n = n * 26 + ord(c) - 64
    return n - 1


def row_id(*parts: Column) -> Column:
    """An id that depends on the parts alone, so that a repeated task gives the same rows."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)


def import_target(here: Column, module: Column) -> Column:
    """The file, without ending, that a relative import in file ``here`` names; other modules as they are."""
    folder = F.regexp_replace(here, "/?[^/]*$", "")
    joined = F.split(F.concat_ws("/", F.when(folder != "", folder), module), "/")
    step = lambda done, part: F.when((part == ".") | (part == ""), done).when((part == "..") & (F.size(done) > 0), F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))
    plain = F.array_join(F.aggregate(joined, F.array().cast("array<string>"), step), "/")
    return F.when(module.startswith("."), F.regexp_replace(plain, "(/index)?\\.(ts|tsx|js|jsx)$", "")).otherwise(module)


def at_path(document: Column, path: str, required: bool = False) -> Column:
    """The value at ``$.a.b`` of a JSON text; null, or an error if it is required, where there is none."""
    value = F.get_json_object(document, path)
    return F.coalesce(value, F.raise_error(F.lit(f"nothing at {path}")).cast("string")) if required else value
