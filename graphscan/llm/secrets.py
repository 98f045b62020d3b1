"""Operator 3: secrets by base patterns and by password guess cost.

Base kinds (leftmost, non-overlapping, per kind): ``assign`` (a credential
name, a separator and a value of 12 or more characters), ``access`` (access
key ids), ``hex`` (runs of 16 or more hexadecimal digits).

The method adds kind ``guess``: values in a credential context, whatever their
alphabet, whose estimated guess cost is high.  The cost is the minimum over
all segmentations of the value into common words, dates, repeats, keyboard
walks and brute-force spans (each span's log10 of guesses, plus a price per
further span), found by dynamic programming over the value's positions.  A
span may begin at any place; of the starts inside a run those that can never
win again are dropped, so the work stays near linear in the value's length.
Values that a guesser reaches quickly (placeholders, plain words) are thus
left alone.  A value that one base span covers whole is not scored again; one
that it covers in part is, and redaction masks both as one.

Words are ranked: usual passwords first, then the words of a public vocabulary
file (``vocabulary``, a tokenizers-library file whose ids follow frequency).

Cases.  A null text is empty and has no spans; values of any length are
scored whole; repeated documents are each reported, null doc_ids too; an empty
table gives no rows; extra columns are ignored by ``find_secrets`` and kept by
``redact_secrets``, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import annotate, bounded_batches, map_arrow, once, string_slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # an inner start ends where the outer does, so a minimum length drops the same runs
HEX = re.compile(r"[0-9a-f]{16,}")
CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|credentials?|auth|private[_-]?key)["']?\s{0,8}(?::=|=>|[:=]|\bis\b)\s{0,8}["']?([^\s"'<>]{6,})""", re.I | re.A
)
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_CONTEXT_HINTS = (*_ASSIGN_HINTS, "passphrase", "pwd", "credential", "auth", "api-key", "private_key", "private-key", "privatekey")
KINDS = ("assign", "access", "hex", "guess")

_WORDS = (
    "the and for are but not you all any can had her was one our out day get has him his how man new now old see two way who boy did its let put say she too use "
    "password passwd pass secret token api key auth admin root user login welcome letmein monkey dragon master shadow sunshine princess football baseball iloveyou "
    "trustno hello freedom whatever qazwsx michael jordan superman batman test testing example sample default changeme change please none null true false undefined "
    "your here insert placeholder value string number private public access config server client service database mysql postgres redis local localhost production "
    "staging development dev prod home work love baby angel summer winter spring autumn monday friday january february march april may june july august september "
    "october november december system guest demo temp temporary super secure security company internal basic bearer header session cookie this that with from have "
    "will been were said each which their time would there could other than then them these some make like into over such only also after first well water world "
    "about again place great where right still mean same tell does set three want air also play small end put hand port large spell add even land must big high"
).split()
_LEET = str.maketrans("@4310$57!", "aaeiossti")
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "9876543210")
_NEXT: dict[str, set[str]] = {}
for _row in _ROWS:
    for _a, _b in zip(_row, _row[1:]):
        _NEXT.setdefault(_a, set()).add(_b)
        _NEXT.setdefault(_b, set()).add(_a)
_DATES = [
    re.compile(p, re.A)
    for p in (r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d", r"(?:19|20)\d\d")
]
#: Least lengths of repeats and of walks.
REPEAT, WALK = 3, 4
_PRICE = math.log10(2)  # for each further span: where it begins and of which kind it is


class Words:
    """Ranks of words of three or more letters."""

    def __init__(self, vocabulary: str | None = None):
        words = dict.fromkeys(_WORDS)
        if vocabulary:
            with open(vocabulary, encoding="utf-8") as source:
                ids = json.load(source)["model"]["vocab"]
            # a word begins with the letter that stands for a blank, or ends with a mark
            starts = sorted((i, w.removeprefix("\u0120").removesuffix("</w>").lower()) for w, i in ids.items() if w.startswith("\u0120") or w.endswith("</w>"))
            words |= dict.fromkeys(w for _, w in starts if len(w) >= 3 and w.isascii() and w.isalpha())
        self.rank = {w: i + 1 for i, w in enumerate(words)}
        self.longest = max(map(len, self.rank))


_USUAL = Words()


def guess_cost(value: str, words: Words = _USUAL) -> float:
    """log10 of the guesses needed for a value: the cheapest segmentation."""
    return segment(value, words)[0]


def alphabet_cost(value: str) -> float:
    """log10 of the guesses for one character by brute force."""
    return math.log10(max(sum(size for pattern, size in ((r"[a-z]", 26), (r"[A-Z]", 26), (r"[0-9]", 10), (r"[^A-Za-z0-9]", 33)) if re.search(pattern, value)), 10))


def word_cost(value: str, low: str, plain: str, rank: int) -> float:
    """Of a word, written ``value``, in lower case ``low`` and with digits for letters undone ``plain``."""
    return math.log10(rank + 10) + (value != low) * math.log10(4) + (low != plain) * math.log10(4)


def repeat_cost(one: float, size: int) -> float:
    return one + math.log10(size)


def walk_cost(size: int) -> float:
    return math.log10(94 * 4 * size)


def date_cost(size: int) -> float:
    return math.log10(365 * 120 if size > 4 else 130)


class _Starts:
    """The starts in a run that may still be the cheapest: cost(i) + log10(j - i) for growing j."""

    def __init__(self):
        self.held: list[tuple[int, float]] = []

    def cheapest(self, j: int) -> tuple[float, int]:
        costs = [c + math.log10(j - i) for i, c in self.held]
        m = min(range(len(costs)), key=costs.__getitem__)
        i, c = self.held[m]
        # a later start that loses now loses ever after; an earlier one that began dearer never wins again
        if len(costs) > 1:
            self.held = [x for x, cost in zip(self.held, costs) if x[0] == i or x[0] < i and x[1] < c or x[0] > i and cost < costs[m]]
        return costs[m], i


def segment(value: str, words: Words = _USUAL) -> tuple[float, list[tuple[str, int, int]]]:
    """Minimum log10 guesses and the segmentation (kind, start, end) that has it."""
    n = len(value)
    low = value.lower() if len(value.lower()) == n else value
    plain = low.translate(_LEET)
    one = alphabet_cost(value)
    edges: dict[int, list[tuple[int, str, float]]] = {}
    for i in range(n):
        for j in range(i + 3, min(n, i + words.longest) + 1):
            options = [word_cost(value[i:j], low[i:j], w, words.rank[w]) for w in {low[i:j], plain[i:j]} if w in words.rank]
            if options:
                edges.setdefault(j, []).append((i, "word", min(options)))
        if value[i].isdigit():
            for m in (p.match(value, i) for p in _DATES):
                if m:
                    edges.setdefault(m.end(), []).append((i, "date", date_cost(m.end() - i)))
    best = [0.0] * (n + 1)
    back: list[tuple[int, str]] = [(0, "")] * (n + 1)
    begun = lambda i: best[i] + (i > 0) * _PRICE
    run = walk = brute = 0  # where the current repeat and walk begin, and the cheapest brute-force span
    repeats, walks = _Starts(), _Starts()
    for j in range(1, n + 1):
        if j > 1:
            if low[j - 1] != low[j - 2]:
                run, repeats = j - 1, _Starts()
            if low[j - 1] not in _NEXT.get(low[j - 2], ()):
                walk, walks = j - 1, _Starts()
            # best[i] - i * one decides among brute-force starts, so one is carried
            if begun(j - 1) - (j - 1) * one < begun(brute) - brute * one:
                brute = j - 1
        options = [(begun(brute) + (j - brute) * one, brute, "brute")]
        for i, kind, cost in edges.get(j, ()):
            options.append((begun(i) + cost, i, kind))
        if j - run >= REPEAT:
            repeats.held.append((j - REPEAT, begun(j - REPEAT)))
            cost, i = repeats.cheapest(j)
            options.append((cost + repeat_cost(one, 1), i, "repeat"))
        if j - walk >= WALK:
            walks.held.append((j - WALK, begun(j - WALK)))
            cost, i = walks.cheapest(j)
            options.append((cost + walk_cost(1), i, "walk"))
        best[j], *back[j : j + 1] = min(options)[0], min(options)[1:]
    spans, j = [], n
    while j:
        i, kind = back[j]
        spans.append((kind, i, j))
        j = i
    return best[n], spans[::-1]


def find(text: str | None, least_cost: float = 12.0, words: Words = _USUAL) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) by start, then by kind as listed in KINDS."""
    text = text or ""
    low = text.lower()
    spans = [("access", *m.span()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    if any(h in low for h in _ASSIGN_HINTS):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if any(h in low for h in _CONTEXT_HINTS):
        base = [(a, b) for _, a, b in spans]
        for m in CONTEXT.finditer(text):
            a, b = m.span(1)
            value = m.group(1).rstrip(".,;:!?)]}")
            b = a + len(value)
            # a base span may end inside the value, or begin there: only one that covers it whole spares the rest
            if len(value) >= 6 and not any(x <= a and b <= y for x, y in base) and guess_cost(value, words) >= least_cost:
                spans.append(("guess", a, b))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every found span replaced (overlapping spans as one)."""
    out, at = [], 0
    merged: list[list[int]] = []
    for _, a, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def _written(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(documents: DataFrame, least_cost: float = 12.0, text_column: str = "text", with_redacted: bool = False, vocabulary: str | None = None) -> DataFrame:
    """One row per document: counts per kind, spans as text, digest of the base spans, redacted text if asked."""

    bounded_batches(documents.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = once(("words", vocabulary), lambda: Words(vocabulary))
        counts = {k: [] for k in KINDS}
        digests, written, redacted = [], [], []
        for _, _, texts in string_slices(batch.column(1)):
            for text in texts:
                spans = find(text, least_cost, words)
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in spans))
                digests.append(hashlib.sha256(_written(s for s in spans if s[0] != "guess").encode()).hexdigest())
                written.append(_written(spans))
                if with_redacted:
                    redacted.append(redact(text, spans) if spans else text)
        columns = [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(written, pa.string())]
        names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
        if with_redacted:
            columns.append(pa.array(redacted, pa.string()))
            names.append("redacted")
        return pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string" + ", redacted string" * with_redacted
    return map_arrow(documents.selectExpr("cast(doc_id as long) as doc_id", f"`{text_column}` as text"), work, schema)


def redact_secrets(documents: DataFrame, least_cost: float = 12.0, vocabulary: str | None = None) -> DataFrame:
    """All rows and columns of ``documents``, found spans replaced in the text; ``n_chars``, if there, follows."""

    bounded_batches(documents.sparkSession)

    def work(texts: pa.Array) -> dict[str, pa.Array]:
        words = once(("words", vocabulary), lambda: Words(vocabulary))
        out: list[str | None] = []
        for _, _, part in string_slices(texts):
            found = [find(text, least_cost, words) for text in part]
            out += [redact(text, spans) if spans else None for text, spans in zip(part, found)]
        return {"redacted_text": pa.array(out, pa.string())}

    made = annotate(documents, "text", work, "redacted_text string")
    names = [f"c{i}" for i in range(len(made.columns))]
    plain, changed = made.toDF(*names), F.col(names[-1])
    columns = []
    for name, c in zip(documents.columns, names):
        if name == "text":
            columns.append(F.coalesce(changed, F.col(c)))
        elif name == "n_chars":
            columns.append(F.when(changed.isNotNull(), F.char_length(changed).cast("long")).otherwise(F.col(c)))
        else:
            columns.append(F.col(c))
    return plain.select(*(x.alias(f"x{i}") for i, x in enumerate(columns))).toDF(*documents.columns)
