"""Secret scans: rule matches, plus high-entropy windows of candidate strings."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, types as T

from .base import SPAN, per_text, span_digests

BASE_KINDS = ["assign", "access", "hex"]
MORE_KINDS = ["entropy"]

# The rules' patterns.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Candidates, or parts of them between two that WORDS takes out, that look random and are not secrets.
ALLOWED = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
    r"sha(1|256|384|512)[-_=].*",  # integrity digests
    r"(?i)(.)\1*",
    r"[A-Za-z]+([-_/][A-Za-z]+)*",  # words joined by punctuation; LETTERS judges those without any
    r"[0-9+/_=-]+",  # numbers, rules and separators
)
#: Segments that say they are no secret; what is beside them in the same run is still judged.
WORDS = r"(?i).*(example|changeme|placeholder|dummy|xxxxxx).*"
_SEGMENT = re.compile(r"[^/_=-]+")
_LETTERS = re.compile(r"[A-Za-z]+")
#: Letters alone are a secret only at this entropy and with so many changes between cases a character: names of many
#: words joined by capitals have few.
LETTER_ENTROPY, CASE_CHANGES = 4.0, 0.35

_HEX_TABLE = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_RUN_TABLE = bytes(120 if i < 128 and re.match(r"[A-Za-z0-9+/_=-]", chr(i)) else 32 for i in range(256))
_CLASSES = (("hex", re.compile(r"[0-9a-fA-F]+")), ("base64", re.compile(r"[A-Za-z0-9+/=]+")), ("token", re.compile(r".+", re.S)))
#: Bits a character that a window must reach, by the class of its candidate.
THRESHOLDS = {"hex": 3.0, "base64": 3.7, "token": 3.7}


def windows(text: str, width: int) -> list[float]:
    """Shannon entropy in bits a character of every window, from counts that change by one in and one out."""
    if len(text) < width:
        return []
    xlogx = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    out = []
    whole = math.log2(width)
    for i, c in enumerate(text):
        if i >= width:
            old = text[i - width]
            n = counts[old]
            total += xlogx[n - 1] - xlogx[n]
            counts[old] = n - 1
        n = counts.get(c, 0)
        total += xlogx[n + 1] - xlogx[n]
        counts[c] = n + 1
        if i >= width - 1:
            out.append(whole - total / width)
    return out


def mixed_case(text: str) -> bool:
    """Whether letters change between upper and lower case as often as chance would have it."""
    return sum(a.isupper() != b.isupper() for a, b in zip(text, text[1:]) if a.isalpha() and b.isalpha()) >= CASE_CHANGES * len(text)


def parts_of(text: str, words: re.Pattern | None) -> list[tuple[int, str]]:
    """What is left of a candidate beside the segments that words takes out, as (start, text)."""
    out, at = [], 0
    for m in _SEGMENT.finditer(text) if words else ():
        if words.fullmatch(m.group()):
            out.append((at, text[at : m.start()]))
            at = m.end()
    return [*out, (at, text[at:])]


def entropy_spans(text: str, start: int, width: int, thresholds: dict[str, float]) -> list[tuple[int, int, float]]:
    """Merged high-entropy windows of one candidate that begins at start, each with its highest entropy."""
    kind = next(k for k, pattern in _CLASSES if pattern.fullmatch(text))
    least = thresholds[kind]
    if not re.search(r"[0-9]", text):
        if not mixed_case(text):
            return []
        least = max(least, LETTER_ENTROPY)
    elif not re.search(r"[A-Za-z]", text):
        return []
    out: list[tuple[int, int, float]] = []
    for i, h in enumerate(windows(text, width)):
        if h < least:
            continue
        if out and start + i <= out[-1][1]:
            out[-1] = (out[-1][0], start + i + width, max(out[-1][2], h))
        else:
            out.append((start + i, start + i + width, h))
    return out


def is_allowed(text: str, allowed: list[re.Pattern]) -> bool:
    return any(p.fullmatch(text) for p in allowed) and not (_LETTERS.fullmatch(text) and mixed_case(text))


def scan(raw: bytes, width: int, thresholds: dict[str, float], allowed: list[re.Pattern], words: re.Pattern | None) -> list[tuple]:
    """All findings of one text as (start, rank, end, kind, score), in order."""
    found: list[tuple] = []
    text = None
    lower = raw.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        text = raw.decode("utf-8", "replace")
        found += [(m.start(), 0, m.end(), "assign", 1.0) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if b"AKIA" in raw:
        text = text or raw.decode("utf-8", "replace")
        found += [(m.start(), 1, m.end(), "access", 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in raw.translate(_HEX_TABLE):
        text = text or raw.decode("utf-8", "replace")
        found += [(m.start(), 2, m.end(), "hex", 1.0) for m in HEX.finditer(text)]
    if b"x" * 20 in raw.translate(_RUN_TABLE):
        text = text or raw.decode("utf-8", "replace")
        base = sorted((s, e) for s, _, e, _, _ in found)
        k, reach = 0, -1
        candidates = ((m.start() + at, part) for m in CANDIDATE.finditer(text) if not is_allowed(m.group(), allowed) for at, part in parts_of(m.group(), words) if len(part) >= width)
        for at, part in candidates:
            if part and is_allowed(part, allowed):
                continue
            for s, e, h in entropy_spans(part, at, width, thresholds):
                while k < len(base) and base[k][0] <= s:
                    reach = max(reach, base[k][1])
                    k += 1
                if e > reach:  # not inside a rule's match
                    found.append((s, 3, e, "entropy", min(1.0, h / 6)))
    return sorted(found)


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, thresholds: dict[str, float] | None = None, allow: tuple[str, ...] = ALLOWED, allow_words: str | None = WORDS) -> DataFrame:
    """Find secrets in whole texts: (id, findings), one row for each row of df.

    The rules assign, access and hex match patterns. Strings of 20 or more token characters are candidates for
    `entropy`: a window slides over each, its Shannon entropy kept by incremental counts; windows at or above the
    threshold of the candidate's character class are merged. allow_words takes single segments (between / _ = and -) out
    of a candidate, allow lists patterns of whole candidates and of what lies beside such segments; neither suppresses a
    rule's match. An entropy span inside a rule's match is not repeated.

    Null and empty texts have no findings; a null id, repeated rows and rows of any length keep their row; an empty
    table gives an empty table; other columns are neither read nor returned. Work is linear in the text, and a batch
    of texts is all that is held.
    """
    limits, allowed, words = thresholds or THRESHOLDS, [re.compile(x, re.S) for x in allow], re.compile(allow_words, re.S) if allow_words else None

    def work(texts: list[bytes]) -> list[list]:
        return [[[dict(zip(SPAN.names, x, strict=True)) for x in scan(raw, width, limits, allowed, words)] for raw in texts]]

    return per_text(df, work, [T.StructField("findings", T.ArrayType(SPAN))], id_col, text_col)


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    return span_digests(secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")), "doc_id", BASE_KINDS, MORE_KINDS)
