"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, types as T

from .base import SPAN, per_text, span_digests

BASE_KINDS = ["email", "ip", "card", "phone"]
MORE_KINDS = ["iban", "dni", "nir"]

# The patterns, written so that no start is tried twice within a run of characters.
EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
DNI = re.compile(r"(?<![A-Za-z0-9])([0-9]{8})-?([A-Z])(?![A-Za-z0-9])")
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
NIR = re.compile(r"(?<![A-Za-z0-9])[12]\x20?[0-9]{2}\x20?(?:0[1-9]|1[0-2])\x20?[0-9]{2}\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{2}(?![A-Za-z0-9])")

#: Words near a span that speak for it, or against it, in the texts' languages.
CONTEXT = {
    "email": ("mail", "contact", "kontakt", "correo", "courriel", "write"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "tarjeta", "carte", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "llamar"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte", "transfer"),
    "dni": ("dni", "nif", "identidad", "documento", "identity"),
    "nir": ("nir", "insee", "social", "security", "sociale", "sécurité", "securite"),
}
AGAINST = ("version", "serial", "isbn", "order", "invoice", "sample", "test")
#: Where a kind's score starts; words for it add FOR, words against it take LESS. With the threshold of 0.5, a sample IBAN
#: goes unless a word speaks for it, and national numbers, which many codes look like, need one.
START_SCORE = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.7, "dni": 0.4, "nir": 0.4}
FOR, LESS = 0.2, 0.3
_NOT_DIGITS = bytes(i for i in range(256) if not 48 <= i <= 57)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The IBAN checksum of letters and digits without spaces."""
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def iban_end(text: str, start: int, end: int) -> int | None:
    """The last end of a code from start, at a group border up to end, that mod-97 confirms."""
    while end > start:
        if mod97(text[start:end].replace(" ", "")):
            return end
        end = text.rfind(" ", start, end)
    return None


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses in time linear in the text: from each domain back to the local part."""
    out, done = [], 0
    for m in EMAIL_DOMAIN.finditer(text):
        s = m.start()
        while s > done and EMAIL_LOCAL.match(text, s - 1):
            s -= 1
        if s < m.start():
            out.append((s, m.end()))
            done = m.end()
    return out


def score(text: str, start: int, end: int, kind: str, reach: int) -> float:
    near = text[max(0, start - reach) : start].lower() + " " + text[end : end + reach].lower()
    words = set(re.findall(r"[^\W\d_]+", near))
    value = START_SCORE[kind] + FOR * bool(words & set(CONTEXT[kind])) - LESS * bool(words & set(AGAINST))
    return round(min(1.0, max(0.0, value)), 3)


def scan(raw: bytes, reach: int, least: float) -> list[tuple]:
    """All findings of one text as (start, rank, end, kind, score), in order."""
    digits = len(raw.translate(None, _NOT_DIGITS))
    if b"@" not in raw and digits < 4:
        return []
    text = raw.decode("utf-8", "replace")
    spans = [(s, 0, e, "email") for s, e in emails(text)] if b"@" in raw else []
    if digits >= 4:
        spans += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split("."))]
    if digits >= 9:
        spans += [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15] if b"+" in raw else []
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(code := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(code):
                spans.append((m.start(), 2, m.end(), "card"))
    found = [(*x, score(text, x[0], x[2], x[3], reach)) for x in spans]
    found += [(s, rank, e, kind, value) for s, rank, e, kind in confirmed(text, digits) if (value := score(text, s, e, kind, reach)) >= least]
    return sorted(found)


def confirmed(text: str, digits: int) -> list[tuple[int, int, int, str]]:
    """Codes beside the base kinds that their checksums confirm, as (start, rank, end, kind)."""
    out, at = [], 0
    while m := IBAN.search(text, at):
        end = iban_end(text, *m.span())
        if end:
            out.append((m.start(), 4, end, "iban"))
        at = end or m.end()
    if digits >= 8:
        out += [(m.start(), 5, m.end(), "dni") for m in DNI.finditer(text) if DNI_LETTERS[int(m[1]) % 23] == m[2]]
    if digits >= 15:
        out += [(m.start(), 6, m.end(), "nir") for m in NIR.finditer(text) if (int((n := m.group().replace(" ", ""))[:13]) + int(n[13:])) % 97 == 0]
    return out


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 48, least: float = 0.5) -> DataFrame:
    """Find personal data in whole texts: (id, findings), one row for each row of df.

    Patterns propose spans; parts up to 255 confirm an ip, Luhn's sum a card, mod-97 an iban and a nir (French social
    security number), mod-23 the letter of a dni (Spanish identity number), the count of digits a phone number. Words
    within reach characters raise or lower the score that each finding carries. The kinds email, ip, card and phone are
    kept whatever their score; the others need the score `least`, so there the words decide.

    Null and empty texts have no findings; a null id, repeated rows and rows of any length keep their row; an empty
    table gives an empty table; other columns are neither read nor returned. Work is linear in the text.
    """

    def work(texts: list[bytes]) -> list[list]:
        return [[[dict(zip(SPAN.names, x, strict=True)) for x in scan(raw, reach, least)] for raw in texts]]

    return per_text(df, work, [T.StructField("findings", T.ArrayType(SPAN))], id_col, text_col)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    return span_digests(find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet")), "doc_id", BASE_KINDS, MORE_KINDS)
