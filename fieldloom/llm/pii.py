"""Personal data in texts: anchors by Aho-Corasick, boundaries by local parsers around each anchor."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The first four are the base kinds; the others are what the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "url", "secret")
#: Words, in any case, that announce an account number, an identity document, a social security number or a secret.
CUES = {
    "account": ("iban", "account", "acct", "konto", "kontonummer", "cuenta", "compte"),
    "passport": ("passport", "reisepass", "pasaporte", "passeport"),
    "ssn": ("ssn", "social security"),
    "secret": ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key", "passwort", "contraseña"),
}
# The lengths of IBANs.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18,
    "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}

_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_LABELS = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
_PARTS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])*")
_TAIL = re.compile(r"[ ().0-9-]+")
_LEAD = re.compile(r"(?:[ _](?:no|nr|num|number|key|id)\.?)?[\"']? {0,3}(?:[:#=]|is)? {0,3}", re.IGNORECASE)
_NUMBER = re.compile(r"[A-Za-z]{0,2}[0-9](?:[ -]?[A-Za-z0-9])*")
_IBAN = re.compile(r"([A-Za-z]{2})[0-9]{2}(?: ?[A-Za-z0-9])*")
_PASSPORT = re.compile(r"(?=[A-Za-z]*[0-9])[A-Za-z0-9]{6,9}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9])")
_SECRET = re.compile(r"[\"']?((?=[A-Za-z_+/.-]*[0-9])(?=[0-9_+/.-]*[A-Za-z])[A-Za-z0-9_+/=.-]{12,})")
_FOLD = {c: c + 32 for c in range(65, 91)}
_URL = re.compile(r"[^\s<>\"'`{}|\\^]+")


def anchors() -> ahocorasick.Automaton:
    """Cues and what they announce: one automaton for every kind."""
    found = ahocorasick.Automaton()
    for text, kind in [("@", "@"), ("+", "+"), ("://", ":"), *((d, "0") for d in "0123456789")]:
        found.add_word(text, (kind, len(text)))
    for kind, cues in CUES.items():
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _email(text: str, at: int, low: int) -> tuple[int, int] | None:
    start = at
    while start > low and text[start - 1] in _LOCAL:
        start -= 1
    domain = _LABELS.match(text, at + 1)
    return (start, domain.end()) if start < at and domain and "." in domain[0] else None


def _phone(text: str, at: int) -> tuple[int, int] | None:
    tail = _TAIL.match(text, at + 2) if "0" <= text[at + 1 : at + 2] <= "9" else None
    if not tail:
        return None
    end = tail.end()
    while end > at + 3 and not "0" <= text[end - 1] <= "9":
        end -= 1
    return (at, end) if end > at + 3 else None


def iban_length(text: str, start: int) -> int | None:
    """Where a valid IBAN that begins at `start` ends: its country's length and its check digits are right."""
    found = _IBAN.match(text, start)
    left = IBAN_LENGTHS.get(found[1].upper(), 0) if found else 0
    if not left:
        return None
    end, plain = start, ""
    while end < found.end() and len(plain) < left:
        plain += text[end] if text[end] != " " else ""
        end += 1
    whole = len(plain) == left and (end == len(text) or not (text[end].isascii() and text[end].isalnum()))
    return end if whole and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else None


def _cued(kind: str, text: str, start: int, end: int) -> tuple[str, int, int] | None:
    """(kind, start, end) of what a cue announces, if it is valid: after a word of its own, an IBAN with right check
    digits or else 6 to 17 digits; a passport's number; a social security number of a group that is given out; a
    secret of 12 characters and more, both letters and digits among them."""
    if start and text[start - 1].isalnum():
        return None
    at = _LEAD.match(text, end).end()
    if kind == "account":
        found = _NUMBER.match(text, at)
        if not found or at == end:
            return None
        if (close := iban_length(text, at)) is not None:
            return "account", at, close
        like_iban = bool(_IBAN.match(text, at))
        return ("account", *found.span()) if not like_iban and 6 <= sum(c.isdigit() for c in found[0]) <= 17 else None
    if kind == "secret":
        found = _SECRET.match(text, at)
        return ("secret", *found.span(1)) if found and at > end else None
    found = {"passport": _PASSPORT, "ssn": _SSN}[kind].match(text, at)
    return ("account", *found.span()) if found and at > end else None


def _url(text: str, at: int, low: int) -> tuple[int, int] | None:
    start = at
    while start > low and text[start - 1] in _SCHEME:
        start -= 1
    while start < at and not text[start].isalpha():
        start += 1
    rest = _URL.match(text, at + 3)
    if start == at or not rest:
        return None
    end = at + 3 + len(rest[0].rstrip(".,;:!?)]"))
    return (start, end) if end > at + 3 else None


def spans_of(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed and then start. Within a kind matches are leftmost
    and don't overlap; a match that fails its check is dropped and the search goes on behind it."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    low = text.lower()
    for last, (kind, n) in automaton.iter(low if len(low) == len(text) else text.translate(_FOLD)):
        at = last - n + 1
        if kind == "0":
            if at >= done["ip"]:
                parts = _PARTS.match(text, at)
                done["ip"] = parts.end()
                runs = parts[0].split(".")
                for k in range(0, len(runs) - 3, 4):
                    four = runs[k : k + 4]
                    size = sum(map(len, four)) + 3
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                        found["ip"].append((at, at + size))
                    at += size + 1
                at = last
            if at >= done["card"]:
                match = _DIGITS.match(text, at)
                done["card"] = match.end()
                digits = match[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(match.span())
        elif kind == "@":
            if at >= done["email"] and (span := _email(text, at, done["email"])):
                found["email"].append(span)
                done["email"] = span[1]
        elif kind == "+":
            if at >= done["phone"] and (span := _phone(text, at)):
                done["phone"] = span[1]
                if 8 <= sum("0" <= c <= "9" for c in text[span[0] : span[1]]) <= 15:
                    found["phone"].append(span)
        elif kind == ":":
            if at >= done["url"] and (span := _url(text, at, done["url"])):
                found["url"].append(span)
                done["url"] = span[1]
        elif span := _cued(kind, text, at, last + 1):
            if span[1] >= done[span[0]]:
                found[span[0]].append(span[1:])
                done[span[0]] = span[2]
    return [(k, *span) for k in KINDS for span in sorted(found[k])]


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of personal data in every text; a null or empty text has none. A row comes out for
    each row, repeated and null doc_ids included; other columns are not looked at."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t, automaton)] if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, _SPAN)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, SPANS)


def redact(docs: DataFrame) -> DataFrame:
    """Each document, all columns, with its spans replaced by [kind]; of spans that overlap, the earlier and then longer
    counts. A null text stays null; repeated rows and null doc_ids come out as they are, an empty table gives none."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for batch in batches:
            out = []
            for t in batch.column("text").to_pylist():
                parts, at = [], 0
                for start, end, kind in sorted(((s, e, k) for k, s, e in spans_of(t or "", automaton)), key=lambda x: (x[0], -x[1])):
                    if start >= at:
                        parts += [t[at:start], f"[{kind}]"]
                        at = end
                out.append(None if t is None else "".join([*parts, t[at:]]))
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string()))

    return docs.mapInArrow(rewrite, docs.schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """The contract's counts and digests of the spans that `find_pii` gives."""
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *map(of, BASE_KINDS), F.size("spans").cast("long").alias("n_spans"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
