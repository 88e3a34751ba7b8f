"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, plus signs, digits, schemes, identifier cues) in one pass over a
text; small deterministic parsers expand each anchor to the bounds of an email address, IP address, card, phone
number, URL, IBAN, account number or secret (key, token, password) and validate it. Positions are code points, ends
exclusive. Every parser is linear in the run it expands to, so texts of any length take time in proportion.

Null text counts as empty; empty texts have no spans; repeated rows give repeated results, an empty table an empty one.
Of two spans that begin at one place both are given (kinds in the order of KINDS). Columns but doc_id and text are not used.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import pieces

BASE = ("email", "ip", "card", "phone")
EXTRA = ("url", "iban", "account", "secret")
KINDS = {k: i for i, k in enumerate((*BASE, *EXTRA))}
#: Words that announce an account number.
CUES = ("iban", "account", "acct", "konto", "compte", "cuenta")
#: Words that announce a secret, and how well-known keys begin.
SECRET_CUES = ("token", "secret", "password", "passwd", "key")
SECRET_HEADS = ("AKIA", "ghp_")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
NUMERIC = re.compile(r"[0-9.]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"://[^\x20\x09-\x0D<>\"']+")
IBAN = re.compile(r"[^0-9A-Za-z]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{2,4}){3,8})(?![0-9A-Za-z])")
ACCOUNT = re.compile(r"[^0-9\n]{0,16}?([0-9][0-9-]{4,18}[0-9])(?![0-9])")
SECRET = re.compile(r"[\"']?[\x20]{0,2}[:=][\x20]{0,2}[\"']?((?=[A-Za-z_+/=-]{0,39}[0-9])[A-Za-z0-9_+/=-]{16,})")
KNOWN_KEY = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|ghp_[0-9A-Za-z]{36}(?![0-9A-Za-z])")


@cache
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for anchor in ("@", "+", "://", *sorted(DIGITS)):
        found.add_word(anchor, (anchor, len(anchor)))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, ("cue", len(form)))
    for cue in SECRET_CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, ("secret", len(form)))
    for head in SECRET_HEADS:
        found.add_word(head, ("head", len(head)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def email_bounds(text: str, at: int, low: int) -> tuple[int, int] | None:
    """The address around the at-sign at `at`; nothing before `low` belongs to it."""
    domain = DOMAIN.match(text, at + 1)
    start = at
    while start > low and text[start - 1] in LOCAL:
        start -= 1
    return (start, domain.end()) if domain and start < at else None


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all personal data, by start and then kind."""
    out: list[tuple[int, int, str]] = []
    done = dict.fromkeys((*KINDS, "numeric"), 0)
    for last, (anchor, size) in automaton().iter(text):
        at = last - size + 1
        if anchor == "@":
            if bounds := email_bounds(text, at, done["email"]):
                out.append((*bounds, "email"))
                done["email"] = bounds[1]
        elif anchor == "+":
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= sum(c in DIGITS for c in m[0]) <= 15:
                    out.append((at, m.end(), "phone"))
        elif anchor == "://":
            start = at
            while start > done["url"] and text[start - 1].isalpha() and text[start - 1].isascii():
                start -= 1
            if start < at and at >= done["url"] and (m := URL.match(text, at)):
                end = at + len(m[0].rstrip(".,;:!?)"))
                done["url"] = m.end()
                if end > at + 3:
                    out.append((start, end, "url"))
        elif anchor == "cue":
            if at >= done["iban"] and (m := IBAN.match(text, last + 1)) and iban_valid(m[1]):
                out.append((*m.span(1), "iban"))
                done["iban"] = m.end()
            elif at >= done["account"] and (m := ACCOUNT.match(text, last + 1)):
                out.append((*m.span(1), "account"))
                done["account"] = m.end()
        elif anchor == "secret":
            if at >= done["secret"] and (m := SECRET.match(text, last + 1)):
                out.append((*m.span(1), "secret"))
                done["secret"] = m.end()
        elif anchor == "head":
            if at >= done["secret"] and (m := KNOWN_KEY.match(text, at)):
                out.append((*m.span(), "secret"))
                done["secret"] = m.end()
        else:
            if at >= done["card"] and (m := CARD.match(text, at)):
                done["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((at, m.end(), "card"))
            if at >= done["numeric"]:
                run = NUMERIC.match(text, at)
                done["numeric"] = run.end()
                for m in IP.finditer(text, at, run.end()) if "." in run[0] else ():
                    if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
                        out.append((*m.span(), "ip"))
    return sorted(out, key=lambda s: (s[0], KINDS[s[2]], s[1]))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, all spans as `kind:start:end` joined by commas, and their number n_spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            counts: list[list[int]] = [[] for _ in BASE]
            digest, every, total = [], [], []
            for text in b.column("text").to_pylist():
                found = spans(text) if text else []
                for k, kind in enumerate(BASE):
                    counts[k].append(sum(s[2] == kind for s in found))
                base = ",".join(f"{k}:{a}:{e}" for a, e, k in found if k in BASE)
                digest.append(hashlib.sha256(base.encode()).hexdigest())
                every.append(",".join(f"{k}:{a}:{e}" for a, e, k in found))
                total.append(len(found))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(every, pa.string()), pa.array(total, pa.int64())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")
