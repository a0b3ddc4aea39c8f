"""Personal data by anchor expansion.

One Aho-Corasick automaton finds at-signs, plus signs, digits, address schemes and identifier cues.
Each anchor starts a local parser that expands to the boundaries of its kind and validates:

* ``email``: leftwards over the local part, rightwards over a dotted domain;
* ``ip``: four dotted numbers from the first digit of a number, each at most 255;
* ``card``: digits with single blanks or hyphens between, 12 to 19 passing Luhn's test;
* ``phone``: a plus and digits with blanks, dots, brackets, hyphens, 9 to 15 digits;
* ``url``: a scheme and a host with a dot, up to a blank, quote or bracket (added by the method);
* ``account``: the value after a cue such as ``token =``: eight or more letters, digits, ``_`` or
  ``-`` with a digit among them; after ``IBAN`` also a number in groups that passes its mod-97 test
  (added by the method).

Within a kind matches are leftmost and do not overlap; a match that fails its test is passed over as
a whole. Offsets count code points. Defined cases: null text counts as empty; very long texts
are searched whole; of spans of one start the kinds come in the order above; rows of equal id are
documents of their own; extra columns are passed over; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from meshlark.llm.common import keep_schema, narrowed, restored, texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("token", "api_key", "apikey", "api-key", "secret", "password", "passwd", "IBAN", "account", "passport", "ssn", "SSN")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
WORD_CHARS = LOCAL - frozenset(".%+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DIAL = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ADDRESS = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?(?:/[^\x00-\x20\"'<>()]*)?")
VALUE = re.compile(r"s?\"?\x20?(?:[=:#]|is|no\.?)?\x20?[\"']?([A-Za-z0-9_-]{8,})")
IBAN = re.compile(r"[\x20:=#]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")


@lru_cache(1)
def automaton():
    found = ahocorasick.Automaton()
    found.add_word("@", ("@", 1))
    found.add_word("+", ("+", 1))
    for d in DIGITS:
        found.add_word(d, ("0", 1))
    for s in SCHEMES:
        found.add_word(s, ("scheme", len(s)))
    for c in CUES:
        for form in {c, c.lower(), c.upper(), c.capitalize()}:
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def mod97(number: str) -> bool:
    """The check of international account numbers: country and check digits moved to the end, letters
    as numbers from 10."""
    number = number.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def find(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)``, by start and then kind as listed."""
    out: list[tuple[int, int, str]] = []
    email_end = ip_end = card_end = url_end = account_end = 0
    for at, (cue, size) in automaton().iter(text):
        if cue == "0":
            if at >= card_end and (m := CHAIN.match(text, at)):
                card_end = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((at, card_end, "card"))
            if at >= ip_end and (at == 0 or text[at - 1] not in DIGITS) and (m := QUAD.match(text, at)):
                ip_end = m.end()
                if all(map(small, m.groups())):
                    out.append((at, ip_end, "ip"))
        elif cue == "@":
            start = at
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email_end = m.end()
                out.append((start, email_end, "email"))
        elif cue == "+":
            if (m := DIAL.match(text, at)) and 9 <= sum(c in DIGITS for c in m[0]) <= 15:
                out.append((at, m.end(), "phone"))
        elif cue == "scheme":
            start = at - size + 1
            if start >= url_end and (m := ADDRESS.match(text, at + 1)):
                url_end = at + 1 + len(m[0].rstrip(".,;:!?"))
                out.append((start, url_end, "url"))
        elif at + 1 >= account_end and (at < size or text[at - size] not in WORD_CHARS):
            m = IBAN.match(text, at + 1)
            if m and m.start(1) > at + 1 and mod97(m[1]):
                account_end = m.end(1)
                out.append((m.start(1), account_end, "account"))
                continue
            m = VALUE.match(text, at + 1)
            if m and m.start(1) > at + 1 and any(c in DIGITS for c in m[1]):
                account_end = m.end(1)
                out.append((m.start(1), account_end, "account"))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each stretch of overlapping spans becomes the name of its first kind, in angle brackets."""
    parts, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            parts += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = True) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` and, if wanted, the redacted
    ``text``; columns named in ``keep`` are passed on."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", text string" * with_text
    rows = narrowed(docs, id_col, text_col, keep)

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6 + with_text)]
            for text in texts(batch.column("text")):
                spans = find(text)
                base = [s for s in spans if s[2] in BASE]
                for i, kind in enumerate(BASE):
                    out[i].append(sum(s[2] == kind for s in base))
                out[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out[5].append(joined(spans))
                if with_text:
                    out[6].append(redact(text, spans))
            columns = [batch.column("doc_id"), *(pa.array(x, pa.int64() if i < 4 else pa.string()) for i, x in enumerate(out)), *(batch.column(f"keep_{c}") for c in keep)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", *["text"] * with_text, *(f"keep_{c}" for c in keep)])

    return restored(rows.mapInArrow(run, schema + keep_schema(rows, keep)), keep)


def op10(spark, sf_dir):
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
