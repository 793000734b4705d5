"""Personal data by anchor expansion.

One automaton finds the anchors: at-signs, plus signs, digits, schemes and cues of identifiers and secrets. At
each anchor a deterministic local parser expands to the boundaries and validates what it found.
The base kinds (email, ip, card, phone) equal a leftmost non-overlapping search per kind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of their listing at equal starts.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "street", "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive quantifiers: none of these could match otherwise by giving characters back.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HOST = re.compile(r"(?:[^\s/?#@<>\"']*+@)?([A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+)(?::[0-9]{1,5})?(?:[/?#][^\s<>\"']*)?")
NUMBER = re.compile(r"(?:[ \t]*(?:number|no\.?|nr\.?|#|:|=|is))*[ \t]*([A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}|[0-9](?:[ -]?[0-9]){5,16})(?![A-Za-z0-9])")
CAPITALISED = re.compile(r"[A-Z][a-z]+")
HOUSE = re.compile(r"[0-9]{1,6}")
#: What follows the name of a secret, and secrets that name themselves.
ASSIGNED = re.compile(r"[\"']?[ \t]*(?::=|=>|[:=]|is\b)[ \t]*[\"']?([^\s\"',;<>()\[\]{}]{8,})")
CARRIED = re.compile(r"[ \t]+([A-Za-z0-9+/_.~=-]{16,})")
PREFIXED = {"AKIA": r"[A-Z0-9]{16}(?![A-Za-z0-9])", "ghp_": r"[A-Za-z0-9]{36}", "github_pat_": r"[A-Za-z0-9_]{22,}", "sk-": r"[A-Za-z0-9_-]{20,}", "xoxb-": r"[A-Za-z0-9-]{10,}", "xoxp-": r"[A-Za-z0-9-]{10,}", "eyJ": r"[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"}
BY_PREFIX = {k: re.compile(v) for k, v in PREFIXED.items()}
#: Cues and the parser that each begins: fixed values.
CUES = {
    "http://": "url", "https://": "url", "ftp://": "url",
    "iban": "account", "account": "account", "acct": "account", "kontonummer": "account", "sort code": "account",
    "token": "assigned", "password": "assigned", "passwd": "assigned", "pwd": "assigned", "secret": "assigned", "api key": "assigned", "api_key": "assigned", "api-key": "assigned", "apikey": "assigned",
    "access key": "assigned", "access_key": "assigned", "private key": "assigned", "private_key": "assigned", "bearer": "carried",
    " street": "street", " st.": "street", " road": "street", " avenue": "street", " ave.": "street", " lane": "street", " drive": "street", " boulevard": "street",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    """The check of international account numbers: remainder 1 by 97."""
    x = text.replace(" ", "")
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


_found: list[ahocorasick.Automaton] = []


def automaton() -> ahocorasick.Automaton:
    if not _found:
        a = ahocorasick.Automaton()
        for c in "0123456789":
            a.add_word(c, ("digit", 1))
        a.add_word("@", ("at", 1))
        a.add_word("+", ("plus", 1))
        for cue, kind in CUES.items():
            for form in {cue, cue.upper(), cue.title(), cue.capitalize()}:
                a.add_word(form, (kind, len(form)))
        for prefix in PREFIXED:
            a.add_word(prefix, (prefix, len(prefix)))
        a.make_automaton()
        _found.append(a)
    return _found[0]


def house(text: str, at: int, over: int) -> int:
    """Where the number begins that stands before one to four capitalised words, the last of which ends at the blank at; -1 if there is none behind over."""
    for _ in range(4):
        begin = text.rfind(" ", over, at) + 1
        if not begin or not CAPITALISED.fullmatch(text, begin, at):
            return -1
        at = begin - 1  # the blank before the word
        first = at
        while first > over and at - first < 7 and text[first - 1] in "0123456789":
            first -= 1
        if first < at:
            return first if HOUSE.fullmatch(text, first, at) and (first == 0 or not text[first - 1].isalnum()) else -1
    return -1


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all personal data in text, by start and then kind as in KINDS."""
    out: list[tuple[int, int, str]] = []
    over = dict.fromkeys(KINDS, 0)  # where the last match of a kind ended, kept or not
    digit = -2  # the last digit seen
    for last, (anchor, size) in automaton().iter(text):
        at = last - size + 1
        if anchor == "digit":
            inside, digit = digit == at - 1, at
            if at >= over["card"]:
                m = CARD.match(text, at)
                if m:
                    over["card"] = m.end()
                    number = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(number) <= 19 and luhn(number):
                        out.append((at, m.end(), "card"))
            # within a run of digits an attempt fails if the one at its start did; after a match the rest of a run is a start
            if at >= over["ip"] and (not inside or at == over["ip"]):
                m = IP.match(text, at)
                if m:
                    over["ip"] = m.end()
                    if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                        out.append((at, m.end(), "ip"))
        elif anchor == "plus":
            m = PHONE.match(text, at) if at >= over["phone"] else None
            if m:
                over["phone"] = m.end()
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((at, m.end(), "phone"))
        elif anchor == "at":
            start = at
            while start > over["email"] and text[start - 1] in LOCAL:
                start -= 1
            m = DOMAIN.match(text, at + 1) if start < at else None
            if m:
                over["email"] = m.end()
                out.append((start, m.end(), "email"))
        elif anchor == "url":
            m = HOST.match(text, last + 1) if at >= over["url"] else None
            if m:
                end = m.end()
                while text[end - 1] in ".,;:!?)":
                    end -= 1
                over["url"] = end
                out.append((at, end, "url"))
        elif anchor == "account":
            m = NUMBER.match(text, last + 1) if at >= over["account"] and (at == 0 or not text[at - 1].isalnum()) else None
            if m and (m[1][0].isdigit() or iban(m[1])):
                over["account"] = m.end(1)
                out.append((m.start(1), m.end(1), "account"))
        elif anchor in ("assigned", "carried"):
            m = (ASSIGNED if anchor == "assigned" else CARRIED).match(text, last + 1) if at >= over["secret"] else None
            # without a digit a word of prose stands there, but for marks or capitals inside it
            if m and (any(c.isdigit() for c in m[1]) or len(m[1]) >= 8 and (any(not c.isalnum() for c in m[1]) or any(c.isupper() for c in m[1][1:]) and not m[1].isupper())):
                over["secret"] = m.end(1)
                out.append((m.start(1), m.end(1), "secret"))
        elif anchor in BY_PREFIX:
            m = BY_PREFIX[anchor].match(text, last + 1) if at >= over["secret"] and (at == 0 or not text[at - 1].isalnum()) else None
            if m:
                over["secret"] = m.end()
                out.append((at, m.end(), "secret"))
        else:
            ends = text[last + 1 : last + 2]
            begin = house(text, at, over["street"]) if not ends.isalnum() else -1
            if begin >= 0:
                over["street"] = last + 1
                out.append((begin, last + 1, "street"))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def pii_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_secret, n_spans, base_sha256, spans, found for every row.

    spans joins kind:start:end of all spans by commas (code points, end exclusive), found has them
    as an array with the matched text, base_sha256 digests those of the base kinds.
    Nulls: a null text is empty and has no spans. Repeated rows have equal spans; further columns
    are not read. Very long texts cost time in proportion to their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("match", pa.string())]))
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in BASE}
            digests, listed, found, secrets = [], [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                spans = spans_of(text)
                for k in BASE:
                    counts[k].append(sum(s[2] == k for s in spans))
                joined = lambda kinds, spans=spans: ",".join(f"{k}:{s}:{e}" for s, e, k in spans if k in kinds)
                secrets.append(sum(s[2] == "secret" for s in spans))
                digests.append(hashlib.sha256(joined(BASE).encode()).hexdigest())
                listed.append(joined(KINDS))
                found.append([{"kind": k, "start": s, "end": e, "match": text[s:e]} for s, e, k in spans])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(secrets, pa.int64()), pa.array(map(len, found), pa.int64()), pa.array(digests, pa.string()), pa.array(listed, pa.string()), pa.array(found, span)],
                names=["doc_id", *(f"n_{k}" for k in BASE), "n_secret", "n_spans", "base_sha256", "spans", "found"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in BASE)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, {counts}, n_secret long, n_spans long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long,match:string>>")
