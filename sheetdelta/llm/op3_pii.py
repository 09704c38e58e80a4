"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, digits, plus signs before a digit, schemes and account cues.
Deterministic local parsers expand each anchor to the left and right and validate what they find, so no other part of the
text is looked at again.  Kinds: email, ip, card, phone (the base), and url (a scheme whose address carries a user name)
and account (an international account number after its cue, mod-97 checked), which this operator adds.

Defined results: a null text counts as empty; a row per row, repeated rows and null ``doc_id`` included; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table

#: The kinds in the order of the contract, then those that this operator adds.
KINDS = ["email", "ip", "card", "phone", "url", "account"]
BASE = 4
_DIGITS = "0123456789"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ADDRESS = r"[A-Za-z0-9._~%!$&'*+,;=-]+(?::[^\x20\x09-\x0D/@]*)?@[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\x20\x09-\x0D\"'<>]*)?"
_AUTHORITY = re.compile(_ADDRESS)
_ACCOUNT = r"[\x20:#=]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})"
_IBAN = re.compile(_ACCOUNT + "(?![A-Za-z0-9])")
_CUES = ["IBAN", "iban", "Iban"]
_SCHEMES = ["http://", "https://", "ftp://", "ssh://", "sftp://"]
_AT, _DIGIT, _PLUS, _SCHEME, _CUE = range(5)


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", (_AT, 1))
    for d in _DIGITS:
        a.add_word(d, (_DIGIT, 1))
        a.add_word("+" + d, (_PLUS, 2))
    for s in _SCHEMES:
        a.add_word(s, (_SCHEME, len(s)))
    for c in _CUES:
        a.add_word(c, (_CUE, len(c)))
    a.make_automaton()
    return a


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _mod97(account: str) -> bool:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def find(text: str, automaton) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every span, in order."""
    out = []
    email_end = number_end = ip_end = phone_end = url_end = account_end = 0
    for last, (kind, width) in automaton.iter(text):
        at = last - width + 1
        if kind == _DIGIT:
            # The first digit of a chain that no earlier match took starts it; a match covers all its later digits.
            if at >= number_end:
                m = _CARD.match(text, at)
                if m:
                    number_end = m.end()
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and _luhn(digits):
                        out.append((at, 2, number_end))
            if at >= ip_end and (at == ip_end or at == 0 or text[at - 1] not in _DIGITS):
                m = _IP.match(text, at)
                if m:
                    ip_end = m.end()
                    # A number of more than three digits without its leading zeros is over 255.
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                        out.append((at, 1, ip_end))
        elif kind == _AT:
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                m = _DOMAIN.match(text, at + 1)
                if m:
                    email_end = m.end()
                    out.append((start, 0, email_end))
        elif kind == _PLUS:
            if at >= phone_end:
                m = _PHONE.match(text, at)
                if m:
                    phone_end = m.end()
                    if 9 <= sum(c in _DIGITS for c in m.group()) <= 15:
                        out.append((at, 3, phone_end))
        elif kind == _SCHEME:
            # A scheme starts a word, so "sftp:" is not "ftp:" too, and one within an address is a part of it.
            m = at >= url_end and (at == 0 or text[at - 1] not in _WORD) and _AUTHORITY.match(text, last + 1)
            if m:
                url_end = m.end()
                out.append((at, 4, url_end))
        elif at >= account_end:
            m = _IBAN.match(text, last + 1)
            account_end = m.end() if m else account_end
            if m and 15 <= len(n := m.group(1).replace(" ", "")) <= 34 and _mod97(n):
                out.append((m.start(1), 5, m.end(1)))
    out.sort()
    return out


def _detect(batches):
    automaton = _automaton()
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            found = find(text.as_py() or "", automaton)
            parts = [(k, f"{KINDS[k]}:{s}:{e}") for s, k, e in found]
            base = ",".join(p for k, p in parts if k < BASE)
            rows.append(([sum(k == i for k, _ in parts) for i in range(BASE)], hashlib.sha256(base.encode()).hexdigest(), ",".join(p for _, p in parts)))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                *[pa.array([r[0][i] for r in rows], pa.int64()) for i in range(BASE)],
                pa.array([r[1] for r in rows], pa.string()),
                pa.array([r[2] for r in rows], pa.string()),
            ],
            ["doc_id", *[f"n_{k}" for k in KINDS[:BASE]], "base_sha256", "spans"],
        )


def personal_data(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    prepare(docs.sparkSession)
    counts = ", ".join(f"n_{k} long" for k in KINDS[:BASE])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_detect, f"doc_id long, {counts}, base_sha256 string, spans string")


def op3_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _hits(ordinal: int, pattern: str) -> str:
    """SQL: (rid, o, p) with the start and text of every match of ``pattern``."""
    quoted = pattern.replace("'", "''")
    return f"""
    SELECT rid, {ordinal} AS o, unnest(list_transform(range(1, len(hits) + 1), lambda k: struct_pack(
      s := list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:k-1], lambda h: length(h))), 0), h := hits[k]))) AS p
    FROM (SELECT rid, string_split_regex(t, '{quoted}') AS gaps, regexp_extract_all(t, '{quoted}') AS hits FROM d WHERE regexp_matches(t, '{quoted}'))"""


#: Patterns of whole matches; what stands before a scheme, a cue and the sign behind an account are cut off again.
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({" UNION ALL ".join([
    _hits(0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+"),
    _hits(1, r"[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+"),
    _hits(2, r"[0-9](?:[\x20-]?[0-9])+"),
    _hits(3, r"\+[0-9][\x20().0-9-]+[0-9]"),
    _hits(4, r"(?:^|[^A-Za-z0-9])(?:https?|s?ftp|ssh)://" + _ADDRESS),
    _hits(5, r"(?:IBAN|iban|Iban)" + _ACCOUNT + r"(?:[^A-Za-z0-9]|$)"),
])}),
flat AS (SELECT rid, o, CAST(p.s AS BIGINT) AS s0, p.h AS h0, CASE o WHEN 4 THEN length(regexp_extract(p.h, '^[^A-Za-z0-9]?')) WHEN 5 THEN length(regexp_extract(p.h, '^(IBAN|iban|Iban)[ :#=]*')) ELSE 0 END AS skip FROM raw),
cut AS (SELECT rid, o, s0 + skip AS s, CASE o WHEN 5 THEN regexp_replace(h0[skip + 1:], '[^A-Za-z0-9]$', '') ELSE h0[skip + 1:] END AS h FROM flat),
num AS (SELECT *, regexp_replace(h, '[^0-9]', '', 'g') AS digits, replace(h, ' ', '') AS account FROM cut),
hit AS (SELECT rid, o, s, s + length(h) AS e FROM num WHERE CASE o
  WHEN 1 THEN list_max(list_transform(string_split(h, '.'), lambda x: CASE WHEN length(ltrim(x, '0')) > 3 THEN 999 ELSE CAST('0' || ltrim(x, '0') AS INTEGER) END)) <= 255
  WHEN 2 THEN length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i:
    (CAST(reverse(digits)[i] AS INTEGER) * (1 + (i - 1) % 2)) - CASE WHEN CAST(reverse(digits)[i] AS INTEGER) * (1 + (i - 1) % 2) > 9 THEN 9 ELSE 0 END)) % 10 = 0
  WHEN 3 THEN length(digits) BETWEEN 9 AND 15
  WHEN 5 THEN length(account) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split(account[5:] || account[1:4], ''), lambda c:
    CASE WHEN c <= '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda r, x: (r * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1
  ELSE true END),
named AS (SELECT rid, o, s, (['email','ip','card','phone','url','account'])[o + 1] || ':' || s || ':' || e AS span FROM hit),
txt AS (
  SELECT rid, count(*) FILTER (WHERE o = 0) AS n_email, count(*) FILTER (WHERE o = 1) AS n_ip, count(*) FILTER (WHERE o = 2) AS n_card, count(*) FILTER (WHERE o = 3) AS n_phone,
    string_agg(span, ',' ORDER BY s, o) FILTER (WHERE o < 4) AS base, string_agg(span, ',' ORDER BY s, o) AS spans
  FROM named GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN txt USING (rid)
"""
