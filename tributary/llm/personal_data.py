"""Personal data in texts: anchors found by an Aho-Corasick automaton, expanded and checked by local parsers.

One pass of the automaton over a text gives every anchor: at-signs, plus signs, digits, schemes
and the cues of identifiers (upper and lower case alike). A kind's parser starts at its anchor,
or looks back from it, takes the characters that belong to the value, checks them (parts of an
address, sums of digits), and says how far the text is read; anchors of the same kind before
that place are passed over. So each kind is found from left to right without overlaps, a value
that fails its check is not tried again at a shorter length, and every character is read a few
times at most, whatever a text holds.

Kinds with patterns of their own: email, ip, card, phone. The method adds account names in web
addresses (url), keys and secrets of accounts (key, secret), bank accounts (iban, account) and
social security numbers (ssn), all after a cue only. Places are code points, the end exclusive.

Defined results: a null or empty text has no spans; repeated rows and null ids keep a row each;
an empty table gives an empty one; find() and masked() keep other columns as they are.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.store import documents, tidied

SPAN = "struct<kind:string,first:int,last:int>"
BASE = ("email", "ip", "card", "phone")

#: kinds that a cue announces: cue, what stands between (part of the match), the value
CUED = (
    ("url", ("http://", "https://", "ftp://"), "", r"(?:https?|ftp)://[A-Za-z0-9._~%!$&'()*+,;=:-]+@[A-Za-z0-9.-]+"),
    ("key", ("akia", "asia"), "", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("secret", ("password", "passwd", "secret", "token", "api_key"), r"(?:password|passwd|secret|token|api_key) ?[=:] ?[\"']?", r"[A-Za-z0-9+/_-]{12,}"),
    ("iban", ("iban",), r"\biban[: ]{1,2}", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("account", ("account", "acct"), r"\b(?:account|acct)(?: number| no\.?)?[:# ]{1,3}", r"[0-9]{6,17}\b"),
    ("ssn", ("ssn", "social security number"), r"\b(?:ssn|social security number)[:# ]{1,3}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
)
KINDS = BASE + tuple(kind for kind, *_ in CUED)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])*")
_DIALLED = re.compile(r"\+[0-9][ ().0-9-]+")


def luhn(digits: str) -> bool:
    total = 0
    for at, c in enumerate(reversed(digits)):
        d = int(c) << (at & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    if not 15 <= len(plain) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _octet(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part) <= 255


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


# Parsers: (text, anchor's start, how far the kind is read) -> (spans, how far it is read now)


def _email(text: str, at: int, read: int):
    first = at
    while first > read and text[first - 1] in _LOCAL:
        first -= 1
    domain = _DOMAIN.match(text, at + 1) if first < at else None
    return ([(first, domain.end())], domain.end()) if domain else ([], at + 1)


def _ip(text: str, at: int, _read: int):
    chain = _NUMBERS.match(text, at)
    parts, spans, first = chain[0].split("."), [], at
    for i in range(0, len(parts) - 3, 4):
        four = parts[i : i + 4]
        last = first + sum(map(len, four)) + 3
        if all(map(_octet, four)):
            spans.append((first, last))
        first = last + 1
    return spans, chain.end()


def _card(text: str, at: int, _read: int):
    chain = _DIGITS.match(text, at)
    digits = _only_digits(chain[0])
    return [chain.span()] if 13 <= len(digits) <= 19 and luhn(digits) else [], chain.end()


def _phone(text: str, at: int, _read: int):
    run = _DIALLED.match(text, at)
    if run is None:
        return [], at + 1
    last = run.end()
    while not "0" <= text[last - 1] <= "9":
        last -= 1
    if last < at + 4:
        return [], at + 1
    return [(at, last)] if 9 <= len(_only_digits(text[at:last])) <= 15 else [], last


def _has_digit(value: str) -> bool:
    return any("0" <= c <= "9" for c in value)


def _real_ssn(value: str) -> bool:
    return value[:3] not in ("000", "666") and value[0] != "9" and value[4:6] != "00" and value[7:] != "0000"


CHECKS = {"secret": _has_digit, "iban": mod97, "ssn": _real_ssn}


def _cued(kind: str, lead: str, value: str):
    form = re.compile(f"(?i:{lead})({value})", re.ASCII)
    check = CHECKS.get(kind, lambda _: True)

    def parse(text: str, at: int, _read: int):
        found = form.match(text, at)
        if found is None:
            return [], at + 1
        return [found.span(1)] if check(found[1]) else [], found.end()

    return parse


PARSERS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone} | {kind: _cued(kind, lead, value) for kind, _, lead, value in CUED}


def _automaton():
    import ahocorasick

    anchors: dict[str, list[int]] = {"@": [0], "+": [3]} | {c: [1, 2] for c in "0123456789"}
    for kind, cues, *_ in CUED:
        for cue in cues:
            anchors.setdefault(cue, []).append(KINDS.index(kind))
    machine = ahocorasick.Automaton()
    for word, kinds in anchors.items():
        machine.add_word(word, (len(word) - 1, kinds))
    machine.make_automaton()
    return machine


def spans(text: str, machine) -> list[tuple[str, int, int]]:
    """(kind, start, end) of everything found, by kind as listed, then by start."""
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only, so places stay
    read, found = [0] * len(KINDS), [[] for _ in KINDS]
    parsers = list(PARSERS.values())
    for end, (back, kinds) in machine.iter(low):
        at = end - back
        for k in kinds:
            if at >= read[k]:
                new, read[k] = parsers[k](text, at, read[k])
                found[k] += new
    return [(kind, *span) for kind, of in zip(KINDS, found, strict=True) for span in of]


def find(docs: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """docs with a column of the spans found in each whole text."""
    schema = docs.drop(name).schema.simpleString()[len("struct<") : -1]
    return _mapped(docs.drop(name), text, f"{schema},{name}:array<{SPAN}>", lambda batch, of: batch.assign(**{name: [[dict(zip(("kind", "first", "last"), s, strict=True)) for s in each] for each in of]}))


def _mapped(docs: DataFrame, text: str, schema: str, result) -> DataFrame:
    def work(batches):
        machine = _automaton()
        for batch in batches:
            yield result(batch, [spans(t, machine) if t else [] for t in batch[text]])

    return docs.mapInPandas(tidied(work), schema)


def mask(text: str, of: list[tuple[str, int, int]]) -> str:
    """text with every span as [KIND]; of overlapping ones the longest, then the first of the kinds."""
    taken: list[tuple[int, int, str]] = []
    for kind, first, last in sorted(of, key=lambda s: (s[1] - s[2], KINDS.index(s[0]), s[1])):
        at = bisect_left(taken, (first,))
        if (at == 0 or taken[at - 1][1] <= first) and (at == len(taken) or last <= taken[at][0]):
            taken.insert(at, (first, last, kind))
    out, read = [], 0
    for first, last, kind in taken:
        out += [text[read:first], f"[{kind.upper()}]"]
        read = last
    return "".join(out) + text[read:]


def masked(docs: DataFrame) -> DataFrame:
    """docs with personal data in the text replaced by its kind, and n_chars as it is then."""
    plain = docs.select(*docs.columns)

    def result(batch, of):
        batch["text"] = [mask(t, s) if s else t for t, s in zip(batch["text"], of, strict=True)]
        return batch

    out = _mapped(plain, "text", ",".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields), result)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


DIGEST = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def report(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans of every row of docs (doc_id, text)."""

    def result(batch, of):
        import pandas as pd

        rows = []
        for doc_id, each in zip(batch["doc_id"], of, strict=True):
            n = [sum(kind == k for kind, *_ in each) for k in BASE]
            words = [f"{kind}:{first}:{last}" for kind, first, last in each]
            rows.append((doc_id, *n, hashlib.sha256(",".join(words[: sum(n)]).encode()).hexdigest(), ",".join(words), len(each) - sum(n)))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in DIGEST.split(", ")])
        return out.assign(doc_id=out["doc_id"].astype("Int64"))

    return _mapped(docs.select("doc_id", "text"), "text", DIGEST, result)


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir))


def _oracle() -> str:
    digits = r"regexp_replace(v, '[^0-9]', '', 'g')"
    luhn_sum = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digits}[-i]::INT ELSE ({digits}[-i]::INT * 2) % 10 + ({digits}[-i]::INT * 2) // 10 END))"
    plain = "replace(v, ' ', '')"
    rest = f"list_reduce(list_concat([0], list_transform(string_split({plain}[5:] || {plain}[:4], ''), lambda c: ascii(c)::BIGINT)), lambda x, c: CASE WHEN c < 58 THEN (x * 10 + c - 48) % 97 ELSE (x * 100 + c - 55) % 97 END)"
    checks = {
        "ip": "list_max(list_transform(string_split(v, '.'), lambda p: coalesce(try_cast(p AS HUGEINT), 256))) <= 255",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND {luhn_sum} % 10 = 0",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "secret": "regexp_matches(v, '[0-9]')",
        "iban": f"length({plain}) BETWEEN 15 AND 34 AND {rest} = 1",
        "ssn": "v[1:3] NOT IN ('000', '666') AND v[1:1] <> '9' AND v[5:6] <> '00' AND v[8:] <> '0000'",
    }
    forms = [
        ("email", "", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
        ("ip", "", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
        ("card", "", r"[0-9](?:[\x20-]?[0-9])+"),
        ("phone", "", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ] + [(kind, f"(?i:{lead})" if lead else "", value) for kind, _, lead, value in CUED]
    parts = []
    for at, (kind, lead, value) in enumerate(forms):
        form, lead = (lead + value).replace("'", "''"), lead.replace("'", "''")
        v = f"regexp_replace(found[i], '^{lead}', '')" if lead else "found[i]"
        parts.append(rf"""SELECT doc_id, row, {at} AS place, '{kind}' AS kind, last - length(v) AS first, last FROM (
            SELECT doc_id, row, {v} AS v, list_sum(list_transform(pieces[:i], lambda x: length(x))) + list_sum(list_transform(found[:i], lambda x: length(x))) AS last
            FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (SELECT doc_id, row, regexp_extract_all(text, '{form}') AS found, string_split_regex(text, '{form}') AS pieces FROM d)))
            WHERE {checks.get(kind, "true")}""")
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)
    word = "kind || ':' || first || ':' || last"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
    s AS ({" UNION ALL ".join(parts)}),
    g AS (SELECT row, {counts}, string_agg({word}, ',' ORDER BY place, first) FILTER (WHERE place < 4) AS base, string_agg({word}, ',' ORDER BY place, first) AS spans, count(*) FILTER (WHERE place >= 4) AS n_added FROM s GROUP BY row)
    SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_added, 0)::BIGINT AS n_added
    FROM d LEFT JOIN g USING (row)"""


QUERIES = {"op13_personal_data": op13_personal_data}
ORACLE = {"op13_personal_data": _oracle()}
