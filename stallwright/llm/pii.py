"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, digits, plus signs,
schemes, identifier cues (in any case) and the first letters of well-known forms of
keys. Local parsers expand each anchor to the left and right,
validate what they find and give exact boundaries; text without an anchor costs the
one pass and nothing else.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

BASE_KINDS = ("email", "ip", "card", "phone")
#: What the method adds: logins in web addresses, account numbers after a cue, IBANs, and
#: secrets (keys, tokens, passwords) after a cue, in armour or of a well-known form.
ADDED_KINDS = ("login", "account", "iban", "secret")
#: Words that announce an account or identity number (fixed values).
CUES = ("account", "acct", "iban", "konto", "kontonummer", "compte", "cuenta", "passport", "ssn", "customer id", "kundennummer", "n° client")
#: Words that announce a secret (fixed values).
SECRET_CUES = ("token", "secret", "password", "passwd", "passphrase", "pwd", "api key", "api_key", "apikey", "access key", "access_key", "private key", "private_key", "bearer", "passwort", "contraseña", "mot de passe")
#: Well-known forms of keys and tokens: first letters and the whole (fixed values).
KEY_FORMS = {
    "AKIA": "AKIA[0-9A-Z]{16}",
    "ASIA": "ASIA[0-9A-Z]{16}",
    "AIza": "AIza[0-9A-Za-z_-]{35}",
    "ghp_": "ghp_[0-9A-Za-z]{36,}",
    "gho_": "gho_[0-9A-Za-z]{36,}",
    "ghs_": "ghs_[0-9A-Za-z]{36,}",
    "github_pat_": "github_pat_[0-9A-Za-z_]{22,}",
    "glpat-": "glpat-[0-9A-Za-z_-]{20,}",
    "sk-": "sk-[0-9A-Za-z_-]{20,}",
    "sk_live_": "sk_live_[0-9A-Za-z]{16,}",
    "sk_test_": "sk_test_[0-9A-Za-z]{16,}",
    "xox": "xox[abprs]-[0-9A-Za-z-]{10,}",
    "hf_": "hf_[0-9A-Za-z]{30,}",
    "eyJ": r"eyJ[0-9A-Za-z_-]{6,}\.[0-9A-Za-z_-]{6,}(?:\.[0-9A-Za-z_-]+)?",
}
_FORMS = {start: re.compile(f"(?:{form})(?![0-9A-Za-z_-])") for start, form in KEY_FORMS.items()}
COLUMNS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_RUNS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"[^\s/@:<>\"']+:[^\s/@<>\"']+@[A-Za-z0-9.-]+")
_ACCOUNT = re.compile(r"(?:\s?(?:no|number|nr|num|id)\.?)?\s?[:#=]?\s?((?=[A-Z0-9-]*[0-9]{4})[A-Z0-9](?:[A-Z0-9-]{4,32})[A-Z0-9])(?![A-Za-z0-9])", re.IGNORECASE)
#: A value follows a cue after a sign or "is", maybe in quotes; "Bearer" needs neither.
_SECRET = re.compile(r"""(?:["'`]?\s{0,2}(?::=|=>|[:=]|is\s)\s{0,2}|(?<=[Bb]earer)\s)(["'`]?)([^\s"'`<>,;()]{6,512})(?(1)\1)""")
_ARMOUR = re.compile(r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----[A-Za-z0-9+/=\s:,-]*?-----END \1PRIVATE KEY-----")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: In lower case an IBAN is mostly digits, or words after two letters would do.
_SMALL_IBAN = re.compile(r"[a-z]{2}[0-9]{2}(?: ?[a-z0-9]){11,30}(?![A-Za-z0-9])")
_SMALL_DIGITS = 12
#: Capitals inside a word, as in no word of a language.
_MIXED = re.compile("[a-z][A-Z]|[A-Z]{2}[a-z]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def iban_ok(text: str) -> bool:
    code = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def secret_span(text: str, at: int) -> tuple[int, int] | None:
    """Boundaries of the secret that a cue ending at a position announces. It mixes
    digits with letters, or is quoted and has a digit or a mark inside, or follows an
    equals sign at once and has capitals inside."""
    if not (m := _SECRET.match(text, at)):
        return None
    start, end = m.span(2)
    if not m[1]:
        end = start + len(text[start:end].rstrip(".:!?]}"))
    value = text[start:end]
    digit, letter = any(map(str.isdigit, value)), any(map(str.isalpha, value))
    tight = text[at:start].lstrip() in ("=", ":=") and _MIXED.search(value)
    if len(value) < 6 or not (digit and letter or m[1] and not value.isalpha() or tight):
        return None
    return start, end


def iban_end(text: str, at: int) -> int:
    """End of the IBAN at a position, 0 if there is none; capital words that follow are left off."""
    m = _IBAN.match(text, at) or _SMALL_IBAN.match(text, at)
    end, small = m.end() if m else 0, text[at : at + 1].islower()
    while end and len(text[at:end].replace(" ", "")) >= 15:
        if iban_ok(text[at:end]) and (not small or sum(map(str.isdigit, text[at:end])) >= _SMALL_DIGITS):
            return end
        end = max(0, text.rfind(" ", at, end))
    return 0


def _lowered(text: str) -> str:
    """A-Z in lower case; every place stays."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


@cache
def anchors():
    import ahocorasick

    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    # The text is searched with A-Z lowered; other capitals need a form of their own.
    for cues, kind in ((CUES, "cue"), (SECRET_CUES, "key")):
        for cue in cues:
            for form in {_lowered(cue), _lowered(cue.upper())}:
                a.add_word(form, (kind, len(form)))
    for start in KEY_FORMS:
        a.add_word(start.lower(), ("form:" + start, len(start)))
    a.add_word("-----begin ", ("armour", 11))
    a.make_automaton()
    return a


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, base kinds first, each kind by start.

    The base kinds are found as a leftmost, non-overlapping search for each would
    find them; a match that fails its check is dropped and not tried again."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE_KINDS, *ADDED_KINDS)}
    email_end = ip_end = chain_end = phone_end = account_end = bank_end = secret_end = 0
    for last, (kind, size) in anchors().iter(_lowered(text)):
        i = last - size + 1
        if kind == "digit":
            if i >= ip_end:  # digit runs joined by single dots: each four are a match
                m = _RUNS.match(text, i)
                ip_end, at = m.end(), i
                if "." in m[0]:
                    parts = m[0].split(".")
                    for k in range(0, len(parts) - 3, 4):
                        four = parts[k : k + 4]
                        end = at + sum(map(len, four)) + 3
                        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                            found["ip"].append((at, end))
                        at = end + 1
            if i >= chain_end:  # digits with at most one space or hyphen between two
                m = _CHAIN.match(text, i)
                chain_end = m.end()
                if chain_end - i >= 16:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append((i, chain_end))
            # An IBAN needs no cue: two letters of one case at a word's start, then digits.
            if i - 2 >= bank_end and text[i - 2 : i].isalpha() and (text[i - 2 : i].isupper() or text[i - 2 : i].islower()) and not (i > 2 and text[i - 3].isalnum()) and (end := iban_end(text, i - 2)):
                bank_end = end
                found["iban"].append((i - 2, end))
        elif kind == "at":
            start = i
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < i and (m := _DOMAIN.match(text, i + 1)):
                email_end = m.end()
                found["email"].append((start, email_end))
        elif kind == "plus":
            if i >= phone_end and (m := _PHONE.match(text, i + 1)):
                phone_end = m.end()
                if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                    found["phone"].append((i, phone_end))
        elif kind == "scheme":
            if m := _LOGIN.match(text, last + 1):
                found["login"].append(m.span())
        elif kind == "armour":
            if i >= secret_end and (m := _ARMOUR.match(text, i)):
                secret_end = m.end()
                found["secret"].append(m.span())
        elif kind.startswith("form:"):
            if i >= secret_end and not (i and (text[i - 1].isalnum() or text[i - 1] == "_")) and (m := _FORMS[kind[5:]].match(text, i)):
                secret_end = m.end()
                found["secret"].append(m.span())
        elif kind == "key":
            if i >= secret_end and not (i and text[i - 1].isalnum()) and (span := secret_span(text, last + 1)):
                secret_end = span[1]
                found["secret"].append(span)
        elif i >= account_end and not (i and text[i - 1].isalnum()):
            for at in range(last + 1, min(last + 4, len(text))):
                if at >= bank_end and (end := iban_end(text, at)):
                    account_end, bank_end = max(account_end, end), end
                    found["iban"].append((at, end))
                    break
            else:
                if m := _ACCOUNT.match(text, last + 1):
                    account_end = m.end()
                    if not iban_end(text, m.start(1)):
                        found["account"].append(m.span(1))
    return [(kind, *span) for kind, spans in found.items() for span in spans]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> per row the counts of base spans, the number of
    added ones, the hash of the base spans and all spans.

    A null or empty text has no spans; repeated rows come back as often as they are in
    docs; an empty table gives an empty result; other columns are ignored. Whole texts
    are searched, in one pass each."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = []
            for text in b.column(1):
                spans = find_spans(text.as_py() or "")
                base = [x for x in spans if x[0] in BASE_KINDS]
                counts = [sum(x[0] == k for x in base) for k in BASE_KINDS]
                rows.append((*counts, len(spans) - len(base), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))], [c.split()[0] for c in COLUMNS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, COLUMNS)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; overlapping spans
    of several kinds become one, named by the first. A null text stays null; other
    columns and repeated rows stay as they are; an empty table gives an empty result."""
    names, text = docs.columns, docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def clean(t: str) -> str:
            out, end = [], 0
            for kind, a, b in sorted(find_spans(t), key=lambda x: (x[1], -x[2])):
                if a >= end:
                    out += [t[end:a], f"<{kind}>"]
                end = max(end, b)
            return "".join(out) + t[end:]

        for b in batches:
            new = pa.array([None if x is None else clean(x) for x in b.column(text).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == text else b.column(i) for i in range(len(names))], names)

    return docs.mapInArrow(run, docs.schema)


def op8_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


QUERIES = {"op8_pii_anchors": op8_pii_anchors}
SQL: dict[str, str] = {}
