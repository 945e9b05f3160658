"""Personal data (6): anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, digits, plus signs before digits, schemes ("://") and
cues of identifiers. From each anchor a local parser without search or backtracking walks to the ends of the
value and validates it, so the time is linear in the text, however long its runs of digits or letters are.

Base kinds: email, ip, card (12 to 19 digits, Luhn), phone (9 to 15 digits). Kinds the method adds: url (an address
with user information, a personal path or personal parameters), account (IBAN with its check digits; a
number behind a cue for accounts, passports and the like; access key ids) and secret (the value behind
a cue for passwords and tokens).

Positions are code points, end exclusive. Cases: null text is empty and has no span; repeated rows and rows without
id are each treated on their own; an empty table gives an empty result; spans of different kinds may overlap, and
`mask` replaces what overlaps once, by the kind that begins first (of equals, the one listed first).
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm import flat

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret")

# The cues, each in lower case; they also count with a capital first letter or in capitals.
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "kontonummer", "compte", "cuenta", "ssn", "social security",
                "passport", "pasaporte", "passeport", "reisepass", "tax id", "steuernummer", "customer id")
SECRET_CUES = ("password", "passwd", "pwd", "token", "api_key", "apikey", "api key", "secret", "secret_key")
KEY_CUES = ("AKIA", "ASIA")
PERSONAL_PATHS = ("/~", "/@", "/user/", "/users/", "/profile/", "/profiles/", "/in/", "/u/", "/people/")
PERSONAL_PARAMETERS = ("email=", "phone=", "token=", "password=", "user=", "ssn=")

EMAIL_RUN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP_RUN = re.compile(r"[0-9.]+")
CARD_RUN = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
PHONE_RUN = re.compile(r"[\x20().0-9-]*")
URL_RUN = re.compile(r"[^\s\"'<>`{}|\\^]+")
HOST = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?(?::[0-9]{1,5})?(?=[/?#]|$)")
JOINT = re.compile(r"(?:[\x20\t]*(?:no\.?|nr\.?|number|num\.?|id|is|n°|[:#=]))*[\x20\t]*", re.I)
NUMBER = re.compile(r"[A-Za-z]{0,4}[0-9](?:[\x20./-]?[0-9A-Z])*")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9])+")
VALUE = re.compile(r"[\x20\t]*[=:][\x20\t]*[\"']?([^\s\"',;]{8,})")
KEY_ID = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")


def anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    for mark, kind in [("@", "email"), ("://", "url"), *((f"+{d}", "phone") for d in range(10)),
                       *((str(d), "digit") for d in range(10)), *((k, "key") for k in KEY_CUES)]:
        found.add_word(mark, (kind, len(mark)))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.upper()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def valid_iban(value: str) -> bool:
    turned = value[4:] + value[:4]
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


class Finder:
    """Spans (kind, start, end) of one text after the other."""

    def __init__(self):
        self.anchors = anchors()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        self.text, self.found = text, []
        self.done = dict.fromkeys((*KINDS, "run"), 0)
        self.at_sign = -1
        for last, (kind, size) in self.anchors.iter(text):
            getattr(self, f"_{kind}")(last - size + 1, last + 1)
        return sorted(set(self.found), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))

    def _add(self, kind: str, start: int, end: int):
        self.found.append((kind, start, end))
        self.done[kind] = end

    def _email(self, at: int, after: int):
        text, floor = self.text, max(self.at_sign + 1, self.done["email"])
        self.at_sign = at
        if at < self.done["email"]:
            return
        start = at
        while start > floor and text[start - 1] in EMAIL_RUN:
            start -= 1
        domain = DOMAIN.match(text, after) if start < at else None
        if domain:
            self._add("email", start, domain.end())

    def _digit(self, at: int, after: int):
        if at >= self.done["run"]:
            self._ips(at)
        if at >= self.done["card"]:
            run = CARD_RUN.match(self.text, at)
            self.done["card"] = run.end()
            digits = run[0].replace(" ", "").replace("-", "") if run.end() - at >= 12 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                self._add("card", at, run.end())

    def _ips(self, at: int):
        """Numbers joined by single dots are taken by fours, from the left, in each row of them."""
        run = IP_RUN.match(self.text, at)
        self.done["run"] = run.end()
        if run[0].count(".") < 3:
            return
        start, four = at, []
        for part in run[0].split("."):
            four = [*four, (start, part)] if part else []
            start += len(part) + 1
            if len(four) == 4:
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for _, p in four):
                    self._add("ip", four[0][0], four[3][0] + len(four[3][1]))
                four = []

    def _phone(self, at: int, after: int):
        if at < self.done["phone"]:
            return
        end = after + len(PHONE_RUN.match(self.text, after)[0].rstrip(" ().-"))
        if end < after + 2:
            return
        self.done["phone"] = end
        if 9 <= sum(c in "0123456789" for c in self.text[at:end]) <= 15:
            self._add("phone", at, end)

    def _url(self, at: int, after: int):
        text, start = self.text, at
        while start > max(self.done["url"], at - 20) and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+.-")):
            start -= 1
        run = URL_RUN.match(text, after)
        if start == at or at < self.done["url"] or not run:
            return
        self.done["url"] = run.end()
        rest = run[0].rstrip(".,;:!?)]")
        user, _, host = rest.split("/", 1)[0].rpartition("@")
        place = rest[len(user) + 1:] if user else rest
        personal = user or any(p in place for p in PERSONAL_PATHS) or any(p in place.lower() for p in PERSONAL_PARAMETERS)
        if personal and HOST.match(place):
            self._add("url", start, after + len(rest))

    def _alone(self, at: int, after: int) -> bool:
        """Whether the cue is a word of its own."""
        text = self.text
        return not (at and text[at - 1].isalnum()) and not (after < len(text) and text[after].isalnum())

    def _account(self, at: int, after: int):
        if after <= self.done["account"] or not self._alone(at, after):
            return
        start = JOINT.match(self.text, after).end()
        iban = IBAN.match(self.text, start)
        if iban:
            value = iban[0].replace(" ", "")
            end = self._iban_end(start, value)
            if end:
                self._add("account", start, end)
                return
        number = NUMBER.match(self.text, start)
        if number and sum(c.isdigit() for c in number[0]) >= 6 and len(number[0]) <= 40:
            self._add("account", start, number.end())

    def _iban_end(self, start: int, value: str):
        """The longest valid reading of at most 34 signs, for what follows may be capitals as well."""
        for size in range(min(34, len(value)), 14, -1):
            if valid_iban(value[:size]):
                seen, end = 0, start
                while seen < size:
                    seen += self.text[end] != " "
                    end += 1
                return end
        return None

    def _secret(self, at: int, after: int):
        value = VALUE.match(self.text, after) if not (at and self.text[at - 1].isalnum()) else None
        if value and value.start(1) >= self.done["secret"] and any(c.isdigit() for c in value[1]):
            self._add("secret", value.start(1), value.end(1))

    def _key(self, at: int, after: int):
        key = KEY_ID.match(self.text, at) if not (at and self.text[at - 1].isalnum()) else None
        if key:
            self._add("account", at, key.end())


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def mask(text: str, spans) -> str:
    out, upto = [], 0
    end = -1
    for kind, a, b in spans:
        if a >= end:
            out += [text[upto:a], f"[{kind.upper()}]"]
            upto = end = b
        else:
            upto = end = max(end, b)
    return "".join([*out, text[upto:]])


def _by_text(batch: pa.RecordBatch):
    finder = flat.in_worker("pii_finder", Finder)
    for text in batch.column("text"):
        text = text.as_py() or ""
        yield text, finder.spans(text)


def found(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and its spans (kind, start, end), by start and kind."""
    def run(batches):
        for batch in batches:
            for part in flat.slices(batch):
                spans = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for _, s in _by_text(part)]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digests(spans: DataFrame) -> DataFrame:
    """The counts of the base kinds, the digest of their spans, and all spans as text."""
    def text_of(rows):
        return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    kinds = F.col("spans.kind")
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return spans.select("doc_id", *counts, F.sha2(text_of(base), 256).alias("base_sha256"), text_of(F.col("spans")).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with each span replaced by its kind in brackets; n_chars, if there, follows."""
    def run(batches):
        for batch in batches:
            for part in flat.slices(flat.with_text(batch)):
                made = [mask(t, s) for t, s in _by_text(part)]
                nulls = part.column("text").is_null().to_pylist()
                made = pa.array([None if null else m for m, null in zip(made, nulls)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("_whole"), made], names=["_whole", "text"])

    told = docs.select(F.struct("*").alias("_whole"))
    swapped = {"text": F.col("text"), "n_chars": F.when(F.col("_whole.text") == F.col("text"), F.col("_whole.n_chars")).otherwise(
        F.char_length("text")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return told.mapInArrow(run, T.StructType([*told.schema.fields, T.StructField("text", T.StringType())])).select(*[
        swapped[c].alias(c) if c in swapped else F.col("_whole")[c].alias(c) for c in docs.columns])
