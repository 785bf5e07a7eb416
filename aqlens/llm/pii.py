"""Personal data replaced by surrogates.

Detected entities receive keyed replacements of the same kind: the keyed hash
of the entity's canonical form drives every choice, so all mentions of an
entity, in whatever format and document, get the same replacement, written in
the format of the mention.  Names keep the gender of the title, the script and
the letter case; cards keep a valid check digit and the issuer digit; e-mails
keep the shape of each part, and addresses of one domain stay in one domain.

Detected are e-mail addresses; phone numbers with a three-digit (or bracketed)
area code and separators, and international ones from a plus sign on, compact
or in groups; payment cards of 13 to 19 digits; IBANs; IPv4 addresses; US
social security numbers; and up to three capitalised words (or words of a
script without case) after a title (English and German ones capitalised).  Names of a script without
syllables here get letters of the same stretch of Unicode.  Every pattern tries
a run of characters once, so time is linear in the text.

Collisions: the distinct entities of all documents, e-mail domains among them,
are gathered by grouped aggregation; a replacement that two entities share, or
that is itself an entity of the documents, is drawn anew with the next attempt
number (of those that share one the least entity keeps it) until none is left.
From attempt WIDEN on each attempt draws from a larger shape than the one
before (one more character; an IPv6 address for an IPv4 one), so the rounds end
however few replacements the original shape has.  Entities off their first
attempt are few; up to BROADCAST_ENTITIES of them go to all tasks, beyond that
they reach their documents by joins.

Null texts stay null, texts without entities are unchanged, repeated rows are
treated alike, and all columns of the input are kept (a clash is not possible:
no column is added).  An empty table stays empty.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aqlens.llm.common import slices, written

BROADCAST_ENTITIES = 100_000
# Attempts within the shape of the original.
WIDEN = 4

# Titles and the gender they tell.
TITLES = {
    "mr": "m", "mister": "m", "sir": "m", "mrs": "f", "ms": "f", "miss": "f", "madam": "f", "dr": "n", "prof": "n",
    "herr": "m", "frau": "f", "monsieur": "m", "madame": "f", "mme": "f", "mlle": "f",
    "señor": "m", "señora": "f", "sr": "m", "sra": "f", "don": "m", "doña": "f",
    "господин": "m", "госпожа": "f", "κύριος": "m", "κυρία": "f",
}
# Letters that names of a script are made of, and endings by gender.
SCRIPTS = {
    "latin": ("bcdfghjklmnprstvz", "aeiou", {"m": ("n", "r", "s"), "f": ("a", "ia", "ina"), "n": ("e", "i", "y")}),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", {"m": ("ов", "ин", "ев"), "f": ("ова", "ина", "ева"), "n": ("ко", "их", "юк")}),
    "greek": ("βγδζθκλμνπρσφ", "αεηιο", {"m": ("ος", "ης", "ας"), "f": ("α", "η", "ου"), "n": ("ι", "ο", "υ")}),
}
# Letters in lower case: no name begins with one.
SMALL = "".join(chr(c) for c in range(0x2000) if chr(c).islower() and chr(c).isalpha())
WORD = rf"[^\W\d_{SMALL}](?:[^\W\d_]|[-'’](?=[^\W\d_]))*+"
# Titles that English and German write with a capital: in lower case they are
# other words.
CAPITAL = {"mr", "mister", "sir", "mrs", "ms", "miss", "madam", "dr", "prof", "herr", "frau"}
TITLE = "|".join(sorted({w for t in TITLES for w in (t.capitalize(), t.upper(), t.capitalize() if t in CAPITAL else t)}, key=len, reverse=True))
PATTERN = re.compile(
    r"(?<![A-Za-z0-9._%+-])[._%+-]*+(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
    r"|(?P<ip>(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9]))"
    r"|(?P<card>(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]))"
    r"|(?P<phone>(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?[0-9]{3,4}|(?<![0-9])[0-9]{3}[ .-][0-9]{3,4})[ .-][0-9]{4}(?![0-9])"
    r"|(?<![0-9+])\+[1-9](?:[0-9]{7,14}|[0-9]{0,2}[ .-]\(?[0-9]{1,4}\)?(?:[ .-][0-9]{2,5}){1,4})(?![0-9]))"
    rf"|\b(?P<title>{TITLE})\b\.?[ ](?P<name>{WORD}(?:[ ]{WORD}){{0,2}})"
)
# Texts without any of these hold no entity.
HINT = re.compile(rf"@|[0-9]{{3}}|[0-9]\.[0-9]|\+[1-9]|\b(?:{TITLE})\b")


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of every entity of a text."""
    if not text or not HINT.search(text):
        return []
    found = []
    for m in PATTERN.finditer(text):
        kind = next(k for k in ("email", "iban", "ssn", "ip", "card", "phone", "name") if m[k])
        value = m[kind]
        if kind == "name":
            canon = f"{TITLES[m['title'].lower()]}:{value.lower()}"
        elif kind == "email":
            canon = value.lower()
        elif kind == "ip":
            canon = value
        else:
            canon = re.sub(r"[^A-Za-z0-9]", "", value)
        if kind == "phone" and not 7 <= len(canon) <= 15:
            continue
        found.append((m.start(kind), m.end(kind), kind, canon))
    return found


class _Draws:
    """Endless numbers from a keyed hash of what they are for."""

    def __init__(self, key: bytes, what: str):
        self.key, self.what, self.block, self.pool = key, what.encode("utf-8"), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.what + b"\0%d" % self.block, hashlib.sha256).digest()
            self.block += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n

    def like(self, text: str) -> str:
        """Letters for letters, digits for digits, the rest as it is."""
        out = []
        for ch in text:
            if "0" <= ch <= "9":
                out.append(str(self.below(10)))
            elif "a" <= ch <= "z":
                out.append(chr(97 + self.below(26)))
            elif "A" <= ch <= "Z":
                out.append(chr(65 + self.below(26)))
            else:
                out.append(ch)
        return "".join(out)

    def pick(self, letters: str) -> str:
        return letters[self.below(len(letters))]


def _luhn(digits: str) -> str:
    """Check digit that follows ``digits``."""
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (2 if i % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return str(-total % 10)


@cache
def _script(letter: str) -> str | None:
    """The script of SCRIPTS that a letter belongs to, if any."""
    name = unicodedata.name(letter, "").partition(" ")[0].lower()
    return name if name in SCRIPTS else None


@cache
def _neighbours(letter: str) -> str:
    """Letters of the same kind in the letter's stretch of 128 code points."""
    base, kind = ord(letter) & ~127, unicodedata.category(letter)
    word = unicodedata.name(letter, "").partition(" ")[0]
    own = [c for c in map(chr, range(base, base + 128)) if unicodedata.category(c) == kind]
    return "".join(c for c in own if unicodedata.name(c, "").partition(" ")[0] == word)


def _name(draw: _Draws, word: str, gender: str, more: int) -> str:
    script = _script(word[0])
    if script is None:
        # what is neither a letter nor a mark of the script (hyphens) stays
        return "".join(draw.pick(_neighbours(c)) if c.isalpha() else c for c in word + more * word[-1])
    onset, vowel, endings = SCRIPTS[script]
    stem = "".join(draw.pick(onset) + draw.pick(vowel) for _ in range(max(2, len(word) // 2) + more))
    return stem + draw.pick(onset) + endings[gender][draw.below(len(endings[gender]))]


def surrogate(key: bytes, kind: str, canon: str, attempt: int = 0) -> str:
    """Canonical form of the replacement of an entity.  An e-mail address keeps
    its domain here: domains are entities of their own (kind ``domain``)."""
    draw = _Draws(key, f"{kind}|{canon}|{attempt}")
    more = max(0, attempt - WIDEN + 1)
    if kind == "email":
        local, _, domain = canon.partition("@")
        return draw.like(local + "a" * more) + "@" + domain
    if kind == "domain":
        labels, _, top = canon.rpartition(".")
        return draw.like(labels + "a" * more) + "." + top
    if kind == "ip":
        if more:
            return "2001:db8:" + ":".join(f"{draw.below(65536):x}" for _ in range(6))
        return ".".join(str(1 + draw.below(223 if i == 0 else 254)) for i in range(4))
    if kind == "card":
        body = canon[0] + draw.like(canon[1:-1] + "0" * more)
        return body + _luhn(body)
    if kind == "iban":
        body = draw.like(canon[4:] + "0" * more)
        number = "".join(str(int(c, 36)) for c in body + canon[:2] + "00")
        return f"{canon[:2]}{98 - int(number) % 97:02d}{body}"
    if kind == "name":
        gender, _, words = canon.partition(":")
        parts = words.split(" ")
        return f"{gender}:{' '.join(_name(draw, w, gender, more if i + 1 == len(parts) else 0) for i, w in enumerate(parts))}"
    if kind == "phone" and len(canon) > 10:  # country code kept
        return canon[:-10] + draw.like(canon[-10:] + "0" * more)
    return draw.like(canon + "0" * more)


def _shaped(mention: str, kind: str, canon: str) -> str:
    """The replacement written in the format of the mention."""
    if kind == "ip":
        return canon
    if kind == "name":
        new = canon.partition(":")[2].split(" ")
        out = []
        for old, word in zip(mention.split(" "), new):
            out.append(word.upper() if len(old) > 1 and old.isupper() else word[:1].upper() + word[1:])
        return " ".join(out)
    if kind == "email":
        return canon.upper() if mention.isupper() else canon
    rest = iter(canon)
    return "".join(next(rest) if ch.isalnum() else ch for ch in mention) + "".join(rest)


def with_domains(found: list[tuple[int, int, str, str]]) -> set[tuple[str, str]]:
    """(kind, canonical form) of all entities, the domains of addresses among them."""
    return {(k, c) for _, _, k, c in found} | {("domain", c.partition("@")[2]) for _, _, k, c in found if k == "email"}


def replaced(text: str | None, key: bytes, changed: dict[tuple[str, str], str]) -> str | None:
    found = entities(text)
    if not found:
        return text
    out, at = [], 0
    for start, end, kind, canon in found:
        new = changed.get((kind, canon)) or surrogate(key, kind, canon)
        if kind == "email":
            local, _, domain = new.partition("@")
            new = local + "@" + (changed.get(("domain", domain)) or surrogate(key, "domain", domain))
        out += [text[at:start], _shaped(text[start:end], kind, new)]
        at = end
    return "".join(out) + text[at:]


def resolved(df: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """Written table of the entities whose first replacement clashes: kind,
    canon and the replacement that doesn't."""

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                found = {e for b in part.column(0).to_pylist() if b for e in with_domains(entities(b.decode("utf-8")))}
                cols = list(zip(*sorted(found))) or [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["kind", "canon"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            new = [surrogate(key, k, c, n) for k, c, n in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=["kind", "canon", "attempt", "new"])

    schema = "kind string, canon string, attempt int, new string"
    texts = df.select(F.col(text_col).cast("string").cast("binary").alias("text"))
    found = written(texts.mapInArrow(detect, "kind string, canon string").distinct(), "pii-entities")
    drawn = written(found.withColumn("attempt", F.lit(0)).mapInArrow(draw, schema), "pii-drawn")
    while True:
        shared = drawn.groupBy("kind", "new").agg(F.min("canon").alias("first"), F.count("*").alias("n"))
        real = found.select(F.col("kind"), F.col("canon").alias("new"), F.lit(True).alias("real"))
        clash = written(shared.join(real, ["kind", "new"], "left").filter("n > 1 or real"), "pii-clashes")
        if clash.isEmpty():
            return drawn.filter("attempt > 0").select("kind", "canon", "new")
        marked = drawn.join(clash, ["kind", "new"], "left")
        again = F.coalesce(F.col("real"), F.lit(False)) | (F.coalesce(F.col("n"), F.lit(1)) > 1) & (F.col("canon") != F.col("first"))
        marked = marked.select("kind", "canon", "attempt", "new", again.alias("again"))
        redrawn = marked.filter("again").select("kind", "canon", (F.col("attempt") + 1).alias("attempt")).mapInArrow(draw, schema)
        drawn = written(marked.filter("not again").drop("again").unionByName(redrawn), "pii-drawn")


def replace_entities(df: DataFrame, key: bytes, text_col: str = "text", broadcast: int = BROADCAST_ENTITIES) -> DataFrame:
    """``df`` with the entities of its texts replaced."""
    changed = resolved(df, key, text_col)
    names, schema = df.columns, df.schema
    place = names.index(text_col)
    few = changed.limit(broadcast + 1).collect()
    if len(few) <= broadcast:
        known = {(r["kind"], r["canon"]): r["new"] for r in few}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                new = [replaced(t, key, known) for t in batch.column(place).to_pylist()]
                cols = list(batch.columns)
                cols[place] = pa.array(new, pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=names)

        return df.mapInArrow(run, schema)

    # Each row gets a number, its changed entities are joined to it.
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        at = (context.partitionId() if context else 0) << 40
        for batch in batches:
            found = [[{"kind": k, "canon": c} for k, c in sorted(with_domains(entities(t)))] for t in batch.column(place).to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("canon", pa.string())]))
            row = pa.StructArray.from_arrays(batch.columns, names=names)
            cols = [pa.array(range(at, at + batch.num_rows), pa.int64()), pa.array(found, kind), row]
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays(cols, names=["at", "found", "row"])

    numbered = df.mapInArrow(number, f"at long, found array<struct<kind:string,canon:string>>, row {schema.simpleString()}")
    numbered = written(numbered, "pii-rows")
    each = numbered.select("at", F.explode("found").alias("e")).select("at", "e.kind", "e.canon").distinct()
    own = each.join(changed, ["kind", "canon"]).groupBy("at").agg(F.collect_list(F.struct("kind", "canon", "new")).alias("own"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.column(0).flatten()
            own = [{(e["kind"], e["canon"]): e["new"] for e in x or ()} for x in batch.column(1).to_pylist()]
            cols[place] = pa.array([replaced(t, key, o) for t, o in zip(cols[place].to_pylist(), own)], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return numbered.join(own, "at", "left").select("row", "own").mapInArrow(apply, schema)
