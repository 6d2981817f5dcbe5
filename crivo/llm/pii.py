"""Personal data replaced by surrogates: keyed, of the same kind and form, distinct where the originals are.

Detected are mail addresses, phone and card numbers, IP addresses, social
security numbers, IBANs, secrets (access keys, assigned tokens and passwords)
and names after a title. An entity is a kind with a normal form (digits of a
phone number, small letters of an address), so that one person's number in two
notations is one entity and gets one surrogate, in each place in its own notation.

A surrogate is drawn from an HMAC of kind, normal form and a number of the
attempt. Characters keep their class: digits, capitals, small letters of Latin,
Cyrillic or Greek script; hexadecimal secrets stay hexadecimal, card numbers and
IBANs keep valid check digits, given names their gender and script. All
surrogates are compared with each other and with all originals; an entity whose
surrogate is taken draws again, until all are free and distinct.

Null and empty texts stay as they are, as do all other columns; rows that repeat
get the same replacements. Only texts with entities are shuffled.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Entities that draw again at most so often; after GENERATE draws names are made of syllables, longer with each draw,
#: and private addresses of a narrow range come from 10.x.x.x.
MAX_DRAWS, GENERATE = 64, 4

#: Titles before names, with the gender they tell, and common given names.
TITLES = {
    "Mr": "m", "Mister": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m", "Signor": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "Doña": "f", "Signora": "f",
    "Dr": "x", "Prof": "x", "Professor": "x", "Doctor": "x", "г-н": "m", "г-жа": "f", "Господин": "m", "Госпожа": "f",
}
GIVEN = {
    ("LATIN", "f"): "Anna Maria Laura Julia Clara Elena Sophie Emma Alice Nora Marta Irene Lucia Helen Karin Ruth Diana Paula Vera Rosa".split(),
    ("LATIN", "m"): "Peter Paul Thomas Martin David Daniel Robert Carlos Victor Hugo Oscar Simon Felix Anton Bruno Mario Henry George Louis Adam".split(),
    ("CYRILLIC", "f"): "Анна Мария Елена Ольга Вера Нина Ирина Софья Дарья Лидия".split(),
    ("CYRILLIC", "m"): "Иван Пётр Павел Сергей Андрей Виктор Олег Борис Антон Юрий".split(),
}
ALPHABETS = {"LATIN": "abcdefghijklmnopqrstuvwxyz", "CYRILLIC": "абвгдежзийклмнопрстуфхцчшщыэюя", "GREEK": "αβγδεζηθικλμνξοπρστυφχψω"}
SYLLABLES = {"LATIN": "ba de fi go lu ma ne pi ro sa ta vi".split(), "CYRILLIC": "ба де ви го лу ма не пи ро са та ни".split(), "GREEK": "βα δε φι γο λυ μα νε πι ρο σα τα νι".split()}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
MAIL = re.compile(r"(?<![\w.+-])[\w+-][\w.+-]*@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
IP = re.compile(rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)")
CARD = re.compile(r"(?<![\d+])(?<!\d[.,])(?:\d{13,19}|\d{4}(?:([ -])\d{4})(?:\1\d{4}){2}(?:\1\d{1,3})?|\d{4}([ -])\d{6}\2\d{4,5})(?![\d-])")
SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
PHONE = re.compile(
    r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\) ?\d{3,4}[ .-]\d{3,4}|(?:1[ .-])?\d{3}([ .-])\d{3}\1\d{4})(?!\w)")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
ACCESS = re.compile(r"(?<![A-Z0-9])AKIA[A-Z0-9]{16}(?![A-Z0-9])")
SECRET = re.compile(r"(?i)(?<![^\W_])(?:token|api[_-]?key|secret(?:[_-]?key)?|password|passwd|pwd)[\"']?\s{0,3}[=:]\s{0,3}(?:\"([^\"\n]{6,})\"|'([^'\n]{6,})'|([\w+/.~-]{6,}=*))")
NAME = re.compile(r"(?<!\w)(" + "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True)) + r")\.? ([^\W\d_]+)(?: ([^\W\d_]+))?")


def luhn(digits: str) -> int:
    """0 for a number with a right check digit."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10


def iban_rest(value: str) -> int:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


def _national(value: str) -> tuple[str, int]:
    """Digits of a phone number without country code and leading zeros, and how many digits come before them."""
    digits = re.sub(r"\D", "", value)
    skip = len(re.match(r"\+?(\d*)", value)[1]) if re.match(r"\+\d{1,3}[ .(-]", value) else 0
    if not skip and len(digits) == 11 and digits[0] == "1":
        skip = 1
    while skip < len(digits) - 1 and digits[skip] == "0":
        skip += 1
    return digits[skip:], skip


def detect(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of the entities of a text, in order, none inside another; earlier kinds win."""
    found: list[tuple[int, int, str, str]] = []
    if not text:
        return found
    add = lambda m, kind, norm, g=0: found.append((m.start(g), m.end(g), kind, norm))
    digits = re.search(r"\d", text) is not None
    if "@" in text:
        for m in MAIL.finditer(text):
            add(m, "mail", m[0].lower())
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            add(m, "access", m[0])
    if "=" in text or ":" in text:
        for m in SECRET.finditer(text):
            # after a colon, a word without digits is prose
            prose = m.lastindex >= 3 and not re.search(r"\d", m[3]) and "=" not in m[0][:m.start(3) - m.start()]
            # a row of stars or dashes is masked already
            if not prose and any(map(str.isalnum, m[m.lastindex])):
                add(m, "secret", m[m.lastindex], m.lastindex)
    if digits:
        for m in IBAN.finditer(text):
            if iban_rest(value := m[0].replace(" ", "")) == 1:
                add(m, "iban", value)
        for m in IP.finditer(text):
            add(m, "ip", m[0])
        for m in CARD.finditer(text):
            add(m, "card", re.sub(r"\D", "", m[0]))
        for m in SSN.finditer(text):
            add(m, "ssn", m[0])
        for m in PHONE.finditer(text):
            value = _national(m[0])[0]
            if 7 <= len(value) <= 14:
                add(m, "phone", value)
    for m in NAME.finditer(text):
        first, last = m[2], m[3] if m[3] and m[3][0].isupper() else None
        if not first[0].isupper():
            continue
        if last:
            known = next((g for (_, g), names in GIVEN.items() if first in names), TITLES[m[1]])
            add(m, f"given_{known if TITLES[m[1]] == 'x' else TITLES[m[1]]}", first.lower(), 2)
            add(m, "family", last.lower(), 3)
        else:
            add(m, "family", first.lower(), 2)
    kept, taken = [], bytearray(len(text))
    for s, e, kind, norm in found:
        if 1 not in taken[s:e]:
            kept.append((s, e, kind, norm))
            taken[s:e] = b"\1" * (e - s)
    return sorted(kept)


class _Draw:
    """Numbers from an HMAC, as many as asked for."""

    def __init__(self, key: bytes, *what):
        self.key, self.what, self.block, self.left = key, "\0".join(map(str, what)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hmac.new(self.key, self.what + b"\0%d" % self.block, hashlib.sha256).digest()
            self.block += 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value % n


def script_of(char: str) -> str | None:
    name = unicodedata.name(char, "").split(" ")[0]
    return name if name in ALPHABETS else None


def redrawn(text: str, draw: _Draw, hexadecimal: bool = False) -> str:
    """Every digit and letter redrawn within its class; what is neither stays, letters of other scripts move within their block of 16."""
    out = []
    for c in text:
        if "0" <= c <= "9":
            out.append("0123456789"[draw.below(10)])
        elif hexadecimal and c.lower() in "abcdef":
            out.append("abcdef"[draw.below(6)] if c.islower() else "ABCDEF"[draw.below(6)])
        elif c.isalpha():
            script = script_of(c)
            if script:
                new = ALPHABETS[script][draw.below(len(ALPHABETS[script]))]
                out.append(new.upper() if c.isupper() else new)
            else:
                block = [x for x in map(chr, range(ord(c) & ~15, (ord(c) | 15) + 1)) if unicodedata.category(x) == unicodedata.category(c)]
                out.append(block[draw.below(len(block))])
        else:
            out.append(c)
    return "".join(out)


def _wider(draw: _Draw, attempt: int) -> str:
    """Letters that are added once many draws have collided, so that a form with few surrogates, or none, still gets one."""
    return "".join("abcdefghijklmnopqrstuvwxyz"[draw.below(26)] for _ in range(attempt // GENERATE))


def surrogate(kind: str, norm: str, key: bytes, attempt: int) -> str:
    """The normal form of a surrogate."""
    draw = _Draw(key, kind, norm, attempt)
    if kind == "mail":
        local, domain = norm.rsplit("@", 1)
        labels, top = domain.rsplit(".", 1)
        return f"{redrawn(local, draw)}{_wider(draw, attempt)}@{redrawn(labels, draw)}.{top}".lower()
    if kind == "card":
        body = norm[0] + redrawn(norm[1:-1], draw)
        return body + (str((10 - luhn(body + "0")) % 10) if luhn(norm) == 0 else str(draw.below(10)))
    if kind == "phone":
        return "23456789"[draw.below(8)] + redrawn(norm[1:], draw) + "".join(str(draw.below(10)) for _ in range(attempt // GENERATE))
    if kind == "ssn":
        return f"{1 + draw.below(665):03d}-{1 + draw.below(99):02d}-{1 + draw.below(9999):04d}"
    if kind == "ip":
        parts = norm.split(".")
        keep = 1 if parts[0] in ("10", "127") else 2 if parts[:2] == ["192", "168"] or parts[0] == "172" and 16 <= int(parts[1]) < 32 else 0
        if keep == 2 and attempt >= GENERATE:  # the range may be full
            parts, keep = ["10"], 1
        if attempt >= 2 * GENERATE:  # the reserved addresses from 240 on, which nobody has
            return ".".join([str(240 + draw.below(15)), *(str(draw.below(256)) for _ in range(3))])
        new = [str(1 + draw.below(254)) for _ in range(4)]
        while not keep and (new[0] in ("10", "127", "172", "192") or int(new[0]) > 223):
            new[0] = str(1 + draw.below(223))
        return ".".join(parts[:keep] + new[keep:])
    if kind == "iban":
        body = redrawn(norm[4:], draw)
        return f"{norm[:2]}{98 - iban_rest(norm[:2] + '00' + body):02d}{body}"
    if kind == "access":
        return "AKIA" + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[draw.below(32)] for _ in norm[4:])
    if kind == "secret":
        return redrawn(norm, draw, hexadecimal=re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", norm) is not None) + _wider(draw, attempt)
    script = script_of(norm[0])
    if script is None:
        return redrawn(norm, draw) + redrawn(norm, draw) * (attempt // GENERATE)
    gender = kind[-1] if kind.startswith("given") else ""
    names = GIVEN.get((script, gender)) or [n for (s, _), ns in GIVEN.items() if s == script and kind == "given_x" for n in ns]
    if names and attempt < GENERATE:
        return names[draw.below(len(names))].lower()
    return "".join(SYLLABLES[script][draw.below(12)] for _ in range(3 + attempt // GENERATE))


def in_form(kind: str, new: str, old: str) -> str:
    """The surrogate's normal form in the notation of one place."""
    if kind in ("card", "phone", "iban"):
        skip = _national(old)[1] if kind == "phone" else 0
        out, chars = [], iter(new)
        for c in old:
            if not c.isalnum():
                out.append(c)
            elif skip:
                out.append(c)
                skip -= 1
            else:
                out.append(next(chars, ""))
        return "".join(out) + "".join(chars)
    if kind == "mail":
        # what was added to the local part has no counterpart in the old text
        at, more = old.index("@"), len(new) - len(old)
        cased = lambda x, o: "".join(a.upper() if b.isupper() else a for a, b in zip(x, o))
        return cased(new[:at], old[:at]) + new[at:at + more] + cased(new[at + more:], old[at:])
    if kind == "family" or kind.startswith("given"):
        return new.upper() if len(old) > 1 and old.isupper() else new.capitalize()
    return new


SPANS = T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("norm", T.StringType()),
]))


def detected(df: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """``df`` with the entities of its text."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, SPANS)])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("norm", pa.string())]))
    fields = ("start", "end", "kind", "norm")

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            spans = pa.array([[dict(zip(fields, s)) for s in detect(x)] for x in texts], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, spans], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def assigned(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, norm, new) for distinct (kind, norm): surrogates that are distinct within a kind and none of the originals."""
    def draw(batches):
        for pdf in batches:
            pdf["new"] = [surrogate(k, n, key, a) for k, n, a in zip(pdf["kind"], pdf["norm"], pdf["attempt"])]
            yield pdf

    schema = "kind string, norm string, attempt int, new string"
    drawn = common.stored(entities.select("kind", "norm", F.lit(0).alias("attempt")).mapInPandas(draw, schema), "surrogates")
    originals = entities.select("kind", F.col("norm").alias("new"), F.lit(True).alias("real"))
    for _ in range(MAX_DRAWS):
        best = drawn.groupBy("kind", "new").agg(F.min(F.struct("attempt", "norm")).alias("first"), F.count("*").alias("n"))
        taken = best.join(originals, ["kind", "new"], "left").filter(F.col("real") | (F.col("n") > 1)).select(
            "kind", "new", "first", F.coalesce("real", F.lit(False)).alias("real"))
        taken = common.stored(taken, "taken")
        if taken.isEmpty():
            return drawn.select("kind", "norm", "new")
        judged = drawn.join(taken, ["kind", "new"], "left").withColumn(
            "again", F.coalesce(F.col("real") | (F.col("first.norm") != F.col("norm")), F.lit(False)))
        redraw = judged.filter("again").select("kind", "norm", (F.col("attempt") + 1).alias("attempt")).mapInPandas(draw, schema)
        drawn = common.stored(judged.filter("not again").select("kind", "norm", "attempt", "new").unionByName(redraw), "surrogates")
    raise RuntimeError(f"surrogates still collide after {MAX_DRAWS} draws")


def replace(df: DataFrame, key: bytes, text: str = "text", count: str | None = None) -> DataFrame:
    """``df`` with every entity of ``text`` replaced; ``count`` names a column for the number of replacements, if wanted."""
    spans, row, new, n = common.private(df, "spans", "row", "new", count or "n")
    found = detected(df, text, spans)
    clean = found.filter(F.size(spans) == 0).withColumn(n, F.lit(0).cast("long")).drop(spans)
    hits = common.stored(found.filter(F.size(spans) > 0).withColumn(row, F.monotonically_increasing_id()), "hits")
    places = hits.select(row, F.explode(spans).alias("s")).select(row, "s.*")
    chosen = assigned(places.select("kind", "norm").distinct(), key)
    per_row = places.join(chosen, ["kind", "norm"]).groupBy(row).agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind", "new"))).alias(new))
    schema = T.StructType([*df.schema.fields, T.StructField(n, T.LongType())])

    def rewrite(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            out, counts = [], []
            for old, places in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                parts, end = [], 0
                for p in places:
                    parts += [old[end:p["start"]], in_form(p["kind"], p["new"], old[p["start"]:p["end"]])]
                    end = p["end"]
                out.append("".join(parts) + old[end:])
                counts.append(len(places))
            columns = [pa.array(out, batch.column(at).type) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=schema.names)

    changed = hits.join(per_row, row).select(*[common.col(c) for c in df.columns], new).mapInArrow(rewrite, schema)
    out = clean.unionByName(changed)
    return out if count else out.drop(n)
