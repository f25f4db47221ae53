"""PII: keyed surrogates.

Entities are found by pattern, the distinct ones of the corpus form a table, and each
gets a replacement of its own type, script and format drawn from a keyed hash.  The
table is checked for collisions (two originals with one surrogate, or a surrogate that
is itself an original) and colliding entries draw again, so distinct entities stay
distinct and one entity has one surrogate everywhere.

A person's name is replaced word by word: given names by names of the same gender,
surnames by words of their own script and length.  So "James Bond" and "Mr Bond" keep one
surname, and so does "Bond" alone in a text that names him in full or by title.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinara.session import cut

SLICE = 64
#: Attempts that draw a name from the pool.
POOL_DRAWS = 3
# Titles with gender, and given names to draw from.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Herr": "m", "Frau": "f", "Señor": "m", "Señora": "f", "Monsieur": "m", "Madame": "f"}
NAMES = {
    "m": "Adrian Bruno Carlos David Emil Felix Georg Hugo Ivan Jonas Karl Louis Marco Nils Oscar Paul Rafael Simon Thomas Victor".split(),
    "f": "Anna Berta Clara Diana Elena Flora Greta Helena Ines Julia Karla Laura Maria Nora Olga Paula Rosa Sofia Teresa Vera".split(),
}
GIVEN = {name: gender for gender, names in NAMES.items() for name in names} | {"James": "m", "John": "m", "Peter": "m", "Michael": "m", "David": "m", "Robert": "m", "Mary": "f", "Jane": "f", "Anne": "f", "Elizabeth": "f", "Sarah": "f", "Emma": "f"}
_LATER = r"[A-ZÀ-ÖØ-Þ][^\W\d_]+"
_KEYS = ("token", "secret", "api_key", "password", "secret_key", "access_key", "apikey", "client_secret", "auth_token", "passwd")
_KEYED = "|".join(f"(?<={re.escape(word + sep)})" for word in _KEYS for sep in (' = "', '="', "=", ": ", ': "'))
_UPPER = "A-ZÀ-ÖØ-ÞА-ЯЁΑ-Ω"
_NAMED = rf"[{_UPPER}][^\W\d_]*[^\W\d_{_UPPER}]"
#: What stands before a name for certain.
SAYS_NAME = ("my name is ", "My name is ", "Name: ", "Author: ", "Dear ", "Signed, ", "Contact: ", "Patient: ")
#: Names that are words as well: alone, they are not taken for the person.
WORDS = frozenset("January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split())
_NUMBERS_AND_NAMES = (
    r"(?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d))"
    r"|(?P<phone>\+\d{1,3}[ -]?\(?\d{2,4}\)?[ -]?\d{3}[ -]?\d{4}(?!\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<!\d)\d(?:[ -]?\d){12,18}(?!\d))"
    r"|\b(?=[A-Z])(?P<name>(?:" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")\.? [^\W\d_]+(?: " + _LATER + r")?)"
    r"|\b(?=[A-Z])(?P<person>(?:" + "|".join(sorted(GIVEN)) + r") " + _LATER + r")"
)
_FREQUENT = (
    r"(?P<email>(?<![^\W_])[^\W_][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<secret>(?<![0-9A-Za-z_-])(?=[0-9A-Za-z_-]{16})(?:" + _KEYED + r")[0-9A-Za-z_-]+)"
    r"|" + _NUMBERS_AND_NAMES
)
PATTERN = re.compile(_FREQUENT)
#: For texts without mail addresses and secrets: what is left begins with a digit, a plus or a capital.
LEAN = re.compile(r"(?=[0-9+A-Z])(?:" + _NUMBERS_AND_NAMES + ")")
#: With entities that few texts have; they go first, as parts of them look like others.
RARE = re.compile(
    r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ipv6>(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?=[0-9A-Fa-f:]*::|(?:[0-9A-Fa-f]{1,4}:){7})[0-9A-Fa-f:]{3,39}(?![\w:]))"
    r"|(?P<cloudkey>(?<![A-Za-z0-9])A[KS]IA[0-9A-Z]{16}(?![A-Za-z0-9]))"
    r"|(?P<bearer>(?<=earer )[A-Za-z0-9._~+/-]{16,}=*)"
    r"|(?P<local>(?<![\d)+-])(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4}(?![\d-]))"
    r"|(?P<full>(?:" + "|".join(f"(?<={re.escape(x)})" for x in SAYS_NAME) + rf"){_NAMED}(?: {_NAMED})?)"
    "|" + _FREQUENT
)
_SIGNS = ("AKIA", "ASIA", "earer ", "::", *SAYS_NAME)
_SIGN = re.compile(r"\(\d{3}\)|\b\d{3}[-.]\d{3}[-.]\d|\b[A-Z]{2}\d{2} ?[A-Z0-9]{4}|(?:[0-9A-Fa-f]{1,4}:){7}")
#: A text that has no match of these expressions and holds none of the plain texts has no entity.
HINT = ("[0-9@]", r"\b(?=[A-Z])(" + "|".join([*TITLES, *sorted(GIVEN)]) + r")\b")
HELD = ("token", "secret", "_key", "apikey", "passw", "AKIA", "ASIA", *SAYS_NAME)


def _iban_rest(value: str) -> int:
    """An IBAN's check: the number that its letters and digits make, modulo 97, is 1."""
    bare = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97


def _holds(kind: str, value: str) -> bool:
    """Whether a match is what its form says, by its own check digits, structure or letters."""
    if kind == "iban":
        return 15 <= len(value.replace(" ", "")) <= 34 and _iban_rest(value) == 1
    if kind == "ipv6":
        try:
            return bool(ipaddress.IPv6Address(value))
        except ValueError:
            return False
    # what follows "Bearer" is a secret where its letters are mixed as no word's are
    return kind != "bearer" or len(set(value)) >= 10 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def matches(text: str) -> Iterator[re.Match]:
    """Entities of a text, in order; a match that does not hold is read again without its form."""
    if not (any(x in text for x in _SIGNS) or _SIGN.search(text)):
        yield from (PATTERN if "@" in text or any(x in text for x in _KEYS) else LEAN).finditer(text)
        return
    at = 0
    while m := RARE.search(text, at):
        if not _holds(m.lastgroup, m.group()):
            inner = PATTERN.search(text, m.start(), m.end())
            if not inner:
                at = m.start() + 1
                continue
            m = inner
        yield m
        at = m.end()


def _words(kind: str, value: str) -> list[tuple[str, str]]:
    """(type, value) of the parts of a match that are replaced: the words of a name, else all of it."""
    if kind not in ("name", "person", "full"):
        return [(kind, value)]
    first, *rest = value.split(" ")
    if kind == "full":
        return [("surname", w) for w in (first, *rest)]
    if kind == "person":
        return [(f"given_{GIVEN[first]}", first), ("surname", rest[0])]
    gender = TITLES[first.rstrip(".")]
    return [("surname", rest[0])] if len(rest) == 1 else [(f"given_{gender}", rest[0]), ("surname", rest[1])]


def entities(text: str | None) -> list[tuple[str, str]]:
    """Distinct (type, value) of a text, in order of first appearance."""
    return list(dict.fromkeys((m.lastgroup, m.group()) for m in matches(text or "")))


def parts(text: str | None) -> list[tuple[str, str]]:
    """Distinct (type, value) of what is replaced in a text."""
    return list(dict.fromkeys(w for kind, value in entities(text) for w in _words(kind, value)))


def rewritten(text: str, to: dict[tuple[str, str], str]) -> str:
    """``text`` with the surrogates ``to`` of its parts, surnames that stand alone included."""
    surnames = sorted((v for k, v in to if k == "surname" and len(v) > 2 and v[0].isupper() and v not in WORDS), key=len, reverse=True)
    alone = re.compile(r"\b(?:" + "|".join(map(re.escape, surnames)) + r")\b") if surnames else None
    rest = lambda x: alone.sub(lambda m: to["surname", m.group()], x) if alone else x
    out, at = [], 0
    for m in matches(text):
        words = _words(m.lastgroup, m.group())
        title = [m.group().split(" ")[0]] if m.lastgroup == "name" else []
        out += [rest(text[at : m.start()]), " ".join([*title, *(to[w] for w in words)])]
        at = m.end()
    return "".join([*out, rest(text[at:])])


class _Draw:
    """Keyed numbers for one (type, value, attempt)."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.seed = hashlib.blake2b(f"{kind}\0{value}\0{attempt}".encode(), key=key[:64]).digest()
        self.at = 0

    def below(self, n: int) -> int:
        self.at += 1
        return int.from_bytes(hashlib.blake2b(self.at.to_bytes(8, "big"), key=self.seed).digest()[:8], "big") % n


def _char(c: str, draw: _Draw) -> str:
    """Another character of the same class and script; anything else stays."""
    for low, high in (("0", "9"), ("a", "z"), ("A", "Z"), ("а", "я"), ("А", "Я"), ("α", "ρ"), ("Α", "Ρ"), ("一", "龥")):
        if low <= c <= high:
            return chr(ord(low) + draw.below(ord(high) - ord(low) + 1))
    if c.isalpha():
        return chr(ord("A" if c.isupper() else "a") + draw.below(26))
    return c


def _luhn(digits: str) -> int:
    return sum(d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for k, d in enumerate(map(int, reversed(digits)))) % 10


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """A replacement of the same type and format.  Given names leave the pool after POOL_DRAWS
    attempts for letters of their own length and script; of names and mail addresses, whose
    spaces may be small, later attempts draw longer ones."""
    draw = _Draw(key, kind, value, attempt)
    longer = "".join(_char("x", draw) for _ in range(attempt // POOL_DRAWS - 1)) if attempt >= 2 * POOL_DRAWS else ""
    if kind.startswith("given_") and value.isascii() and attempt < POOL_DRAWS:
        pool = NAMES[kind[-1]]
        return pool[draw.below(len(pool))]
    if kind == "surname" or kind.startswith("given_"):
        return "".join(_char(c, draw) for c in value) + longer
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "email":
        local, _, domain = value.rpartition("@")
        host, _, top = domain.rpartition(".")
        return "".join(_char(c, draw) for c in local) + longer + "@" + "".join(_char(c, draw) for c in host) + "." + top
    if kind == "iban":
        bare = value.replace(" ", "")
        body = "".join(_char(c, draw) for c in bare[4:])
        check = f"{98 - _iban_rest(bare[:2] + '00' + body):02d}"
        made = iter(bare[:2] + check + body)
        return "".join(c if c == " " else next(made) for c in value)
    if kind == "ipv6":
        return "".join(c if c == ":" else "123456789abcdef"[draw.below(15)] for c in value)
    if kind == "cloudkey":
        return value[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[draw.below(32)] for _ in value[4:])
    if kind == "local":
        return "".join(str(2 + draw.below(8)) if c.isdigit() else c for c in value)
    if kind == "phone":
        lead = re.match(r"\+\d{1,3}?(?=[ (-])|\+\d", value).group()
        return lead + "".join(_char(c, draw) for c in value[len(lead) :])
    if kind == "secret" and re.fullmatch("[0-9a-f]+", value):
        return "".join("0123456789abcdef"[draw.below(16)] for _ in value)
    out = "".join(_char(c, draw) for c in value)
    if kind == "card":
        digits = re.sub(r"\D", "", out)
        if _luhn(re.sub(r"\D", "", value)) == 0:
            last = next(d for d in "0123456789" if _luhn(digits[:-1] + d) == 0)
            out = out[:-1] + last
    return out


def assigned(found: DataFrame, key: bytes, rounds: int = 20) -> DataFrame:
    """(kind, value, surrogate) of distinct entities (kind, value), free of collisions;
    an error where ``rounds`` further draws leave one."""
    secret = bytes(key)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [surrogate(secret, k, v, n) for k, v, n in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], ["kind", "value", "attempt", "surrogate"])

    table = cut(found.distinct().withColumn("attempt", F.lit(0)).mapInArrow(draw, "kind string, value string, attempt int, surrogate string"))
    originals = table.select(F.col("kind").alias("k0"), F.col("value").alias("v0"))
    for n in range(rounds + 1):
        order = Window.partitionBy("kind", "surrogate").orderBy("attempt", "value")
        real = table.join(originals, (F.col("kind") == F.col("k0")) & (F.col("surrogate") == F.col("v0")), "left")
        marked = cut(real.withColumn("clash", (F.row_number().over(order) > 1) | F.col("v0").isNotNull()).select("kind", "value", "attempt", "surrogate", "clash"))
        if not marked.where("clash").limit(1).count():
            return table.select("kind", "value", "surrogate")
        if n == rounds:
            break
        again = marked.where("clash").select("kind", "value", (F.col("attempt") + 1).alias("attempt")).mapInArrow(draw, "kind string, value string, attempt int, surrogate string")
        table = cut(marked.where("NOT clash").drop("clash").unionByName(again))
        originals = table.select(F.col("kind").alias("k0"), F.col("value").alias("v0"))
    raise RuntimeError(f"surrogates still collide after {rounds} rounds")


def replaced(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_entities (distinct in the text), text with surrogates.

    Null texts stay null with no entities, empty texts empty; rows that repeat an id and text
    repeat the result, other columns are ignored; an empty table gives no rows.  Texts
    without an entity do not shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    shape = "array<struct<kind:string,value:string>>"

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                got = [[{"kind": k, "value": v} for k, v in parts(t)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pair)], ["id", "text", "found"])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts, counts = part.column(1).to_pylist(), [len(entities(t)) for t in part.column(1).to_pylist()]
                made = [rewritten(t, {(p["kind"], p["value"]): p["surrogate"] for p in pairs}) for t, pairs in zip(texts, part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(made, pa.string())], ["id", "n_entities", "text"])

    signs = [F.col("text").rlike(x) for x in HINT] + [F.col("text").contains(x) for x in HELD]
    may = F.coalesce(reduce(lambda x, y: x | y, signs), F.lit(False))
    found = read.where(may).mapInArrow(detect, f"id {kind}, text string, found {shape}")
    marked = cut(found.where(F.size("found") > 0).withColumn("uid", F.monotonically_increasing_id()))
    each = marked.select("uid", F.explode("found").alias("e")).select("uid", "e.*")
    table = assigned(each.select("kind", "value"), key)
    pairs = each.join(table, ["kind", "value"]).groupBy("uid").agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias("pairs"))
    touched = marked.join(pairs, "uid").select("id", "text", "pairs").mapInArrow(rewrite, f"id {kind}, n_entities bigint, text string")
    plain = read.where(~may).unionByName(found.where(F.size("found") == 0).select("id", "text")).select("id", F.lit(0).cast("long").alias("n_entities"), "text")
    return touched.unionByName(plain).withColumnRenamed("id", id_col)
