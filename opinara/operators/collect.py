"""Collected records: payloads, pages, identity and provenance, as DataFrame operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinara.functions import text as T

def normalize(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Records with their rating as ``stars`` and their date as ``day``; of those that agree on id (or
    URL, without an id) and the first 160 characters, per ``by``, the first by path."""
    stable = F.concat(F.coalesce("record_id", "url", F.lit("")), F.lit(":"), F.substring(F.lower("text"), 1, 160))
    rows = records.withColumn("stars", T.parse_rating(F.col("rating"))).withColumn("day", T.parse_date(F.col("date")))
    # the digest is what meets; copies of one record are reduced before they travel
    first = rows.withColumn("_k", F.sha2(stable, 256)).groupBy(*(by or []), "_k").agg(F.min_by(F.struct(*rows.columns), "path").alias("_r"))
    return first.select("_r.*")


def issue_time(raw: Column) -> Column:
    """The day of an epoch (seconds) or an ISO timestamp; null for anything else."""
    return F.coalesce(F.to_date(F.timestamp_seconds(raw.try_cast("double"))), F.try_to_date(F.substring(raw, 1, 10), "yyyy-MM-dd"))


def discussions(comments: DataFrame) -> DataFrame:
    """Comments (id, body, created, score) as records: removed and deleted ones drop out."""
    body = F.trim("body")
    return comments.where(~body.isin("[removed]", "[deleted]", "")).select(F.col("id").alias("record_id"), body.alias("text"), issue_time(F.col("created").cast("string")).alias("day"))


def candidates(found: DataFrame, category: str | None = None, n: int = 25) -> DataFrame:
    """Candidate sources (name, category, url, priority): of one category if given, the first of
    those that agree on name, category and canonical URL, ``n`` at most by priority and name."""
    rows = found.where(F.col("category") == category) if category else found
    keyed = rows.withColumn("_u", F.coalesce(T.canonical_url(F.col("url")), F.col("url")))
    first = Window.partitionBy(F.lower("name"), "category", "_u").orderBy("priority", "url")
    once = keyed.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k", "_u")
    return once.orderBy("priority", "name", "url").limit(n)


# Source type by host.
HOST_TYPES = (("amazon.", "amazon"), ("flipkart.", "flipkart"), ("reddit.com", "reddit"), ("github.com", "github_issues"))


def source_type(url: Column) -> Column:
    host, out = F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit("website")
    for part, kind in reversed(HOST_TYPES):
        out = F.when(host.contains(part), kind).otherwise(out)
    return out


def product_url(url: Column, keep: tuple[str, ...] = ("pid", "lid")) -> Column:
    """A shop URL of which the path and the parameters in ``keep`` stay, in that order."""
    pairs = [F.concat(F.lit(f"{k}="), F.nullif(F.regexp_extract(url, rf"[?&]{k}=([^&#]+)", 1), F.lit(""))) for k in keep]
    query = F.concat_ws("&", *pairs)
    return F.concat(T.canonical_url(url), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


# Words that make another product of a name they stand beside.
VARIANTS = ("ultra", "plus", "fe", "pro", "max", "mini", "lite", "se")


@dataclass(frozen=True)
class Entity:
    """What a product is known by."""

    name: str
    brand: str | None = None
    model: str | None = None
    sku: str | None = None
    url: str | None = None
    identifiers: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()
    variants: tuple[str, ...] = VARIANTS


def canonical_name(name: str, model: str | None) -> str:
    """``name`` with those words of ``model`` that it lacks."""
    have = name.lower().split()
    return " ".join([*name.split(), *(w for w in (model or "").split() if w.lower() not in have)])


def discovered(name: str) -> tuple[str | None, str | None]:
    """(brand, model) of a product name: its first word, and its first word with a digit."""
    words = name.split()
    return (words[0] if words else None), next((w for w in words if any(c.isdigit() for c in w)), None)


def _squeezed(text: str | None) -> str:
    return " ".join((text or "").split())[:200].lower()


def _standing(compact: Column, words: str) -> Column:
    """Whether ``words`` stand in the text with no letter or digit of ASCII beside them."""
    return compact.contains(words) & compact.rlike(f"(?<![a-z0-9])\\Q{words}\\E(?![a-z0-9])")


def identified(records: DataFrame, entity: Entity) -> DataFrame:
    """Records (title, text, sku, url) that are the entity's, with method and confidence.

    In this order: SKU 0.99; product URL (host without www, path without its last slash) 0.98;
    name 0.95, which rejects for good where a variant's word is among the first two words of
    what stays without the name; brand and model 0.92; identifier 0.99, equal to the SKU or to
    all that is said; alias 0.90.  Names are looked for as whole words in title and text with
    everything but ASCII letters and digits as blanks.  ``text`` and ``sku`` may be missing."""
    have = set(records.columns)
    said = F.lower(F.concat_ws(" ", *[F.col(c) for c in ("title", "text") if c in have]))
    sku = F.lower(F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("sku", "record_id") if c in have], F.lit("")))
    rows = records.withColumn("_c", F.trim(F.regexp_replace(said, "[^a-z0-9]+", " "))).withColumn("_s", sku)
    compact, name = F.col("_c"), _squeezed(entity.name)
    at = F.instr(compact, name)
    rest = F.split(F.trim(F.concat(F.substring(compact, F.lit(1), at - 1), F.lit(" "), F.substring(compact, at + len(name), F.length(compact)))), " +")
    other = F.exists(F.slice(rest, 1, 2), lambda w: w.isin(*entity.variants)) if entity.variants else F.lit(False)
    hit = lambda method, c: F.struct(F.lit(method).alias("method"), F.lit(c).alias("confidence"))
    tests: list[tuple[Column, Column]] = []
    if entity.sku:
        tests.append((F.col("_s") == _squeezed(entity.sku), hit("sku", 0.99)))
    if entity.url:
        place = lambda u: F.struct(F.regexp_replace(F.lower(F.try_parse_url(u, F.lit("HOST"))), r"^www\.", ""), F.rtrim(F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")), F.lit("/")))
        web = lambda u: F.coalesce(F.lower(F.try_parse_url(u, F.lit("PROTOCOL"))).isin("http", "https"), F.lit(False))
        shown = F.col("product_url" if "product_url" in have else "url")
        tests.append((web(shown) & web(F.lit(entity.url)) & (place(shown) == place(F.lit(entity.url))), hit("url", 0.98)))
    if name:
        tests += [(_standing(compact, name) & other, hit("rejected", 0.0)), (_standing(compact, name), hit("name", 0.95))]
    if entity.brand and entity.model:
        tests.append((_standing(compact, _squeezed(entity.brand)) & _standing(compact, _squeezed(entity.model)), hit("brand_model", 0.92)))
    tests += [((F.col("_s") == x.lower()) | (compact == x.lower()), hit("identifier", 0.99)) for x in entity.identifiers if x]
    tests += [(_standing(compact, _squeezed(x)), hit("alias", 0.9)) for x in entity.aliases if x.strip()]
    found = F.coalesce(*[F.when(t, m) for t, m in tests]) if tests else F.lit(None).cast("struct<method:string,confidence:double>")
    return rows.withColumn("_m", found).where("_m.confidence > 0").select(*records.columns, "_m.*")


def verified(records: DataFrame, entity: Entity, level: int, method: str, provider: str) -> DataFrame:
    """Usable records of the entity, with how they were collected."""
    some = identified(records.where(F.col("text").rlike(r"(?U)\S")), entity)
    return some.withColumn("metadata", F.create_map(F.lit("level"), F.lit(str(level)), F.lit("collection_method"), F.lit(method), F.lit("provider"), F.lit(provider)))


def prototype_records(payload: DataFrame, entity: str, most: int = 100) -> DataFrame:
    """(text, rating, day) of a JSON array's first ``most`` items that name the entity: texts of 10,000
    characters at most, ratings from 0 to 5, ISO dates."""
    items = payload.select(F.posexplode(F.from_json("payload", "array<struct<text:string,rating:double,date:string>>")).alias("k", "i")).where(F.col("k") < most).select("i.*")
    held = items.where(F.lower("text").contains(entity.lower()) & (F.length("text") <= 10000))
    return held.select("text", F.when(F.col("rating").between(0, 5), F.col("rating")).alias("rating"), F.try_to_date("date", "yyyy-MM-dd").alias("day"))


def labelled_rows(rows: DataFrame, labels: tuple[str, ...] = ("positive", "negative", "neutral")) -> DataFrame:
    """(text, label) of an evaluation file with columns in any case; blank texts drop out, a label
    that is not known is an error."""
    names = {c.lower(): c for c in rows.columns}
    got = rows.select(F.col(f"`{names['text']}`").alias("text"), F.lower(F.trim(F.col(f"`{names['label']}`"))).alias("label")).where(F.trim("text") != "")
    if bad := got.where(~F.col("label").isin(*labels) | F.col("label").isNull()).limit(1).collect():
        raise ValueError(f"unknown label: {bad[0]['label']}")
    return got
