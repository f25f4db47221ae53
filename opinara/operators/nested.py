"""Nested JSON of any shape, walked level by level as VARIANT values on the JVM.

Each level explodes the objects and arrays of the one before and is cut, so a plan never
grows with the depth; the walk ends when no nested value is left and raises beyond a bound.
Keys of an object come in the order of their names, as VARIANT stores them; text that is no
JSON, or has a key twice in one object, is treated as absent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.session import cut

MAX_DEPTH = 64

# Names under which providers give a record's fields; the first that counts wins.
TEXT_KEYS = ("review_text", "reviewText", "review", "comment", "body", "text", "review_body")
ID_KEYS = ("review_id", "reviewId", "id", "external_review_id")
TITLE_KEYS = ("product_title", "productTitle", "product_name", "productName", "title", "name")
INHERITED_KEYS = ("product_title", "productTitle", "product_name", "productName", "product", "name")
URL_KEYS = ("review_url", "reviewUrl", "url", "link", "permalink")
PRODUCT_URL_KEYS = ("product_url", "productUrl")
REVIEWER_KEYS = ("reviewer_name", "author", "reviewer")
RATING_KEYS = ("rating", "stars")
DATE_KEYS = ("review_date", "date", "created_at")
SKU_KEYS = ("sku", "asin", "product_id", "productId")

# Keys of evidence ids, of lists of them, and of text that a compaction leaves out.
EVIDENCE_KEYS = ("evidenceId", "reviewId")
EVIDENCE_LISTS = ("evidenceIds", "supportingEvidenceIds")
SPOKEN_KEYS = ("text", "content", "body")
LEFT_OUT_KEYS = ("text", "content", "body", "evidence", "reviewerref", "canonicalurl", "sourceurl", "url", "sourcemetadata", "provenance")
SPOKEN = "[External review text supplied separately as untrusted evidence]"
LEFT_OUT = "[omitted]"


def member(v: Column, key: str) -> Column:
    """An object's value under ``key`` as VARIANT; null where there is none."""
    return F.try_variant_get(v, f"$['{key}']", "variant")


def kind(v: Column) -> Column:
    """STRING, BIGINT, VOID and so on; OBJECT or ARRAY for nested values."""
    return F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0)


def _string(v: Column, key: str) -> Column:
    return F.when(kind(member(v, key)) == "STRING", F.try_variant_get(v, f"$['{key}']", "string"))


def first_text(v: Column, keys: tuple[str, ...]) -> Column:
    """The first value under ``keys`` that is a string and not blank."""
    return F.get(F.filter(F.array(*[_string(v, k) for k in keys]), lambda x: F.trim(x) != ""), F.lit(0))


def first_scalar(v: Column, keys: tuple[str, ...], truthy: bool = False) -> Column:
    """The first value under ``keys`` that is there and not null, as a string; with ``truthy`` not empty, zero or false either."""
    said = [F.when(~kind(member(v, k)).isin("OBJECT", "ARRAY", "VOID"), F.try_variant_get(v, f"$['{k}']", "string")) for k in keys]
    return F.get(F.filter(F.array(*said), lambda x: ~x.isin("", "0", "false") if truthy else x.isNotNull()), F.lit(0))


def children(nodes: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, path, pos, key and v of all that the nodes' objects and arrays hold."""
    spark = nodes.sparkSession
    held = nodes.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    return held.select(*keep, F.concat("path", F.array("pos")).alias("path"), "pos", "key", F.col("value").alias("v"))


def descend(nodes: DataFrame, emit: Callable[[DataFrame], DataFrame], down: Callable[[DataFrame], DataFrame], max_depth: int = MAX_DEPTH) -> DataFrame:
    """All that ``emit`` makes of the nodes (.., path, v) of every level; ``down`` gives a level's successors."""
    level, found = cut(nodes), []
    for _ in range(max_depth + 1):
        found.append(emit(level))
        level = cut(down(level))
        if level.isEmpty():
            out = found[0]
            for x in found[1:]:
                out = out.unionByName(x)
            return out
    raise ValueError(f"a payload is nested more than {max_depth} levels deep")


def _roots(payloads: DataFrame, column: str, keep: list[str]) -> DataFrame:
    return payloads.select(*keep, F.array().cast("array<int>").alias("path"), F.try_parse_json(F.col(column)).alias("v")).where(kind(F.col("v")).isin("OBJECT", "ARRAY"))


def record_nodes(payloads: DataFrame, column: str = "payload", keep: list[str] | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``keep``, path, title and v of the objects with a text under one of its names.

    Such an object is a record and is not searched further; other objects hand the first name
    or title that they have down to what they hold."""
    keep = keep or []
    v, nested = F.col("v"), kind(F.col("v"))
    is_record = (nested == "OBJECT") & first_text(v, TEXT_KEYS).isNotNull()
    roots = _roots(payloads, column, keep).select(*keep, "path", F.lit(None).cast("string").alias("title"), "v").withColumn("record", is_record)

    def down(level: DataFrame) -> DataFrame:
        # a record's own title is read from the record
        named = level.where("NOT record").withColumn("title", F.coalesce(F.when(nested == "OBJECT", first_text(v, INHERITED_KEYS)), "title"))
        inside = children(named, [*keep, "title"]).where(nested.isin("OBJECT", "ARRAY"))
        return inside.select(*keep, "path", "title", "v").withColumn("record", is_record)

    return descend(roots, lambda level: level.where("record").drop("record"), down, max_depth)


def records(payloads: DataFrame, column: str = "payload", keep: list[str] | None = None, requested_url: str | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``keep``, path, record_id, title, text, url, product_url, sku, reviewer, rating, date of each record.

    Text has single blanks and 12,000 characters at most; one of fewer than three characters,
    and a record with neither id nor URL, drop out."""
    v = F.col("v")
    text = F.substring(F.trim(F.regexp_replace(first_text(v, TEXT_KEYS), r"(?U)\s+", " ")), 1, 12000)
    asked = F.lit(requested_url).cast("string")
    got = record_nodes(payloads, column, keep, max_depth).select(
        *(keep or []), "path", first_scalar(v, ID_KEYS).alias("record_id"),
        # a record's own name stands before one that is handed down, and that before its plain title
        F.coalesce(first_text(v, INHERITED_KEYS), "title", first_text(v, TITLE_KEYS)).alias("title"),
        text.alias("text"), F.coalesce(first_text(v, URL_KEYS), asked).alias("url"),
        F.coalesce(first_scalar(v, PRODUCT_URL_KEYS, True), asked).alias("product_url"), first_scalar(v, SKU_KEYS, True).alias("sku"),
        first_scalar(v, REVIEWER_KEYS, True).alias("reviewer"), first_scalar(v, RATING_KEYS, True).alias("rating"), first_scalar(v, DATE_KEYS, True).alias("date"),
    )
    return got.where((F.length("text") >= 3) & (F.col("record_id").isNotNull() | (F.coalesce("url", F.lit("")) != "")))


def uuid_of(text: Column) -> Column:
    """A UUID in its usual form, from any of its spellings; null for other text."""
    bare = F.lower(F.regexp_replace(F.btrim(F.replace(F.replace(text, F.lit("urn:")), F.lit("uuid:")), F.lit("{}")), "-", ""))
    return F.when(bare.rlike("^[0-9a-f]{32}$"), F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def evidence_ids(outputs: DataFrame, column: str = "payload", keep: list[str] | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``keep`` and evidence_id, each once: UUIDs under an evidence key of any object, or in its lists of ids."""
    keep, v = keep or [], F.col("v")
    first, other = EVIDENCE_KEYS
    nothing = F.coalesce(F.to_json(member(v, first)).isin('""', "0", "0.0", "false", "[]", "{}", "null"), F.lit(True))
    own = F.when(nothing, _string(v, other)).otherwise(_string(v, first))
    listed = [F.coalesce(F.transform(F.try_variant_get(v, f"$['{k}']", "array<variant>"), lambda x: F.try_variant_get(x, "$", "string")), F.array().cast("array<string>")) for k in EVIDENCE_LISTS]

    def emit(level: DataFrame) -> DataFrame:
        said = level.where(kind(v) == "OBJECT").select(*keep, F.explode(F.concat(F.array(own), *listed)).alias("said"))
        return said.select(*keep, uuid_of(F.col("said")).alias("evidence_id")).where("evidence_id IS NOT NULL")

    def down(level: DataFrame) -> DataFrame:
        inside = children(level, keep)
        read = F.coalesce(F.col("key").isin(*EVIDENCE_LISTS), F.lit(False)) & (kind(v) == "ARRAY")
        return inside.where(kind(v).isin("OBJECT", "ARRAY") & ~read).select(*keep, "path", "v")

    return descend(_roots(outputs, column, keep), emit, down, max_depth).distinct()


def compacted(outputs: DataFrame, key: str, column: str = "payload", list_limit: int = 12, dict_limit: int = 60, text_limit: int = 200, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(``key``, compact): each output as JSON with the first entries of its lists and objects, texts
    cut, and source text and links left out.  ``key`` tells outputs apart; no JSON gives null.

    Levels are bounded on the way down and put together on the way up, a bounded group each."""
    v, named = F.col("v"), F.lower("key")
    text = F.try_variant_get(v, "$", "string")
    quoted = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    hidden = F.when(named.isin(*SPOKEN_KEYS), SPOKEN).when(named.isin(*LEFT_OUT_KEYS), LEFT_OUT)
    leaf = F.when(hidden.isNotNull(), quoted(hidden)).when(kind(v) == "STRING", quoted(F.substring(text, 1, text_limit))).when(~kind(v).isin("OBJECT", "ARRAY"), F.to_json(v))
    shaped = lambda df: df.select(key, "path", F.substring("key", 1, 80).alias("key"), leaf.alias("json"), kind(v).alias("kind"), "v")
    roots = outputs.select(key, F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("key"), F.try_parse_json(F.col(column)).alias("v")).where("v IS NOT NULL")
    levels = [cut(shaped(roots))]
    while not (inner := levels[-1].where("json IS NULL")).isEmpty():
        if len(levels) > max_depth:
            raise ValueError(f"an output is nested more than {max_depth} levels deep")
        wide = children(inner.select(key, "path", F.col("kind").alias("_within"), "v"), [key, "_within"])
        levels.append(cut(shaped(wide.where(F.col("pos") < F.when(F.col("_within") == "OBJECT", dict_limit).otherwise(list_limit)))))
    below = None
    for level in reversed(levels):
        whole = level.drop("v")
        if below is not None:
            parts = below.groupBy(key, F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).agg(F.array_sort(F.collect_list(F.struct(F.element_at("path", -1).alias("pos"), "key", "json"))).alias("parts"))
            joined = whole.join(parts.withColumnRenamed(key, "_k").withColumnRenamed("path", "_p"), F.col(key).eqNullSafe(F.col("_k")) & (F.col("path") == F.col("_p")), "left")
            entries = F.coalesce("parts", F.array().cast("array<struct<pos:int,key:string,json:string>>"))
            made = F.when(F.col("kind") == "OBJECT", F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["json"])), ","), F.lit("}")))
            made = made.otherwise(F.concat(F.lit("["), F.array_join(F.transform(entries, lambda e: e["json"]), ","), F.lit("]")))
            whole = joined.withColumn("json", F.coalesce("json", made)).select(key, "path", "key", "json", "kind")
        below = whole
    return outputs.select(key).join(below.select(F.col(key).alias("_k"), F.col("json").alias("compact")), F.col(key).eqNullSafe(F.col("_k")), "left").select(key, "compact")
