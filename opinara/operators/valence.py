"""Heuristic sentiment: a positional pass over a text's tokens.

A token of the lexicon takes its valence, which capitals, degree words and negations among
the three tokens before it, idioms around it and "least" change; a "but" halves what stands
before it and strengthens what comes after.  The sum, with the text's marks of emphasis, gives
the compound score; what is positive, negative and neutral gives three shares that sum to one.

Everything is an expression over arrays: the tokens, their lower-case forms and their
valences lie side by side, and a token's neighbours are read by place.  The lexicon is a
table; one of up to ``LITERAL_ROWS`` rows becomes part of the expressions, a larger one is
joined with the tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions import rules as X
from opinara.functions import text as T
from opinara.operators.reviews import once

#: Rows of a lexicon that expressions may hold.
LITERAL_ROWS = 10_000
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also within a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column) -> Column:
    """Runs without white space, without punctuation at their ends where more than two characters stay."""
    raw = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    bare = lambda w: F.btrim(w, F.lit(PUNCTUATION))
    return F.transform(raw, lambda w: F.when(F.length(bare(w)) > 2, bare(w)).otherwise(w))


def capitals(word: Column) -> Column:
    return (F.upper(word) == word) & (F.lower(word) != word)


def with_valences(df: DataFrame, lexicon: DataFrame, key: str, literal_rows: int = LITERAL_ROWS) -> DataFrame:
    """``df`` (with ``_low``) and ``_v``: the valence of each token, null where the lexicon has none.

    lexicon: (term, valence); terms are read in lower case, of several valences the least
    counts.  Where it is joined, ``key`` tells the rows of ``df`` apart."""
    terms = lexicon.where("term IS NOT NULL AND valence IS NOT NULL").groupBy(F.lower("term").alias("term")).agg(F.min(F.col("valence").cast("double")).alias("valence"))
    if len(some := terms.limit(literal_rows + 1).collect()) <= literal_rows:
        if not some:
            return df.withColumn("_v", F.transform("_low", lambda w: F.lit(None).cast("double")))
        table = F.create_map(*[F.lit(x) for r in some for x in (r["term"], r["valence"])])
        # the set is hashed, the map is searched for the few tokens in the set
        return df.withColumn("_v", F.transform("_low", lambda w: F.when(w.isin(*[r["term"] for r in some]), F.try_element_at(table, w))))
    placed = df.select(F.col(key).alias("_key"), F.posexplode("_low").alias("_k", "term")).join(terms, "term")
    found = placed.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("_k", "valence"))).alias("_found"))
    joined = df.join(found, df[key].eqNullSafe(found["_key"]), "left")
    return joined.withColumn("_v", F.transform("_low", lambda w, k: F.when(F.col("_found").isNotNull(), F.try_element_at(F.col("_found"), k)))).drop("_key", "_found")


def _degree(k: Column, back: int, x: Column, mixed: Column) -> Column:
    """What the degree word ``back`` tokens before adds: with the valence's sign, more in capitals."""
    table = F.create_map(*[F.lit(v) for pair in X.DEGREES.items() for v in pair])
    word, low = F.get("_w", k - back), F.get("_low", k - back)
    boost = F.try_element_at(table, low) * F.when(x < 0, -1.0).otherwise(1.0)
    loud = F.when(capitals(word) & mixed, F.when(x > 0, X.CAPITALS).otherwise(-X.CAPITALS)).otherwise(0.0)
    return F.when(low.isin(*X.DEGREES), boost + loud).otherwise(0.0) * X.FADING[back - 1]


def _negated(low: Column) -> Column:
    return F.coalesce(low.isin(*X.NEGATIONS) | low.contains("n't"), F.lit(False))


def _said(low: Column, *words: str) -> Column:
    return F.coalesce(low.isin(*words), F.lit(False))


def _turned(k: Column, back: int, x: Column) -> Column:
    """The valence after the negation ``back`` tokens before: "never so" strengthens, "without doubt" keeps."""
    low = [F.get("_low", k - b) for b in range(4)]
    between = low[1:back]
    never = _said(low[back], "never") & _any([_said(b, "so", "this") for b in between])
    doubt = _said(low[back], "without") & _any([_said(b, "doubt") for b in between])
    out = F.when(_negated(low[back]), x * X.TURN).otherwise(x)
    return F.when(never, x * 1.25).when(doubt, x).otherwise(out) if between else out


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _idioms(k: Column, x: Column) -> Column:
    """The valence of an idiom at this place, and what degree words of two words before it add."""
    near = [F.get("_low", k + d) for d in range(-3, 3)]
    phrase = lambda a, b: F.concat_ws(" ", *near[a + 3 : b + 4])
    table = F.create_map(*[F.lit(v) for pair in X.IDIOMS.items() for v in pair])
    behind = F.coalesce(*[F.try_element_at(table, phrase(a, b)) for a, b in ((-1, 0), (-2, 0), (-2, -1), (-3, -1), (-3, -2))])
    n = F.size("_low")
    ahead = F.coalesce(F.when(n - 1 > k + 1, F.try_element_at(table, phrase(0, 2))), F.when(n - 1 > k, F.try_element_at(table, phrase(0, 1))))
    pairs = {w: v for w, v in X.DEGREES.items() if " " in w}
    extra = F.lit(0.0)
    for a, b in ((-3, -1), (-3, -2), (-2, -1)):
        for w, v in pairs.items():
            if len(w.split()) == b - a + 1:
                extra = extra + F.when(phrase(a, b) == w, v).otherwise(0.0)
    return F.coalesce(ahead, behind, x) + extra


def _least(k: Column, x: Column) -> Column:
    """ "least" before a word turns it, but not in "at least" and "very least"."""
    one, two = F.get("_low", k - 1), F.get("_low", k - 2)
    return F.when((k > 0) & F.get("_v", k - 1).isNull() & _said(one, "least") & ~_said(two, "at", "very"), x * X.TURN).otherwise(x)


def _scored(k: Column, mixed: Column) -> Column:
    """The valence of the lexicon's token at place ``k``, where it stands."""
    own, low = F.get("_v", k), [F.get("_low", k - b) for b in range(4)]
    # "no" before a word of the lexicon is a negation, no word of its own
    start = F.when((low[0] == "no") & F.get("_v", k + 1).isNotNull(), 0.0).otherwise(own)
    start = F.when(_said(low[1], "no") | _said(low[2], "no") | (_said(low[3], "no") & _said(low[1], "or", "nor")), own * X.TURN).otherwise(start)
    x = let(start, lambda x: F.when(capitals(F.get("_w", k)) & mixed, F.when(x > 0, x + X.CAPITALS).otherwise(x - X.CAPITALS)).otherwise(x))
    for back in (1, 2, 3):
        x = let(x, _step(k, back, mixed))
    return let(x, lambda y: _least(k, y))


def _step(k: Column, back: int, mixed: Column) -> Callable[[Column], Column]:
    """What the token ``back`` places before does to a valence; a token with a valence of its own does nothing."""
    free = (k >= back) & F.get("_v", k - back).isNull()

    def step(x: Column) -> Column:
        after = let(x + _degree(k, back, x, mixed), lambda y: _turned(k, back, y))
        after = let(after, lambda y: _idioms(k, y)) if back == 3 else after
        return F.when(free, after).otherwise(x)

    return step


def scored(df: DataFrame, lexicon: DataFrame, text_col: str = "text", key: str = "review_id", literal_rows: int = LITERAL_ROWS) -> DataFrame:
    """``df`` with compound, positive_score, negative_score, neutral_score, confidence (the label's
    share) and label.  A null or blank text is neutral with scores of zero."""
    base = df.withColumn("_w", once(tokens(F.col(text_col)))).withColumn("_low", F.transform("_w", F.lower))
    base = with_valences(base, lexicon, key, literal_rows)
    n, loud = F.size("_w"), F.size(F.filter("_w", capitals))
    mixed = F.col("_mixed")
    # degree words have no valence of their own, whatever the lexicon says, nor has "kind" in "kind of"
    own = lambda k: F.get("_v", k).isNotNull() & ~F.get("_low", k).isin(*X.DEGREES) & ~((F.get("_low", k) == "kind") & _said(F.get("_low", k + 1), "of"))
    places = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), own)
    held = base.withColumn("_at", places).withColumn("_mixed", F.when(F.size("_at") > 0, (loud > 0) & (loud < n)).otherwise(False))
    but = F.array_position("_low", "but") - 1
    weight = lambda k: F.when(F.col("_but") < 0, 1.0).when(k < F.col("_but"), 0.5).when(k > F.col("_but"), 1.5).otherwise(1.0)
    each = held.withColumn("_but", but).withColumn("_s", once(F.transform("_at", lambda k: _scored(k, mixed) * weight(k))))
    plus = lambda col, f: F.aggregate(F.transform(col, f), F.lit(0.0), lambda a, x: a + x)
    text = F.coalesce(F.col(text_col), F.lit(""))
    calls, asks = F.least(F.length(text) - F.length(F.replace(text, F.lit("!"))), F.lit(4)), F.length(text) - F.length(F.replace(text, F.lit("?")))
    emphasis = calls * X.CALL + F.when(asks > 3, X.ASKS).when(asks > 1, asks * X.ASK).otherwise(0.0)
    summed = each.withColumns({"_sum": plus("_s", lambda x: x), "_pos": plus("_s", lambda x: F.when(x > 0, x + 1).otherwise(0.0)), "_neg": plus("_s", lambda x: F.when(x < 0, 1 - x).otherwise(0.0)), "_neu": (n - F.size(F.filter("_s", lambda x: x != 0))).cast("double"), "_emphasis": emphasis})
    total = F.col("_sum") + F.signum("_sum") * F.col("_emphasis")
    pos = F.col("_pos") + F.when(F.col("_pos") > F.col("_neg"), F.col("_emphasis")).otherwise(0.0)
    neg = F.col("_neg") + F.when(F.col("_neg") > F.col("_pos"), F.col("_emphasis")).otherwise(0.0)
    shares = summed.withColumns({"_t": total, "_p": pos, "_n": neg})
    whole = F.col("_p") + F.col("_n") + F.col("_neu")
    share = lambda x: F.bround(F.coalesce(F.try_divide(x, whole), F.lit(0.0)), 3)
    out = shares.withColumns({"compound": F.bround(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_t") / F.sqrt(F.col("_t") * F.col("_t") + X.ALPHA))), 4), "positive_score": share(F.col("_p")), "negative_score": share(F.col("_n")), "neutral_score": share(F.col("_neu"))})
    out = out.withColumn("label", T.compound_label(F.col("compound")))
    confidence = F.when(F.col("label") == "positive", F.col("positive_score")).when(F.col("label") == "negative", F.col("negative_score")).otherwise(F.col("neutral_score"))
    return out.withColumn("confidence", confidence).select(*df.columns, "compound", "positive_score", "negative_score", "neutral_score", "confidence", "label")
