"""Evidence ledger of investigations: what each tool of a run returned, and what findings may cite.

Tool outputs of any shape become one long relation (run, tool, evidence, source); findings
are joined to it many to many.  A finding stands on citations that its own run's tools
returned and that are still eligible: anything else is found by an anti-join, not by asking
a model again.  Rows are stored by their key, so a run that is recorded twice is there once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinara.operators.nested import evidence_ids, uuid_of
from opinara.sources.stored import merge

KEYS = ["run_id", "tool", "evidence_id"]


def entries(outputs: DataFrame, evidence: DataFrame, most: int | None = None) -> DataFrame:
    """(run_id, tool, evidence_id, source) of tool outputs (run_id, tool, step, payload).

    evidence: (evidence_id, source) of what is eligible; ids that are not among it drop out.  With
    ``most``, a run takes that many different ids at most: in the order of its steps, and of ids
    within one; a later tool that returns an id again is recorded with it."""
    found = evidence_ids(outputs, keep=["run_id", "tool", "step"]).join(evidence.select("evidence_id", F.coalesce("source", F.lit("unknown")).alias("source")), "evidence_id")
    if most is not None:
        first = found.groupBy("run_id", "evidence_id").agg(F.min("step").alias("_first"))
        order = Window.partitionBy("run_id").orderBy("_first", "evidence_id")
        kept = first.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).select("run_id", "evidence_id")
        found = found.join(kept, ["run_id", "evidence_id"], "left_semi")
    return found.groupBy(*KEYS).agg(F.first("source").alias("source"))


def record(rows: DataFrame, path: str) -> dict[str, int]:
    """Stores entries by run, tool and evidence; what is there already stays as it is."""
    return merge(rows.select(*KEYS, "source"), path, KEYS, changed=F.lit(False))


def citations(findings: DataFrame) -> DataFrame:
    """(run_id, finding_id, evidence_id), each once, of findings (run_id, finding_id, evidence_ids): an
    id in any spelling of a UUID; what is none keeps its own text and is available nowhere."""
    each = findings.select("run_id", "finding_id", F.explode("evidence_ids").alias("said"))
    return each.select("run_id", "finding_id", F.coalesce(uuid_of(F.col("said")), "said").alias("evidence_id")).distinct()


def checked(findings: DataFrame, ledger: DataFrame) -> DataFrame:
    """``findings`` with cited, unavailable and state: ``valid``, ``uncited`` (nothing cited), or
    ``rejected`` (something cited that the run's tools did not return)."""
    cited = citations(findings)
    there = ledger.select("run_id", "evidence_id").distinct().withColumn("_there", F.lit(True))
    counts = cited.join(there, ["run_id", "evidence_id"], "left").groupBy("run_id", "finding_id").agg(F.count(F.lit(1)).alias("cited"), F.count_if(F.col("_there").isNull()).alias("unavailable"))
    joined = findings.join(counts, ["run_id", "finding_id"], "left").fillna(0, ["cited", "unavailable"])
    return joined.withColumn("state", F.when(F.col("cited") == 0, "uncited").when(F.col("unavailable") > 0, "rejected").otherwise("valid"))


def support(findings: DataFrame, ledger: DataFrame) -> DataFrame:
    """(run_id, finding_id, evidence, tools, sources) of valid findings: how many ids, and from how many
    tools and sources; counted without collecting any."""
    good = checked(findings, ledger).where("state = 'valid'").select("run_id", "finding_id")
    rows = citations(findings).join(good, ["run_id", "finding_id"]).join(ledger, ["run_id", "evidence_id"])
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("evidence_id", "tool", "source")])).alias("p")
    single = rows.select("run_id", "finding_id", parts).select("run_id", "finding_id", "p.*").distinct()
    named = {"evidence": "evidence_id", "tools": "tool", "sources": "source"}
    return single.groupBy("run_id", "finding_id").agg(*[F.count_if(F.col("kind") == k).alias(name) for name, k in named.items()])


def composition(ledger: DataFrame) -> DataFrame:
    """(run_id, source, evidence, share): different ids of each source and their percentage of the run's."""
    ids = ledger.select("run_id", "source", "evidence_id").distinct().groupBy("run_id", "source").agg(F.count(F.lit(1)).alias("evidence"))
    whole = F.sum("evidence").over(Window.partitionBy("run_id"))
    return ids.withColumn("share", F.bround(F.col("evidence") / whole * 100, 2))


def answer(ledger: DataFrame, tools: DataFrame) -> DataFrame:
    """(run_id, claim): the summary of a run that no model has put into words; ``tools``: (run_id, tool)
    of all that were asked, also those without a result."""
    one = lambda c: ledger.select("run_id", c).distinct().groupBy("run_id").agg(F.count(F.lit(1)).alias(c))
    runs = tools.select("run_id", "tool").distinct().groupBy("run_id").agg(F.count(F.lit(1)).alias("tools"))
    full = runs.join(one("evidence_id"), "run_id", "left").join(one("source"), "run_id", "left").fillna(0, ["evidence_id", "source"])
    return full.select("run_id", F.format_string("%d tools returned %d distinct eligible evidence records from %d sources.", "tools", "evidence_id", "source").alias("claim"))
