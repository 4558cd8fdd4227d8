"""Evidence facts, snapshots of them, and read-only tools over a snapshot; tables of calls and claims are in responses."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.hashing import text_id
from flowloom.functions.text import count_pt, days_pt, number_pt
from flowloom.operators.profile import bottlenecks
from flowloom.sources.scratch import written

# Bounds of snapshots, tools and claims.
MAX_FACTS, MAX_EDGES, MAX_VARIANTS, MAX_TOOL_CALLS, MAX_CLAIMS, MAX_ID = 40, 256, 32, 3, 4, 40
SNAPSHOT_FACTS, SNAPSHOT_EDGES, SNAPSHOT_VARIANTS, SNAPSHOT_PATH = 32, 256, 128, 80
FACT_KINDS = ["metric", "distribution", "variant", "conformance", "quality", "simulation"]
LEGACY = ("legacy-analysis", "legacy00000000", "legacy")
ILL_FORMED = "A resposta do modelo não passou pela validação de formato."
ALL_REJECTED = "Todas as afirmações foram rejeitadas pelo gate de evidências."
# Number words that a claim must not hold.
NUMBER_WORDS = "zero|dois|duas|tr[eê]s|quatro|cinco|seis|sete|oito|nove|dez|onze|doze|vinte|trinta|cem|cento|mil|milh[aã]o|milh[õo]es"
COUNTED_WORDS = "únic[oa]|apenas|total|segundo|primeir[oa]|dois?|casos?|dias?|horas?|eventos?|variantes?|recursos?|etapas?|atividades?|transições?"
FACT = ["id", "kind", "label", "value", "detail", "source_path"]


def _fact(id_: Column | str, kind: str, label: Column, value: Column, detail: Column, path: Column | str) -> list[Column]:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return [c.alias(n) for c, n in zip((lit(id_), F.lit(kind), lit(label), value, detail, lit(path)), FACT, strict=True)]


def _percent(x: Column) -> Column:
    return F.concat(number_pt(x * 100, 1), F.lit("%"))


def facts(metrics: DataFrame, edges: DataFrame, activities: DataFrame, variants: DataFrame, conformance: DataFrame, quality: DataFrame) -> DataFrame:
    """Four facts of the whole log, the worst wait and up to three variants. quality: completeness, rejected_rows, issue_types."""
    s, c = F.concat, F.col
    days = lambda x: days_pt(x, 2)
    lead = metrics.select(*_fact("lead-time", "distribution", "Lead time mediano", days(c("median_lead_days")), s(F.lit("P90 "), days(c("p90_lead_days")), F.lit("; média "), days(c("avg_lead_days")), F.lit("; "), count_pt(c("case_count")), F.lit(" casos.")), "metrics.medianLeadDays"))
    kinds = activities.agg(F.count("*").alias("kinds"))
    volume = metrics.crossJoin(kinds).select(*_fact("volume", "metric", "Volume observado", s(count_pt(c("case_count")), F.lit(" casos")), s(count_pt(c("event_count")), F.lit(" eventos e "), count_pt(c("kinds")), F.lit(" atividades.")), "metrics.caseCount"))
    fit = conformance.select(*_fact("conformance", "conformance", "Conformidade em holdout", s(_percent(c("fitness")), F.lit(" fitness")), s(F.lit("Precisão "), _percent(c("precision")), F.lit("; generalização "), _percent(c("generalization")), F.lit("; "), c("validation_cases").cast("string"), F.lit(" casos no holdout.")), "conformance"))
    complete = quality.select(*_fact("data-quality", "quality", "Completude de campos obrigatórios", _percent(c("completeness")), s(count_pt(c("rejected_rows")), F.lit(" linhas rejeitadas; "), count_pt(c("issue_types")), F.lit(" tipos de alerta.")), "quality"))
    worst = bottlenecks(edges, 1).select(*_fact("bottleneck", "distribution", s(F.lit("Maior espera mediana · "), c("from_activity"), F.lit(" → "), c("to_activity")), days(c("median")), s(F.lit("P90 "), days(c("p90")), F.lit("; IQR "), days(c("iqr")), F.lit("; "), count_pt(c("n")), F.lit(" ocorrências.")), s(F.lit("edges."), c("edge_id"), F.lit(".waitDays"))))
    ranked = variants.withColumn("variant_id", text_id("variant", c("path_key")))
    order = [F.desc("n"), F.desc("impact"), "variant_id"]
    one = ranked.orderBy(*order).limit(3).withColumn("i", F.row_number().over(Window.orderBy(*order)))
    number = c("i").cast("string")
    shown = one.select(*_fact(s(F.lit("variant-"), number), "variant", s(F.lit("Variante "), number), s(count_pt(c("n")), F.lit(" casos · "), _percent(c("share"))), s(F.lit("Lead mediano "), days(c("lead_median")), F.lit("; impacto "), days(c("impact")), F.lit("; "), F.array_join("path", " → "), F.lit(".")), s(F.lit("variants."), c("variant_id"))))
    return reduce(DataFrame.unionByName, (lead, volume, fit, complete, worst, shown))


def snapshot_edges(edges: DataFrame) -> DataFrame:
    named = edges.withColumn("edge_id", text_id("edge", F.col("from_activity"), F.col("to_activity")))
    return named.orderBy(F.desc("n"), "edge_id").limit(MAX_EDGES).select("edge_id", "from_activity", "to_activity", "n", "mean", "median", "p90", "p95", "iqr")


def snapshot_variants(variants: DataFrame) -> DataFrame:
    named = variants.withColumn("variant_id", text_id("variant", F.col("path_key")))
    return named.orderBy(F.desc("n"), F.desc("impact"), "variant_id").limit(MAX_VARIANTS).select("variant_id", "path", "n", "share", "lead_mean", "lead_median", "lead_p90", "lead_p95", "lead_iqr", "impact")


@dataclass
class Snapshot:
    """What an investigation may see: facts, transitions and variants of one analysis."""

    analysis_id: str
    source_hash: str
    facts: DataFrame
    edges: DataFrame | None = None
    variants: DataFrame | None = None


def snapshot(analysis_id: str, source_hash: str, facts: DataFrame, edges: DataFrame, variants: DataFrame) -> Snapshot:
    """A snapshot of all facts and transitions and the first variants, refused where a bound is broken."""
    named = edges.withColumn("edge_id", text_id("edge", F.col("from_activity"), F.col("to_activity"))).select("edge_id", "from_activity", "to_activity", "n", "mean", "median", "p90", "p95", "iqr")
    out = Snapshot(analysis_id, source_hash, facts.select(*FACT), named, snapshot_variants(variants))
    broken = snapshot_faults(out).collect()  # a row for each kind of fault
    if broken:
        raise ValueError("; ".join(sorted(r["fault"] for r in broken)))
    return out


def legacy_snapshot(facts: DataFrame) -> Snapshot:
    """A snapshot of facts alone; a fact without kind is a metric, one without source is legacy."""
    told = facts.withColumn("kind", F.coalesce("kind", F.lit("metric"))).withColumn("source_path", F.coalesce("source_path", F.lit(LEGACY[2])))
    return Snapshot(LEGACY[0], LEGACY[1], told.select(*FACT))


def _outside(column: str, low: int, high: int) -> Column:
    return ~F.coalesce(F.length(column).between(low, high), F.lit(False))


def snapshot_faults(s: Snapshot) -> DataFrame:
    """fault, n: what breaks the bounds of a snapshot, and how often; no row for a sound one."""
    no_number = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")) | (F.col(c) < 0)
    broken = lambda tests: reduce(lambda a, b: a | b, tests)
    fact = broken([_outside("id", 1, 40), ~F.coalesce(F.col("kind").isin(FACT_KINDS), F.lit(False)), _outside("label", 1, 180), _outside("value", 1, 80), _outside("detail", 1, 400), _outside("source_path", 1, 240)])
    tables = [("facts", s.facts, 1, SNAPSHOT_FACTS, fact)]
    if s.edges is not None:
        edge = broken([_outside("edge_id", 1, 80), _outside("from_activity", 1, 120), _outside("to_activity", 1, 120), *map(no_number, ("n", "mean", "median", "p90", "p95", "iqr"))])
        tables.append(("edges", s.edges, 0, SNAPSHOT_EDGES, edge))
    if s.variants is not None:
        steps_ = F.exists("path", lambda a: ~F.coalesce(F.length(a).between(1, 120), F.lit(False)))
        variant = broken([_outside("variant_id", 1, 80), ~F.coalesce(F.size("path").between(1, SNAPSHOT_PATH), F.lit(False)), steps_, F.col("impact").isNull() | F.isnan("impact"), F.col("share") > 1, *map(no_number, ("n", "share", "lead_mean", "lead_median", "lead_p90", "lead_p95", "lead_iqr"))])
        tables.append(("variants", s.variants, 0, SNAPSHOT_VARIANTS, variant))
    parts = []
    for name, df, least, most, test in tables:
        told = df.agg(F.count("*").alias("rows"), F.count_if(test).alias("bad"))
        parts.append(told.select(F.lit(f"{name}: rows").alias("fault"), F.when(~F.col("rows").between(least, most), F.col("rows")).alias("n")))
        parts.append(told.select(F.lit(f"{name}: values").alias("fault"), F.when(F.col("bad") > 0, F.col("bad")).alias("n")))
    ids = F.when(F.lit(not 1 <= len(s.analysis_id) <= 80 or not 8 <= len(s.source_hash) <= 128), 1)
    parts.append(s.facts.sparkSession.range(1).select(F.lit("ids").alias("fault"), ids.cast("long").alias("n")))
    return reduce(DataFrame.unionByName, parts).where("n is not null")


def edge_facts(edges: DataFrame, *more: str) -> DataFrame:
    """Facts of transitions (edge_id, from_activity, to_activity, n, median, p90, p95, iqr), with more of their columns."""
    s, c = F.concat, F.col
    return edges.select(*more, *_fact(
        F.substring(s(F.lit("tool-"), c("edge_id")), 1, MAX_ID), "distribution", s(c("from_activity"), F.lit(" → "), c("to_activity")), s(F.lit("mediana "), days_pt(c("median"))),
        s(F.lit("P90 "), days_pt(c("p90")), F.lit("; P95 "), days_pt(c("p95")), F.lit("; IQR "), days_pt(c("iqr")), F.lit("; "), count_pt(c("n")), F.lit(" ocorrências.")), s(F.lit("edges."), c("edge_id"), F.lit(".waitDays")),
    ))


def inspect_transition(edges: DataFrame, edge_id: str) -> DataFrame:
    found = edges.where(F.col("edge_id") == edge_id)
    if found.isEmpty():
        raise ValueError("Transição fora do escopo autorizado.")
    return edge_facts(found)


def variant_facts(variants: DataFrame, side: str | Column, *more: str) -> DataFrame:
    """Facts of variants (variant_id, n, share, lead_median, lead_p90, impact) on one side of a comparison, with more of their columns."""
    s, c = F.concat, F.col
    side = F.lit(side) if isinstance(side, str) else side
    return variants.select(*more, *_fact(
        F.substring(s(F.lit("tool-"), side, F.lit("-"), c("variant_id")), 1, MAX_ID), "variant", s(F.lit("Variante "), c("variant_id")), s(count_pt(c("n")), F.lit(" casos")),
        s(F.lit("Participação "), _percent(c("share")), F.lit("; mediana "), days_pt(c("lead_median")), F.lit("; P90 "), days_pt(c("lead_p90")), F.lit("; impacto "), days_pt(c("impact")), F.lit(".")), s(F.lit("variants."), c("variant_id")),
    ))


def compare_variants(variants: DataFrame, left: str, right: str) -> DataFrame:
    if left == right:
        raise ValueError("A comparação exige duas variantes distintas.")
    sided = written(variants.where(F.col("variant_id").isin(left, right)), "compared")
    if sided.count() != 2:
        raise ValueError("Variante fora do escopo autorizado.")
    return variant_facts(sided, F.when(F.col("variant_id") == left, "left").otherwise("right"))


def rank_bottlenecks(edges: DataFrame, limit: int) -> DataFrame:
    if not 1 <= limit <= 5:
        raise ValueError("limit must lie between 1 and 5")
    return edge_facts(edges.orderBy(F.desc("median"), F.desc("n"), "edge_id").limit(limit))


def merged_facts(parts: list[DataFrame]) -> DataFrame:
    """Facts of several lists: an id keeps its first place and takes its last value; the first forty."""
    rows = reduce(DataFrame.unionByName, (p.select(*FACT).withColumn("part", F.lit(i)).withColumn("place", F.monotonically_increasing_id()) for i, p in enumerate(parts)))
    by = Window.partitionBy("id")
    last = rows.withColumn("n", F.row_number().over(by.orderBy(F.desc("part"), F.desc("place")))).withColumn("first", F.min(F.struct("part", "place")).over(by))
    return last.where("n = 1").orderBy("first").limit(MAX_FACTS).select(*FACT)


def has_number(text: Column) -> Column:
    word = r"(?<![A-Za-z0-9_])(?:%s)(?![A-Za-z0-9_])"
    counted = r"(?<![A-Za-z0-9_])(?:um|uma)\s+(?:%s)(?![A-Za-z0-9_])"
    return text.rlike(r"[0-9]|%|(?iu:" + word % NUMBER_WORDS + ")") | text.rlike("(?iu)" + counted % COUNTED_WORDS)
