"""License scans by ordered signature rules, as columns only.

A text is cut into lower-case words. The distinct words that are keywords of rules say which rules may match; a text without
any is not looked at again. Otherwise every word gets its number, so that a match of a signature tells its first and
last word by itself. Detections are then ordered by place, and one whose words lie within those of another of equal or
higher priority is suppressed (of equal intervals the higher priority stays, of equal priorities the earlier rule), in
one pass that keeps only the greatest end seen for each priority. Detections that overlap without containment both stay.

A null or empty text has no words: counts of zero, null places, empty labels, score 0. Texts of any length are scanned whole, in
their own row; there is no exchange, so hot keys, repeated rows and null or repeated ids mean nothing here. All columns of the
input stay, whatever their names; only one named as `into` is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.license_rules import PRIORITIES, RULES, STRENGTH, Rule, over_numbered_words

#: What stands between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Detections are folded in chunks, so that lists of what is kept are not copied once for each detection.
CHUNK = 64
_FOUND = "array<struct<first:int,before:int,behind:int,rule:int,label:string,base:boolean>>"


def words(text: Column) -> Column:
    """The words of a text; those of A to Z in lower case."""
    small = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(small, GAP), "")


def _table(rules: list[Rule]) -> Column:
    """All rules as one constant; priorities are negative, so that high ones sort first."""
    def row(r: Rule) -> Column:
        fields = {"rule": r.number, "label": r.label, "behind": -r.priority, "keyword": r.keyword, "base": r.base, "pattern": over_numbered_words(r.signature)}
        return F.struct(*(F.lit(v).alias(k) for k, v in fields.items()))

    return F.array(*map(row, rules))


def _spans(numbered: Column, rule: Column) -> Column:
    number = lambda m, pattern: F.regexp_extract(m, pattern, 1).cast("int")
    return F.transform(
        F.regexp_extract_all(numbered, rule["pattern"], F.lit(0)),
        # in this order they are sorted: the first word, the last one (far ones first), the priority, the rule
        lambda m: F.struct(number(m, r"\x00([0-9]+)").alias("first"), (-number(m, r"\x00([0-9]+)$")).alias("before"), rule["behind"].alias("behind"), rule["rule"].alias("rule"), rule["label"].alias("label"), rule["base"].alias("base")),
    )


def kept(found: Column) -> Column:
    """Of detections in order, those that no other suppresses."""
    def step(state: Column, d: Column) -> Column:
        end, level = -d["before"], -d["behind"]
        return F.struct(
            F.transform(state["ends"], lambda e, p: F.when(p < level, F.greatest(e, end)).otherwise(e)).alias("ends"),
            F.when(F.get(state["ends"], level - 1) >= end, state["kept"]).otherwise(F.concat(state["kept"], F.array(d))).alias("kept"),
        )

    none = F.array().cast(_FOUND)
    ends = F.array(*[F.lit(-1)] * PRIORITIES)

    def chunk(state: Column, at: Column) -> Column:
        inner = F.aggregate(F.slice(found, at * CHUNK + 1, CHUNK), F.struct(state["ends"].alias("ends"), none.alias("kept")), step)
        return F.get(F.transform(F.array(inner), lambda r: F.struct(r["ends"].alias("ends"), F.concat(state["kept"], F.array(r["kept"])).alias("kept"))), F.lit(0))

    start = F.struct(ends.alias("ends"), F.array().cast(f"array<{_FOUND}>").alias("kept"))
    chunks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int"))
    return F.when(F.size(found) == 0, none).otherwise(F.aggregate(chunks, start, chunk, lambda s: F.flatten(s["kept"])))


def scan(docs: DataFrame, text: str = "text", into: str = "licenses", rules: list[Rule] = RULES) -> DataFrame:
    """docs with a struct: n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    n_base counts all places of base phrases, first_word and last_word are their least and greatest starts. labels are the
    base ones and those of the detections that stay (first, last, label, priority, rule; words from 0). score is one less the
    product of what each distinct pair of label and priority leaves open.
    """
    own = "__" + into
    while any(c.lower().startswith(own.lower()) for c in docs.columns):
        own = "_" + own
    w, m, r, f, k = (f"{own}_{x}" for x in ("words", "met", "rules", "found", "kept"))
    keywords = F.array(*map(F.lit, sorted({x.keyword for x in rules})))
    numbered = F.array_join(F.transform(w, lambda x, i: F.concat(x, F.lit("\0"), i.cast("string"))), " ")
    out = docs.withColumn(w, words(F.col(text)))
    out = out.withColumn(m, F.array_intersect(w, keywords))
    out = out.withColumn(r, F.when(F.size(m) > 0, F.filter(_table(rules), lambda x: F.array_contains(m, x["keyword"]))))
    both = F.get(F.transform(F.array(numbered), lambda t: F.array_sort(F.flatten(F.transform(r, lambda x: _spans(t, x))))), F.lit(0))
    out = out.withColumn(f, F.when(F.col(r).isNotNull(), both).otherwise(F.array().cast(_FOUND)))
    out = out.withColumn(k, kept(F.col(f)))
    base = F.filter(f, lambda d: d["base"])
    base_labels = F.array_sort(F.array_distinct(F.transform(base, lambda d: d["label"])))
    labels = F.array_sort(F.array_union(base_labels, F.transform(k, lambda d: d["label"])))
    told = F.array_distinct(F.transform(k, lambda d: F.struct(d["label"], d["behind"])))
    open_ = F.create_map(*(F.lit(x) for p, s in STRENGTH.items() for x in (-p, round(1 - s, 9))))
    score = 1 - F.aggregate(told, F.lit(1.0), lambda a, d: a * open_[d["behind"]])
    detections = F.transform(k, lambda d: F.struct(d["first"].alias("first"), (-d["before"]).alias("last"), d["label"].alias("label"), (-d["behind"]).alias("priority"), d["rule"].alias("rule")))
    starts = F.transform(base, lambda d: d["first"].cast("long"))
    result = F.struct(
        F.size(w).cast("long").alias("n_words"), F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        base_labels.alias("base_labels"), labels.alias("labels"), score.alias("score"), detections.alias("detections"),
    )
    return out.withColumn(into, result).drop(w, m, r, f, k)
