"""Lexical domain routing of documents, by a table of terms that is a parameter.

A term's weight is 1, and a quarter for each of up to four repeats; groups of terms that have to occur
together give bonuses and focal signals. A domain that needs a focal signal yields without one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numbers import router_confidence
from . import frames as O

#: Phrases of a sentence that speak of other work, or of the paper's own.
INCIDENTAL = ("for example", "example", "cited", "previously reported", "prior work", "literature example", "review")
FOCAL = (
    "we synthesized", "we prepared", "we measured", "our experiment", "experimental section", "methods", "reaction conditions", "electrochemical measurement", "we exposed",
    "specimens were", "samples were", "polarization tests", "eis measurements", "we tested", "tests were conducted", "was measured", "were measured",
)
#: The least score and margin of a domain without a focal signal.
LEAST_SCORE, LEAST_MARGIN = 4.0, 0.25


@dataclass
class Domain:
    """Terms of a domain; bonuses as (signal, worth, groups of terms of which each has to occur)."""

    name: str
    terms: tuple[str, ...]
    bonuses: tuple[tuple[str, float, tuple[tuple[str, ...], ...]], ...] = ()
    needs_focal: bool = False
    paper_types: dict[str, tuple[str, ...]] = field(default_factory=dict)


def _occurs(text: Column, terms: tuple[str, ...]) -> Column:
    return O.any_of(*(X.term_count(text, t) > 0 for t in terms))


def _signals(sentences: Column, terms: tuple[str, ...], cues: tuple[str, ...], but: tuple[str, ...] = ()) -> Column:
    """Terms in sentences with a cue of one kind and none of the other."""
    cued = lambda s: O.any_of(*(F.contains(s, F.lit(q)) for q in cues)) & ~O.any_of(*(F.contains(s, F.lit(q)) for q in but))
    held = F.array_join(F.filter(sentences, cued), "\n")
    return F.array_compact(F.array(*(F.when(X.term_count(held, t) > 0, F.lit(t)) for t in terms)))


def score_domains(docs: DataFrame, domains: list[Domain], id_col: str = "doc_id") -> DataFrame:
    """doc, domain, score, matched, focal, incidental: one row for each document and domain."""
    low = docs.select(F.col(id_col).alias("doc"), F.lower("text").alias("t")).filter("trim(t) <> ''")
    low = low.withColumn("s", F.split("t", r"(?<=[.!?])\s+"))
    cells = []
    for d in domains:
        counts = {t: X.term_count(F.col("t"), t) for t in d.terms}
        hits = F.array_compact(F.array(*(F.when(n > 0, F.lit(t)) for t, n in counts.items())))
        incidental = _signals(F.col("s"), d.terms, INCIDENTAL)
        focal = _signals(F.col("s"), d.terms, FOCAL, INCIDENTAL)
        bonus = F.greatest(F.lit(0.0), *(F.when(O.all_of(*(_occurs(F.col("t"), g) for g in groups)), worth).otherwise(0.0) for _, worth, groups in d.bonuses), F.lit(0.0))
        named = F.array_compact(F.array(*(F.when(O.all_of(*(_occurs(F.col("t"), g) for g in groups)), F.lit(signal)) for signal, _, groups in d.bonuses), F.lit(None).cast("string")))
        focal = F.array_distinct(F.concat(focal, named))
        base = sum((X.term_score(n) for n in counts.values()), F.lit(0.0))
        score = F.greatest(F.lit(0.0), base + bonus + 0.5 * F.size(focal) - 0.75 * F.size(incidental))
        cells.append(F.struct(F.lit(d.name).alias("domain"), score.alias("score"), hits.alias("matched"), focal.alias("focal"), incidental.alias("incidental"), F.lit(d.needs_focal).alias("needs_focal")))
    return low.select("doc", F.inline(F.array(*cells)))


def route(docs: DataFrame, domains: list[Domain], id_col: str = "doc_id") -> DataFrame:
    """doc, domain, confidence, reason: the best domain, or ``generic`` with the reason for it.

    Ties go to the first by name. Empty texts, and texts without any score, have no row.
    """
    scored = score_domains(docs, domains, id_col)
    eligible = ~F.col("needs_focal") | (F.size("focal") > 0)
    order = F.struct(F.when(eligible, 0).otherwise(1), -F.col("score"), "domain")
    per = scored.groupBy("doc").agg(F.min_by(F.struct("domain", "score", "focal", "matched"), order).alias("b"), F.sort_array(F.collect_list("score"), False).alias("all"), F.collect_list(F.struct("domain", "score")).alias("scores"))
    second = F.array_max(F.transform(F.filter("scores", lambda x: x["domain"] != F.col("b.domain")), lambda x: x["score"]))
    per = per.withColumn("margin", (F.col("b.score") - F.coalesce(second, F.lit(0.0))) / F.greatest("b.score", F.lit(1.0))).filter("b.score > 0")
    plain = F.size("b.focal") == 0
    reason = O.ladder([((F.col("b.score") < LEAST_SCORE) & plain, "weak_scientific_domain_evidence"), ((F.col("margin") < LEAST_MARGIN) & plain, "conflicting_scientific_domain_evidence")])
    return per.select(F.col("doc").alias(id_col), F.when(reason.isNull(), F.col("b.domain")).otherwise("generic").alias("domain"), router_confidence(F.col("b.score"), F.col("margin")).alias("confidence"), reason.alias("reason"), F.col("b.matched").alias("matched"), F.col("b.focal").alias("focal"))


def paper_types(docs: DataFrame, types: dict[str, tuple[str, ...]], most: int = 5, id_col: str = "doc_id") -> DataFrame:
    """doc, paper_type, score, rank: the best-scored types; ties by name, last first."""
    low = F.lower("text")
    cells = F.array(*(F.struct(sum((X.term_score(X.term_count(low, t)) for t in terms), F.lit(0.0)).alias("score"), F.lit(name).alias("paper_type")) for name, terms in types.items()))
    top = F.slice(F.reverse(F.array_sort(F.filter(cells, lambda c: c["score"] > 0))), 1, most)
    return docs.select(id_col, F.posexplode(top).alias("p", "c")).select(id_col, "c.paper_type", "c.score", (F.col("p") + 1).alias("rank"))


def candidate_priority(cues: Column, numbers: Column, units: Column, comparative: Column, background: Column) -> Column:
    """(score, priority) of a numeric statement."""
    score = 2 + F.least(F.lit(2), cues) + units.cast("int") + (numbers > 1).cast("int") + comparative.cast("int") - 4 * background.cast("int")
    return F.struct(score.alias("score"), F.when((score >= 5) & units, "high").when(score >= 3, "medium").otherwise("low").alias("priority"))
