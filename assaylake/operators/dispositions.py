"""Answers about candidates, merged into a document one after another, each as a whole or not at all.

An answer's additions have to rest on its candidate's evidence and must not contradict what the document, or an
earlier accepted answer, says of the same record. Answers that share no record don't wait for each other: a
round takes all whose predecessors are decided.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.settled import settled
from . import frames as O

_A = ["doc_id", "seq"]


def merge_dispositions(known: DataFrame, candidates: DataFrame, answers: DataFrame, additions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, outcomes): the records after the merge, and each answer with accepted and reason.

    ``known``: doc_id, local_id, identity; ``candidates``: doc_id, candidate_id, snippet; ``answers``: doc_id, seq (unique), candidate_id,
    status, reason; ``additions``: doc_id, seq, local_id, identity (null: says nothing), snippet. Of answers to one candidate
    the first counts. A refused answer leaves nothing behind.
    """
    first = F.row_number().over(Window.partitionBy("doc_id", "candidate_id").orderBy("seq"))
    asked = answers.withColumn("_turn", first).join(candidates.select("doc_id", "candidate_id", F.col("snippet").alias("_quoted"), F.lit(True).alias("_known")), ["doc_id", "candidate_id"], "left")
    early = O.ladder([(F.col("_known").isNull() | (F.col("_turn") > 1), "unknown_or_duplicate_candidate_id"), (F.col("status") == "rejected", F.coalesce("reason", F.lit("rejected")))])
    asked = asked.select(*_A, "candidate_id", "_quoted", early.alias("_early"))
    open_ = asked.filter("_early is null")
    adds = additions.join(open_.select(*_A, "_quoted"), _A)
    bad = adds.filter(~F.coalesce(F.contains("_quoted", F.col("snippet")) & (F.length("snippet") > 0), F.lit(False))).select(*_A).distinct()
    adds = adds.join(bad, _A, "left_anti").select(*_A, "local_id", "identity")
    # An answer that contradicts itself is no use; one that says nothing new of a record still waits for it.
    own = adds.groupBy(*_A, "local_id").agg(F.count_distinct("identity").alias("_n"), F.max("identity").alias("identity"))
    torn = own.filter("_n > 1").select(*_A).distinct()
    own = settled(own.join(torn, _A, "left_anti").select(*_A, "local_id", "identity"))
    before = F.lag("seq").over(Window.partitionBy("doc_id", "local_id").orderBy("seq"))
    waits = settled(own.select(*_A, "local_id", "identity", before.alias("_before")))
    state = known.groupBy("doc_id", "local_id").agg(F.min("identity").alias("identity"))
    done = settled(open_.select(*_A).join(own.select(*_A).distinct(), _A, "left_anti").withColumn("accepted", F.lit(False)).limit(0))
    ahead = settled(waits.select(*_A).distinct())
    while not ahead.isEmpty():
        held = waits.join(ahead, _A).join(done.select("doc_id", F.col("seq").alias("_before"), F.lit(True).alias("_decided")), ["doc_id", "_before"], "left")
        ready = held.groupBy(*_A).agg(F.bool_and(F.col("_before").isNull() | F.col("_decided").isNotNull()).alias("_ready")).filter("_ready").select(*_A)
        met = waits.join(ready, _A).join(state.withColumnRenamed("identity", "_held"), ["doc_id", "local_id"], "left")
        verdict = met.groupBy(*_A).agg(F.bool_and(F.coalesce(F.col("identity") == F.col("_held"), F.lit(True))).alias("accepted"))
        verdict = settled(verdict)
        news = waits.join(verdict.filter("accepted"), _A).select("doc_id", "local_id", "identity")
        state = settled(state.unionByName(news).groupBy("doc_id", "local_id").agg(F.min("identity").alias("identity")))
        done = settled(done.unionByName(verdict))
        ahead = settled(ahead.join(verdict.select(*_A), _A, "left_anti"))
    late = asked.join(done, _A, "left").join(additions.select(*_A).distinct().withColumn("_adds", F.lit(True)), _A, "left")
    accepted = F.col("_early").isNull() & F.coalesce(F.col("accepted"), F.col("_adds").isNull())
    reason = F.coalesce("_early", F.when(~accepted, "candidate_evidence_or_identity_mismatch"))
    return state, late.select(*_A, "candidate_id", accepted.alias("accepted"), reason.alias("reason"))
