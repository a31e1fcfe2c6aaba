"""Approval gates and review queues: logs of decisions folded into current state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelward.functions.columns import instant
from modelward.functions.relational import top_per_key

# Accepted decisions.
GATE_DECISIONS = ("approve", "reject", "request_changes")
REVIEW_DECISIONS = ("approved", "overridden", "rejected")

_WHEN = ("event_time", "event_id")
_VOTE = ("approval_id", "voter", *_WHEN, "decision")
_REVIEW = ("prediction_id", *_WHEN, "reviewer_email", "decision", "overridden_value")


def first_votes(votes: DataFrame) -> DataFrame:
    """The vote of each voter per gate that counts: the first with an accepted decision. A vote without a voter never counts."""
    ok = votes.where(F.col("decision").isin(*GATE_DECISIONS) & F.col("approval_id").isNotNull() & F.col("voter").isNotNull())
    return ok.groupBy("approval_id", "voter").agg(F.min(F.struct(*_WHEN, "decision")).alias("_v")).select("approval_id", "voter", "_v.*")


def closings(votes: DataFrame, gates: DataFrame) -> DataFrame:
    """When and how each gate closed: at its first rejection or at the approval that reached the required count.

    The k-th approval is found by a rank cut that Spark applies before the shuffle, so a gate with very many votes
    ships only k of them per task; k is the largest count that any of the gates requires.
    """
    need = F.greatest(F.coalesce(F.col("required_count"), F.lit(1)), F.lit(1))
    wanted = gates.select("approval_id", need.alias("required_count"))
    most = wanted.agg(F.max("required_count")).first()[0] or 1
    closing = first_votes(votes).where("decision <> 'request_changes'")
    ranked = top_per_key(closing, ["approval_id", "decision"], [F.asc(c) for c in _WHEN], int(most), rank="_rank")
    at = F.struct(*_WHEN)
    stop = F.min(F.when((F.col("decision") == "reject") & (F.col("_rank") == 1), at))
    reached = F.min(F.when((F.col("decision") == "approve") & (F.col("_rank") == F.col("required_count")), at))
    closed = wanted.join(ranked, "approval_id", "left").groupBy("approval_id", "required_count").agg(stop.alias("_stop"), reached.alias("_reached"))
    return closed.select(
        "approval_id",
        "required_count",
        F.least("_stop", "_reached").alias("closed_at"),
        F.when(F.coalesce("_stop", "_reached").isNull(), "pending").when(F.least("_stop", "_reached") == F.col("_stop"), "rejected").otherwise("approved").alias("status"),
    )


def fold_votes(votes: DataFrame, gates: DataFrame) -> DataFrame:
    """Every vote with its outcome: recorded, or refused with the reason.

    A voter counts once per gate; votes after the close are refused; asking for changes is recorded and changes nothing.
    A log row delivered again is one vote and gets one outcome. A vote without a voter is refused.
    """
    closed = closings(votes, gates).select("approval_id", "status", "closed_at")
    counted = first_votes(votes).select("approval_id", "voter", F.struct(*_WHEN).alias("_first"), F.col("decision").alias("_decision"))
    at = F.struct(*_WHEN)
    known = F.col("status").isNotNull()
    valid = F.coalesce(F.col("decision").isin(*GATE_DECISIONS), F.lit(False))
    in_time = F.col("closed_at").isNull() | (F.col("_first") <= F.col("closed_at"))
    mine = F.col("_first").isNotNull() & (at == F.col("_first")) & (F.col("decision") == F.col("_decision"))
    recorded = known & mine & in_time
    reason = (
        F.when(~known, "unknown gate")
        .when(~valid, "invalid decision")
        .when(F.col("voter").isNull(), "no voter")
        .when(recorded, "")
        .when(in_time & ~mine, "already voted")
        .otherwise(F.concat(F.lit("gate already "), F.col("status")))
    )
    return (
        votes.dropDuplicates([*_VOTE])
        .join(counted, ["approval_id", "voter"], "left")
        .join(closed, "approval_id", "left")
        .select(*votes.columns, F.coalesce(recorded, F.lit(False)).alias("recorded"), reason.alias("reason"))
    )


def gate_state(votes: DataFrame, gates: DataFrame) -> DataFrame:
    """Current state of each gate: status, counts of recorded votes and the time it closed."""
    closed = closings(votes, gates)
    in_time = first_votes(votes).join(closed.select("approval_id", "closed_at"), "approval_id").where(F.col("closed_at").isNull() | (F.struct(*_WHEN) <= F.col("closed_at")))
    counts = in_time.groupBy("approval_id").agg(
        F.count_if(F.col("decision") == "approve").alias("approved_count"), F.count_if(F.col("decision") == "reject").alias("rejected_count"), F.count(F.lit(1)).alias("responses")
    )
    return (
        closed.join(counts, "approval_id", "left")
        .fillna(0, ["approved_count", "rejected_count", "responses"])
        .withColumn("completed_timestamp", F.col("closed_at.event_time"))
        .drop("closed_at")
    )


def revocation_requests(requests: DataFrame, approvals: DataFrame) -> DataFrame:
    """Requests to revoke an approval, each accepted as pending or refused: only approved, ordinary gates qualify."""
    known = approvals.select("approval_id", F.col("status").alias("_status"), F.col("approval_type").alias("_type"))
    reason = (
        F.when(F.col("_status").isNull(), "unknown gate")
        .when(F.col("_status") != "approved", "not approved")
        .when(F.col("_type") == "revocation", "a revocation cannot be revoked")
        .otherwise("")
    )
    return requests.join(known, "approval_id", "left").select(*requests.columns, reason.alias("reason")).withColumn("status", F.when(F.col("reason") == "", "pending").otherwise("refused"))


def revocation_decisions(decisions: DataFrame, requests: DataFrame, votes: DataFrame) -> DataFrame:
    """First allowed decision per revocation; neither its requester nor a voter of the original gate may decide.

    ``decisions``: revocation_id, decider, decision, event_time, event_id. ``requests``: revocation_id, approval_id,
    requested_by.
    """
    asked = requests.select("revocation_id", "approval_id", "requested_by")
    voters = votes.select("approval_id", F.col("voter").alias("decider")).distinct().withColumn("_voted", F.lit(True))
    judged = (
        decisions.join(asked, "revocation_id", "left")
        .join(voters, ["approval_id", "decider"], "left")
        .withColumn(
            "_why",
            F.when(F.col("approval_id").isNull(), "unknown revocation")
            .when(~F.col("decision").isin(*GATE_DECISIONS), "invalid decision")
            .when(F.col("decider") == F.col("requested_by"), "requester may not decide")
            .when(F.col("_voted"), "original voter may not decide")
            .otherwise(""),
        )
    )
    # asking for changes leaves the revocation open, so only approve and reject can be the deciding row
    final = judged.where("_why = '' AND decision <> 'request_changes'").groupBy("revocation_id").agg(F.min(F.struct(*_WHEN)).alias("_first"))
    at = F.struct(*_WHEN)
    reason = F.when(F.col("_why") != "", F.col("_why")).when(at > F.col("_first"), "already decided").otherwise("")
    return judged.join(final, "revocation_id", "left").select(*decisions.columns, reason.alias("reason")).withColumn("recorded", F.col("reason") == "")


def enqueue_reviews(queue: DataFrame, predictions: DataFrame, as_of) -> DataFrame:
    """Queue rows for predictions that are not queued yet."""
    new = predictions.select("prediction_id", "project_id").dropDuplicates(["prediction_id"]).join(queue.select("prediction_id"), "prediction_id", "left_anti")
    return new.withColumn("presented_timestamp", instant(as_of)).withColumn("escalated", F.lit(False))


def fold_decisions(decisions: DataFrame, queue: DataFrame) -> DataFrame:
    """Every review decision with its outcome; the first valid one of a queued, undecided prediction is accepted.

    An override must carry its value. A log row delivered again is one decision and gets one outcome.
    """
    valid = F.coalesce(F.col("decision").isin(*REVIEW_DECISIONS), F.lit(False))
    complete = (F.col("decision") != "overridden") | (F.coalesce("overridden_value", F.lit("")) != "")
    winners = (
        decisions.where(valid & complete)
        .groupBy("prediction_id")
        .agg(F.min(F.struct(*_REVIEW[1:])).alias("_w"))
    )
    queued = queue.select("prediction_id", F.col("decision").alias("_held"))
    at = F.struct(*_REVIEW[1:])
    accepted = valid & complete & F.col("_queued") & F.col("_held").isNull() & (at == F.col("_w"))
    reason = (
        F.when(~valid, "invalid decision")
        .when(~complete, "override needs a value")
        .when(F.col("_queued").isNull(), "not in the review queue")
        .when(F.col("_held").isNotNull(), F.concat(F.lit("already decided ("), F.col("_held"), F.lit(")")))
        .when(accepted, "")
        .otherwise(F.concat(F.lit("already decided ("), F.col("_w.decision"), F.lit(") by "), F.col("_w.reviewer_email")))
    )
    return (
        decisions.dropDuplicates([*_REVIEW])
        .join(winners, "prediction_id", "left")
        .join(queued.withColumn("_queued", F.lit(True)), "prediction_id", "left")
        .select(*decisions.columns, F.coalesce(accepted, F.lit(False)).alias("accepted"), reason.alias("reason"))
    )


def escalate(queue: DataFrame, as_of, sla_minutes: int, per_project: DataFrame | None = None) -> DataFrame:
    """The queue with breached reviews marked; ``breached`` tells which were marked by this pass.

    Escalation never decides a review. ``per_project`` (project_id, sla_minutes) overrides the common limit.
    """
    rows = queue
    limit = F.lit(sla_minutes)
    if per_project is not None:
        rows = rows.join(per_project.select("project_id", F.col("sla_minutes").alias("_sla")), "project_id", "left")
        limit = F.coalesce("_sla", limit)
    late = F.col("presented_timestamp") < F.timestamp_add("MINUTE", -limit, instant(as_of))
    hit = F.coalesce(F.col("decision").isNull() & ~F.col("escalated") & late, F.lit(False))
    return rows.withColumn("breached", hit).withColumn("escalated", F.col("escalated") | F.col("breached")).select(*queue.columns, "breached")
