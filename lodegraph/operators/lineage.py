"""Revision lineages, snapshots and jobs ordered in time.

Latest-of questions are aggregates (map-side combined), never whole-group
windows; sequence numbers use ranked(), which splits long lineages by date.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.roles import first_match
from lodegraph.operators.ranking import first_per_key, last_per_key, ranked


def latest_sealed(snapshots: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Newest sealed snapshot per repository; on equal times the smaller id."""
    done = snapshots.where("state = 'completed' AND sealed_at IS NOT NULL")
    order = [-F.unix_micros(F.col("sealed_at")), F.col("snapshot_id")]
    return first_per_key(done, [key], order, columns)


# The forms of revisions that belong to a lineage.
COMMIT = "^[0-9a-f]{40}$"
REFERENCE = "^refs/(?:heads|tags)/[A-Za-z0-9._/-]+$"
SOURCES = (
    r"^https://(?i:github\.com)/([^/\n]+)/([^/\n]+?)(?:\.git)?/?$",
    r"^git@(?i:github\.com):([^/\n]+)/([^/\n]+?)(?:\.git)?$",
)
SAFE = "^[A-Za-z0-9._-]+$"


def source_key(url) -> Column:
    """``github.com/owner/name`` in lower case of an address in one of the accepted forms; else null."""
    url = F.btrim(url if isinstance(url, Column) else F.col(url), F.lit(" \t\n\r\x0b\x0c"))
    keys = []
    for form in SOURCES:
        owner, name = F.regexp_extract(url, form, 1), F.regexp_extract(url, form, 2)
        safe = owner.rlike(SAFE) & name.rlike(SAFE) & ~owner.contains("..") & ~name.contains("..")
        keys.append(F.when(safe, F.lower(F.concat(F.lit("github.com/"), owner, F.lit("/"), name))))
    return F.coalesce(*keys)


def eligible(revisions: DataFrame) -> DataFrame:
    """Revisions that may join a lineage, with their ``source_key``.

    ``revisions``: source, source_url, revision_kind, revision_value, revision_ref and others.  Only git commits of
    a parsable source on a branch or tag belong to one; all others stand alone.
    """
    fits = (
        (F.col("source") == "github")
        & (F.col("revision_kind") == "git")
        & F.col("revision_value").rlike(COMMIT)
        & F.col("revision_ref").rlike(REFERENCE)
    )
    return revisions.where(fits).withColumn("source_key", source_key("source_url")).where("source_key IS NOT NULL")


def sequence_lineages(
    revisions: DataFrame, keys: list[str], time: str, tie: str, name: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(members, lineages).

    Members get ``sequence_no`` from 1 in (time, tie) order.  Lineages get the latest and
    first member and the next number, and with ``name`` the first member's name for display.
    """
    month = F.date_trunc("month", F.col(time))
    members = ranked(revisions, keys, [F.col(time), F.col(tie)], month, "sequence_no")
    lineages = revisions.groupBy(*keys).agg(
        F.max(F.struct(time, tie))[tie].alias("latest"),
        F.min(F.struct(time, tie))[tie].alias("first"),
        (F.count(F.lit(1)) + 1).alias("next_sequence"),
        *([F.min(F.struct(time, tie, name))[name].alias("display_name")] if name else []),
    )
    return members, lineages


def history(members: DataFrame, lineages: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Members with an ``is_current`` flag; rows without a lineage are a history of one."""
    marked = members.join(lineages.select(*keys, "latest"), keys, "left")
    current = F.col("latest").isNull() | (F.col("latest") == F.col(tie))
    return marked.withColumn("is_current", current).drop("latest")


def after_delete(members: DataFrame, lineages: DataFrame, deleted: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Lineages after deleting members: the latest pointer falls back, an empty lineage keeps a null one."""
    kept = members.join(deleted.select(tie), tie, "left_anti")
    latest = kept.groupBy(*keys).agg(F.max(F.struct("sequence_no", tie))[tie].alias("latest"))
    return lineages.drop("latest").join(latest, keys, "left")


def duplicate_revisions(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose owner already holds the same revision."""
    return incoming.join(stored.select(*keys).distinct(), keys, "left_semi")


def reuse_completed(requests: DataFrame, completed: DataFrame, identity: list[str], snapshot: str) -> DataFrame:
    """Requests with the completed snapshot of the same semantic identity, if any."""
    one = completed.groupBy(*identity).agg(F.min(snapshot).alias("reused_id"))
    return requests.join(one, identity, "left").withColumn("reused", F.col("reused_id").isNotNull())


ACTIVE = ("queued", "running")


def job_views(jobs: DataFrame, key: str) -> DataFrame:
    """Latest job, latest active one, and latest one that still stands for the repository (not failed)."""
    when, status = F.struct("created_at", "job_id"), F.col("status")
    return jobs.groupBy(key).agg(
        F.max(when)["job_id"].alias("latest_job"),
        F.max(F.when(status.isin(*ACTIVE), when))["job_id"].alias("active_job"),
        F.max(F.when(status.isin(*ACTIVE, "completed"), when))["job_id"].alias("effective_job"),
    )


def backlog(jobs: DataFrame, now: Column) -> DataFrame:
    """Queued jobs whose next attempt is due, to be read in ``created_at`` order."""
    due = F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)
    return jobs.where((F.col("status") == "queued") & due)


def next_per_owner(jobs: DataFrame, now: Column, key: str) -> DataFrame:
    """Oldest due job of each owner."""
    return first_per_key(backlog(jobs, now), [key], [F.col("created_at"), F.col("job_id")], ["job_id"])


def expired_leases(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs whose lease has lapsed."""
    return jobs.where((F.col("status") == "running") & (F.col("lease_expires_at") < now))


def triage(submissions: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    """Decide each submission: reuse a completed result, return the active job, else enqueue."""
    known = jobs.groupBy(key).agg(
        F.max(F.when(F.col("status") == "completed", F.struct("created_at", "job_id")))["job_id"].alias("completed_job"),
        F.max(F.when(F.col("status").isin(*ACTIVE), F.struct("created_at", "job_id")))["job_id"].alias("active_job"),
    )
    joined = submissions.join(known, key, "left")
    return joined.withColumn(
        "action",
        first_match(
            [
                (F.col("completed_job").isNotNull(), F.lit("reuse")),
                (F.col("active_job").isNotNull(), F.lit("return_active")),
            ],
            F.lit("enqueue"),
        ),
    ).withColumn("job_id", F.coalesce("completed_job", "active_job"))


def append_turns(stored: DataFrame, incoming: DataFrame, keys: list[str], order: str, granule: Column) -> DataFrame:
    """Number incoming turns after the stored ones: base is max + 1, or 0 for a new conversation."""
    base = stored.groupBy(*keys).agg((F.max("sequence_no") + 1).alias("_base"))
    placed = ranked(incoming, keys, [F.col(order)], granule, "_rn")
    return (
        placed.join(base, keys, "left")
        .withColumn("sequence_no", F.coalesce("_base", F.lit(0)) + F.col("_rn") - 1)
        .drop("_base", "_rn")
    )


def reanalysis(latest: DataFrame, heads: DataFrame, key: str) -> DataFrame:
    """Compare each lineage's latest revision with the remote head."""
    joined = latest.join(heads, key)
    same = F.col("revision_value").eqNullSafe(F.col("head_value"))
    return joined.withColumn("outcome", F.when(same, "already-current").otherwise("revision-imported"))


def last_member(members: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return last_per_key(members, keys, [F.col("sequence_no")], columns)
