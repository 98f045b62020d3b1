"""Commit histories as graphs, and what to index from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .traverse import checkpointed


def git_graph(commits: DataFrame, heads: DataFrame, indexes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a history.

    commits (repo, sha, parents), heads (repo, branch, sha), indexes (repo, sha, index_id).
    """
    commit = lambda sha: F.concat_ws("/", F.lit("commit"), F.col("repo").cast("string"), sha)
    head = F.concat_ws("/", F.lit("head"), F.col("repo").cast("string"), "branch")
    index = F.concat_ws("/", F.lit("index"), F.col("index_id").cast("string"))
    nodes = (
        commits.select(commit(F.col("sha")).alias("id"), F.lit("git-commit").alias("type"), F.col("sha").cast("string").alias("name"))
        .unionByName(heads.select(head.alias("id"), F.lit("git-head").alias("type"), F.col("branch").cast("string").alias("name")))
        .unionByName(indexes.select(index.alias("id"), F.lit("code-index").alias("type"), F.col("index_id").cast("string").alias("name")))
    )
    edge = lambda kind, a, b: (F.lit(kind).alias("type"), a.alias("from"), b.alias("to"))
    edges = (
        commits.select("repo", "sha", F.explode("parents").alias("parent")).select(*edge("git-commit-parent", commit(F.col("sha")), commit(F.col("parent"))))
        .unionByName(heads.select(*edge("git-head-commit", head, commit(F.col("sha")))))
        .unionByName(indexes.select(*edge("git-commit-index", commit(F.col("sha")), index)))
    )
    return nodes.distinct(), edges.distinct()


def nearest(heads: DataFrame, steps: DataFrame, goals: DataFrame, limit: int = 2000) -> DataFrame:
    """For each head (sha), the nearest goal (sha) along steps (sha, next) and its depth; ties go to the smaller sha.

    All heads move on together, a level a round, and leave when they have met a
    goal; the rounds are as many as the longest way, at most ``limit``.
    """
    goal = goals.select(F.col("sha").alias("at")).distinct()
    front = checkpointed(heads.select(F.col("sha").alias("head"), F.col("sha").alias("at")).distinct())
    seen, out, depth = front, None, 0
    while depth <= limit and not front.isEmpty():
        met = checkpointed(front.join(goal, "at", "left_semi").groupBy("head").agg(F.min("at").alias("found")).withColumn("depth", F.lit(depth)))
        out = met if out is None else out.unionByName(met)
        on = front.join(met.select("head"), "head", "left_anti").join(steps.select(F.col("sha").alias("at"), "next"), "at").select("head", F.col("next").alias("at")).distinct()
        front = checkpointed(on.join(seen, ["head", "at"], "left_anti"))
        seen = checkpointed(seen.unionByName(front))
        depth += 1
    return out if out is not None else heads.sparkSession.createDataFrame([], "head string, found string, depth int")


def index_plan(commits: DataFrame, heads: DataFrame, indexed: DataFrame, limit: int = 2000) -> DataFrame:
    """What to do for each head: ``skip`` (indexed itself), ``overlay`` on the nearest indexed ancestor, else descendant, or a ``root`` index.

    commits (sha, parents), heads (sha), indexed (sha): head, action, base, depth.
    """
    up = commits.select("sha", F.explode("parents").alias("next"))
    before = checkpointed(nearest(heads, up, indexed, limit))
    missing = heads.select("sha").distinct().join(before.select(F.col("head").alias("sha")), "sha", "left_anti")
    after = nearest(missing, up.select(F.col("next").alias("sha"), F.col("sha").alias("next")), indexed, limit)
    found = before.unionByName(after)
    action = F.when(F.col("depth") == 0, "skip").when(F.col("depth").isNotNull(), "overlay").otherwise("root")
    return heads.select(F.col("sha").alias("head")).distinct().join(found, "head", "left").select("head", action.alias("action"), F.col("found").alias("base"), "depth")


def dirty_reuse(requests: DataFrame, indexes: DataFrame) -> DataFrame:
    """Requests (repo, sha, signature) with the newest index (repo, sha, signature, created, index_id) of the same unsaved changes, if any."""
    newest = indexes.groupBy("repo", "sha", "signature").agg(F.max_by("index_id", "created").alias("index_id"))
    return requests.join(newest, ["repo", "sha", "signature"], "left")
