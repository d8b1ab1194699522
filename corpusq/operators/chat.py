"""Chat-log operators over (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def session_stats(m: DataFrame) -> DataFrame:
    return m.groupBy("conv_id").agg(F.count(F.lit(1)).alias("message_count"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


def last_turns(m: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return m.withColumn("k", F.row_number().over(w)).where(F.col("k") <= 2 * n).select("conv_id", "turn", "role", "text")


def history_block(m: DataFrame, n: int = 6) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.initcap("role"), F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"))))
    return last_turns(m, n).groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x.line), "\n").alias("history"))


def derive_title(m: DataFrame) -> DataFrame:
    first = m.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", F.trim(F.substring("text", 1, 80)).alias("title"))


def list_sessions(sessions: DataFrame, limit: int, offset: int = 0, agent: int | str | None = None) -> DataFrame:
    """A page of the sessions (conv_id, agent, updated), latest first, each row with how many there are in all."""
    d = sessions if agent is None else sessions.where(F.col("agent") == agent)
    total = d.agg(F.count(F.lit(1)).alias("total"))
    return d.orderBy(F.desc("updated"), "conv_id").offset(offset).limit(limit).join(F.broadcast(total))  # one row


def get_messages(m: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of each session's messages, oldest first."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return m.withColumn("_k", F.row_number().over(w)).where((F.col("_k") > offset) & (F.col("_k") <= offset + limit)).drop("_k")


def latest(rows: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """One row per key, the latest; combined before the shuffle."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def session_with_feedback(sessions: DataFrame, m: DataFrame, feedback: DataFrame) -> DataFrame:
    """Sessions with their messages and the rating of each, null where there is none."""
    return sessions.join(m, "conv_id", "left").join(feedback, ["conv_id", "turn"], "left")


def delete_sessions(ids: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """The tables without what belongs to the sessions."""
    return [t.join(ids.select("conv_id").distinct(), "conv_id", "left_anti") for t in tables]


def update_field(rows: DataFrame, updates: DataFrame, keys: list[str], field: str) -> DataFrame:
    """Rows with the field replaced where there is an update for their key."""
    new = updates.select(*keys, F.col(field).alias("_new"))
    return rows.join(new, keys, "left").withColumn(field, F.coalesce("_new", field)).drop("_new")


def config_snapshot(sessions: DataFrame, configs: DataFrame, temperature: float = 0.7, top_k: int = 5) -> DataFrame:
    """(agent, at, conv_id) with the agent's latest config (agent, at, temperature, top_k) no later than the session, with
    defaults for what it leaves out. Both are put in one order of time per agent, so no pairs are made."""
    both = configs.select("agent", "at", F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("conv_id"), F.struct("temperature", "top_k").alias("_c")).unionByName(
        sessions.select("agent", "at", F.lit(1).alias("_kind"), "conv_id", F.lit(None).cast("struct<temperature:double,top_k:int>").alias("_c"))
    )
    seen = F.last("_c", ignorenulls=True).over(Window.partitionBy("agent").orderBy("at", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    d = both.withColumn("_seen", seen).where("_kind = 1")
    return d.select("conv_id", "agent", F.coalesce("_seen.temperature", F.lit(temperature)).alias("temperature"), F.coalesce("_seen.top_k", F.lit(top_k)).alias("top_k"))


#: Headings of a prompt's parts.
HISTORY, CONTEXT, QUESTION = "Conversation so far:", "Context:", "Question:"


def build_prompt(rows: DataFrame, default: str = "Answer the question from the context alone.") -> DataFrame:
    """(query_id, agent_prompt, history, context, question) -> prompt: the agent's own or the default instruction, then
    history, context and question, each where there is one."""
    part = lambda name, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{name}\n"), F.col(c)))
    first = F.coalesce(F.nullif("agent_prompt", F.lit("")), F.lit(default))
    return rows.select("query_id", F.concat_ws("\n\n", first, part(HISTORY, "history"), part(CONTEXT, "context"), part(QUESTION, "question")).alias("prompt"))
