"""Prompts for follow-up questions about assessed applications."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lendlane.operators.chat import followup_prompt
from lendlane.operators.guards import chat_guard
from lendlane.operators.history import chat_history
from lendlane.plans.assess import customer_input, factors_for_prompt


def followup_prompts(turns: DataFrame, assessed: DataFrame, key: str) -> DataFrame:
    """One row per conversation for its open question, the last user turn, with the turns before it as history.

    `key` links a conversation to its application. A blocked question has a
    refusal and no prompts. A first question has an empty history; a
    conversation without an assessment has an empty record in its prompt.
    """
    asked = turns.where(F.col("role") == "user").groupBy(key).agg(
        F.max("turn").alias("asked_turn"), F.max_by("text", "turn").alias("question"))
    earlier = turns.join(asked.select(key, "asked_turn"), key).where(F.col("turn") < F.col("asked_turn"))
    facts = assessed.select(
        key, customer_input(assessed).alias("customer_json"), "decision", "confidence",
        factors_for_prompt().alias("factors"),
    )
    joined = asked.join(chat_history(earlier, conversation=key), key, "left").join(facts, key, "left")
    known = lambda name, otherwise: F.coalesce(F.col(name), F.lit(otherwise))
    # How an absent record and an absent value are written in a prompt.
    system, user = followup_prompt(
        known("customer_json", "{}"), known("decision", "None"), known("confidence", "None"), known("factors", "None"),
        known("history", ""), F.col("question"),
    )
    guarded = joined.withColumn("refusal", chat_guard(F.col("question")))
    open_ = F.col("refusal").isNull()
    return guarded.select(key, "refusal", F.when(open_, system).alias("system_prompt"), F.when(open_, user).alias("user_prompt"))
