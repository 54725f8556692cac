"""Screening of what comes in and cleaning of what goes out."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lendlane.functions.numbers import above, strict_float
from lendlane.functions.text import literals, strip
from lendlane.operators.applicants import FIELD_ORDER, Applicants

# Phrases that block an application, in the order they are tried.
BLOCKED_PHRASES = [
    "ignore.*rules",
    "ignore.*policy",
    "bypass.*checks",
    "bypass.*validation",
    "approve.*anyway",
    "eligible.*anyway",
    "override.*system",
    "fake.*salary",
    "fake.*document",
    "use.*fabricated",
    "manipulate.*score",
    "system.*prompt",
    "you are now an approval agent",
    "ignore all instructions",
    "set.*decision",
    "bypass.*rules",
]
# Phrases that block a follow-up question.
BLOCKED_CHAT_PHRASES = [
    "ignore.*rules",
    "ignore.*policy",
    "bypass.*checks",
    "approve.*anyway",
    "override.*system",
    "ignore all instructions",
    "you are now",
    "system.*prompt",
    "set.*decision",
]
# Promises that are softened in outgoing text, in the order they are replaced.
PROMISES = [
    "definitely.*approved",
    "guarantee.*approval",
    "guaranteed.*loan",
    "will.*definitely.*get",
    "absolutely.*approved",
]
SOFTENED = "subject to credit verification and formal approval"
# Every promise holds one of these words, and the softened wording holds none.
_PROMISE_WORDS = ["definitely", "guarantee", "absolutely"]
# Fixed value: the one letter that counts as an s when case is ignored but that lower-casing leaves as it is.
_LONG_S = "\u017f"

# Wording.
DISCLAIMER = (
    "This is an AI-generated informational assessment for decision-support purposes only. "
    "It does not constitute a final credit approval. All decisions must be verified by "
    "an authorized banking officer in accordance with institutional policy."
)
SHORT_DISCLAIMER = (
    "\n\n*This is an AI-generated response for decision-support only. "
    "It does not constitute a final credit approval.*"
)
CHAT_REFUSAL = (
    "Input Guardrail Triggered: Your message was flagged for attempting to "
    "override system policies. Please ask a legitimate question about your loan assessment."
)
MESSAGE_REASON = "Input Guardrail Violation: Conversation flagged for rule override attempts."
INCOME_REASON = "Input Guardrail Violation: Monthly income exceeds plausible verification thresholds."
INCOME_LIMIT = 10_000_000.0
NO_REPORT = "System generated report unavailable."


def line_bound(pattern: str) -> str:
    """`.` must stop at a line feed and at nothing else; Java's also stops at carriage returns."""
    return pattern.replace(".*", r"[^\n]*")


def any_of(patterns) -> str:
    return "(" + "|".join(line_bound(p) for p in patterns) + ")"


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def holds_any(lowered: Column, patterns) -> Column:
    """Whether a lower-case text matches one of the patterns.

    Where patterns are plain words parted by `.*`, a text without the words
    cannot match: it is cleared by plain searches, and the regular expressions
    run only over the few texts that hold the words of a pattern.
    """
    confirmed = F.rlike(lowered, F.lit(any_of(patterns)))
    if not all(re.fullmatch(r"[\w ]+(\.\*[\w ]+)*", p) for p in patterns):
        return confirmed
    words = [[F.contains(lowered, F.lit(w)) for w in p.split(".*")] for p in patterns]
    return _any([reduce(lambda a, b: a & b, w) for w in words]) & confirmed


def input_guard(df: DataFrame, fields: Column, joined: Column, message: Column, income: Column,
                patterns=BLOCKED_PHRASES) -> DataFrame:
    """Add `blocked` and `reason`.

    `fields` is an array of (name, value) to screen in order; `joined` holds the
    same values parted by line feeds. No phrase crosses a line feed, so one
    search over `joined` clears a clean row, and only rows that hit are looked
    at field by field: the first field that holds a phrase, then the first
    phrase in it.
    """
    lowered = df.withColumns({"g_joined": F.lower(joined), "g_said": F.lower(F.coalesce(message, F.lit("")))})
    hits = lowered.withColumns({
        "g_hit": holds_any(F.col("g_joined"), patterns), "g_said_hit": holds_any(F.col("g_said"), patterns),
    })
    # Steps of their own, so that the field is found once and not again for every phrase.
    first = F.filter(fields, lambda f: F.rlike(F.lower(f.getField("value")), F.lit(any_of(patterns)))).getItem(0)
    found = hits.withColumn("g_field", F.when(F.col("g_hit"), first)).withColumn(
        "g_value", F.lower(F.col("g_field").getField("value"))
    )
    phrase = F.when(F.rlike(F.col("g_value"), F.lit(line_bound(patterns[0]))), patterns[0])
    for p in patterns[1:]:
        phrase = phrase.when(F.rlike(F.col("g_value"), F.lit(line_bound(p))), p)
    reason = (
        F.when(F.col("g_hit"), F.concat(
            F.lit("Input Guardrail Violation: Flagged content in '"), F.col("g_field").getField("name"),
            F.lit("' field matching pattern '"), phrase, F.lit("'."),
        ))
        .when(F.col("g_said_hit"), MESSAGE_REASON)
        .when(above(income, INCOME_LIMIT), INCOME_REASON)
        .otherwise("")
    )
    return found.withColumn("reason", reason).withColumn("blocked", F.col("reason") != "").drop(
        "g_joined", "g_said", "g_hit", "g_said_hit", "g_field", "g_value"
    )


def check_applicants(df: DataFrame, patterns=BLOCKED_PHRASES, enabled: bool = True) -> DataFrame:
    """Screen the text fields, then the message, then the income of a table of applications."""
    if not enabled:
        return df.withColumns({"reason": F.lit(""), "blocked": F.lit(False)})
    a = Applicants(df)
    named = [n for n in FIELD_ORDER if a.is_text(n) or a.is_variant(n)]
    fields = F.array(*[F.struct(F.lit(n).alias("name"), a.said(n).alias("value")) for n in named])
    joined = F.concat_ws("\n", *[a.said(n) for n in named])
    return input_guard(df, fields, joined, a.text("user_message"), a.decimal("monthly_income"), patterns)


def check_json_batch(df: DataFrame, customer_data: str = "customer_data", user_message: str = "user_message") -> DataFrame:
    """Screen JSON payloads: the top-level text values in the order the payload gives them.

    A payload that is not a JSON object counts as empty. Numbers, nested values
    and so on are not screened, so each value's JSON type is looked at.
    """
    parsed = df.withColumn("g_values", F.map_entries(F.from_json(F.col(customer_data), "map<string,variant>")))
    kind = lambda e: F.schema_of_variant(e.getField("value"))
    text = lambda e: F.try_variant_get(e.getField("value"), "$", "string")
    entries = F.coalesce(
        F.transform(
            F.filter(F.col("g_values"), lambda e: kind(e) == "STRING"),
            lambda e: F.struct(e.getField("key").alias("name"), text(e).alias("value")),
        ),
        F.array().cast(T.ArrayType(T.StructType([
            T.StructField("name", T.StringType()), T.StructField("value", T.StringType())
        ]))),
    )
    stated = F.filter(F.col("g_values"), lambda e: e.getField("key") == "monthly_income")
    income = F.when(F.size(stated) > 0, strict_float(text(F.element_at(stated, -1))))
    listed = parsed.withColumns({"g_entries": entries, "g_income": income})
    joined = F.array_join(F.transform(F.col("g_entries"), lambda e: e.getField("value")), "\n")
    out = input_guard(listed, F.col("g_entries"), joined, F.col(user_message), F.col("g_income"))
    return out.drop("g_values", "g_entries", "g_income")


def chat_guard(query: Column, patterns=BLOCKED_CHAT_PHRASES, enabled: bool = True) -> Column:
    """The refusal text for a blocked follow-up question; NULL for any other."""
    if not enabled:
        return F.lit(None).cast("string")
    return F.when(holds_any(F.lower(query), patterns), CHAT_REFUSAL)


def with_softened(df: DataFrame, text: Column, output: str) -> DataFrame:
    """Add `text` with its promises replaced, one kind after the other.

    Texts without a telling word, nearly all, pass untouched by the expressions.
    """
    read = df.withColumn("s_text", text).withColumn("s_lower", F.lower("s_text"))
    telling = _any([F.contains(F.col("s_lower"), F.lit(w)) for w in _PROMISE_WORDS] + [F.contains(F.col("s_text"), F.lit(_LONG_S))])
    softened = F.col("s_text")
    for p in PROMISES:
        softened = F.regexp_replace(softened, "(?iu)" + line_bound(p), SOFTENED)
    return read.withColumn(output, F.when(telling, softened).otherwise(F.col("s_text"))).drop("s_text", "s_lower")


def clean_output(df: DataFrame, reasoning: str = "reasoning", decision: str = "decision",
                 disclaimer: str = "disclaimer", enabled: bool = True) -> DataFrame:
    """Fill in what an outgoing result lacks, soften promises, force the disclaimer.

    Adds `guardrail_status`, 'Sanitized' where a promise was replaced, else NULL.
    """
    if not enabled:
        return df
    have = set(df.columns)
    given = lambda n: F.col(n) if n in have else F.lit(None).cast("string")
    filled = df.withColumns({
        decision: F.coalesce(given(decision), F.lit("Not Eligible")),
        "g_reasoning": F.coalesce(given(reasoning), F.lit(NO_REPORT)),
        disclaimer: F.when(F.contains(given(disclaimer), F.lit(DISCLAIMER)), given(disclaimer)).otherwise(DISCLAIMER),
    })
    cleaned = with_softened(filled, F.col("g_reasoning"), reasoning)
    status = F.when(F.col(reasoning) != F.col("g_reasoning"), "Sanitized")
    return cleaned.withColumn("guardrail_status", status).drop("g_reasoning")


def clean_chat(df: DataFrame, response: Column, output: str = "response", enabled: bool = True) -> DataFrame:
    """Add a chat answer with promises softened, and the short disclaimer where it has none."""
    if not enabled:
        return df.withColumn(output, response)
    softened = with_softened(df, response, output)
    has_disclaimer = F.contains(F.lower(output), F.lit("does not constitute"))
    return softened.withColumn(output, F.concat(output, F.when(has_disclaimer, "").otherwise(SHORT_DISCLAIMER)))


# How a full report is told from a question back to the applicant.
REPORT_MARKER = "### 1. Eligibility Result"
REPORT_LENGTH = 80


def is_full_report(text: Column) -> Column:
    return F.contains(text, F.lit(REPORT_MARKER)) & (F.length(strip(text)) >= REPORT_LENGTH)
