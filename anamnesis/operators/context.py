"""Filling token budgets of prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import allowed_for_provider

#: Shares of a context window in per cent.
SHARES = {"system_prompt": 5, "echo_memories": 15, "rag_context": 20, "conversation": 35, "response_reserve": 25}
#: Characters that the framing of a segment costs besides its source or role.
OVERHEADS = {"echo": 20, "rag": 10, "conversation": 5}
MAX_TURNS, MAX_RAG, MAX_ECHO = 20, 5, 10


def budgets(total: Column, n_echo: Column) -> dict[str, Column]:
    """Tokens of each part; beyond five memories one per cent each moves from conversation to memories, ten at most."""
    out = {k: F.floor(total * share / 100) for k, share in SHARES.items()}
    shift = F.floor(total * F.least(F.greatest(n_echo - 5, F.lit(0)), F.lit(10)) / 100)
    shift = F.when(out["conversation"] > shift, shift).otherwise(0)
    out["conversation"], out["echo_memories"] = out["conversation"] - shift, out["echo_memories"] + shift
    return out


def conversation_budget(total: Column) -> Column:
    fixed = [F.floor(total * share / 100) for k, share in SHARES.items() if k != "conversation"]
    return F.greatest(total - fixed[0] - fixed[1] - fixed[2] - fixed[3], F.lit(0))


def newest_turns(turns: DataFrame, budget: Column, overhead: int = OVERHEADS["conversation"], most: int = MAX_TURNS) -> DataFrame:
    """Turns from the newest back until the first that does not fit. turns(conv_id, turn, role, text); tokens and used are added."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    framed = F.octet_length(F.coalesce(F.col("role"), F.lit(""))) + F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + overhead
    rows = turns.withColumn("tokens", F.ceil(framed / 4).cast("long"))
    rows = rows.withColumns({"used": F.sum("tokens").over(back.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.row_number().over(back)})
    return rows.where((F.col("used") <= budget) & (F.col("_n") <= most)).drop("_n")


def greedy_fill(rows: DataFrame, budget: int, group: str, most: int) -> DataFrame:
    """Rows in order that fit what is left; one too large is skipped and later ones may fit. rows(group, place, tokens)."""
    head = rows.where(F.col("place") <= most)
    lists = head.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("place", "tokens"))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("kept"))

    def step(acc, x):
        fits = acc["used"] + x["tokens"] <= budget
        return F.struct(F.when(fits, acc["used"] + x["tokens"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["kept"], F.array(x["place"].cast("bigint")))).otherwise(acc["kept"]).alias("kept"))

    kept = lists.select(group, F.explode(F.aggregate("items", start, step)["kept"]).alias("place"))
    return head.join(kept, [group, "place"], "left_semi")


def filtered_for_provider(results: DataFrame, rows: DataFrame, local: Column) -> DataFrame:
    """results(id) that a provider may be sent, by the sensitivity of rows(id, sensitivity); rows that are not known are public."""
    told = rows.select("id", F.col("sensitivity").alias("_s"))
    return results.join(told, "id", "left").where(allowed_for_provider(F.col("_s"), local)).drop("_s")


def priority(kind: Column) -> Column:
    """In what order segments give way when a prompt is too long: 0 never."""
    return F.when(kind.isin("system", "query"), 0).when(kind == "echo", 1).when(kind == "rag", 2).otherwise(3)


def last_user_message(turns: DataFrame) -> DataFrame:
    """conv_id, text of each conversation's last user turn."""
    return turns.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


def memory_block(rows: DataFrame, group: str) -> DataFrame:
    """The texts of rows(group, rank, content) as one block of lines."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: F.concat(F.lit("- "), x["content"]))
    return rows.groupBy(group).agg(F.array_join(lines, "\n").alias("block"))


def injected(messages: DataFrame, blocks: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, text) with each block appended to the first system message, or as one before the first turn."""
    first = messages.where("role = 'system'").groupBy("conv_id").agg(F.min("turn").alias("_at"))
    joined = messages.join(first, "conv_id", "left").join(blocks, "conv_id", "left")
    text = F.when((F.col("turn") == F.col("_at")) & F.col("block").isNotNull(), F.concat_ws("\n", "text", "block")).otherwise(F.col("text"))
    own = joined.select("conv_id", "turn", "role", text.alias("text"))
    alone = blocks.join(first, "conv_id", "left_anti").join(messages.groupBy("conv_id").agg((F.min("turn") - 1).alias("turn")), "conv_id")
    return own.unionByName(alone.select("conv_id", "turn", F.lit("system").alias("role"), F.col("block").alias("text")))


def assembled(segments: DataFrame, budget: Column) -> DataFrame:
    """What stays of prompts that are over their budget: the oldest conversation goes first, then the last documents.

    segments(prompt_id, kind, place, tokens); kinds system, echo and query always stay.
    """
    rank = F.when(F.col("kind") == "conversation", 2).when(F.col("kind") == "rag", 1).otherwise(0)
    # in the order of staying: fixed parts, documents from the first, conversation from the newest
    order = F.when(F.col("kind") == "conversation", -F.col("place")).otherwise(F.col("place"))
    walk = Window.partitionBy("prompt_id").orderBy(rank, order, "kind").rowsBetween(Window.unboundedPreceding, 0)
    return segments.withColumn("used", F.sum("tokens").over(walk)).where((rank == 0) | (F.col("used") <= budget)).drop("used")
