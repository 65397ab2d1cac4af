"""Line-based sources: JSONL conversations, training logs, key-value reports, word lists, synthetic documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.ids import pick

MESSAGES = "array<struct<role:string,content:string>>"


def conversations(lines: DataFrame, column: str = "value") -> DataFrame:
    """line, messages and problem of each non-blank JSON line (a list of role and content); problem is null for a valid one.

    Valid: two messages or more, user and assistant in turn from user on, contents that are strings.
    """
    line = F.trim(F.col(column))
    parsed = lines.where(line != "").withColumn("messages", F.from_json(line, MESSAGES))
    return parsed.withColumn("problem", conversation_problem(F.col("messages")))


def conversation_problem(messages: Column, system: bool = False) -> Column:
    """The first problem of a conversation, or null. With ``system`` a leading system message is let through."""
    body = F.when(F.element_at(messages, 1)["role"] == "system", F.slice(messages, F.lit(2), F.size(messages))).otherwise(messages) if system else messages
    turn = lambda m, i: m["role"] != F.when(i % 2 == 0, "user").otherwise("assistant")
    wrong = F.size(F.filter(F.transform(body, lambda m, i: turn(m, i)), lambda x: F.coalesce(x, F.lit(True)))) > 0
    return (
        F.when(messages.isNull(), "not_json")
        .when(F.size(body) < 2, "too_short")
        .when(wrong, "roles")
        .when(F.exists(body, lambda m: m["content"].isNull()), "content")
    )


def log_values(lines: DataFrame, keys: dict[str, str], line: str = "value", number: str = "line_no") -> DataFrame:
    """key and value for each key whose pattern (one group) matches a line; the last match by line number wins, commas go."""
    hits = None
    for key, pattern in keys.items():
        one = lines.where(F.col(line).rlike(pattern)).select(F.lit(key).alias("key"), F.regexp_replace(F.regexp_extract(line, pattern, 1), ",", "").alias("value"), F.col(number).alias("n"))
        hits = one if hits is None else hits.unionByName(one)
    return hits.groupBy("key").agg(F.max_by("value", "n").alias("value"))


def key_values(lines: DataFrame, keys: list[str], line: str = "value", number: str = "line_no") -> DataFrame:
    """key and value of ``key: value`` lines: a key counts wherever it stands in the line, the value is what follows the first colon up to a next."""
    exploded = lines.withColumn("key", F.explode(F.array(*map(F.lit, keys)))).where(F.col(line).contains(F.col("key")))
    value = F.trim(F.split_part(F.col(line), F.lit(":"), F.lit(2)))
    return exploded.groupBy("key").agg(F.max_by(value, number).alias("value"))


def words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("word"))


#: Vocabulary of the synthetic documents; any other will do.
TOPICS = ("The river", "A small market", "The old library", "The night train", "A quiet harbour", "The stone bridge", "The north road", "A winter garden")
ACTIONS = ("opens before dawn", "draws visitors", "keeps its own records", "closes in the rain", "serves the valley", "stands near the mill", "changes with the season")
TAILS = ("as it has for years", "without much notice", "in most accounts", "whatever the weather", "for those who ask")


def synthetic_documents(spark: SparkSession, n: int, chars: int, seed: int = 0) -> DataFrame:
    """``n`` documents (pos, text) of ``chars`` characters or a little more, the same in every run and partitioning."""
    each = 45
    sentence = lambda i: F.concat(pick(TOPICS, seed, "topic", F.col("pos"), i), F.lit(" "), pick(ACTIONS, seed, "action", F.col("pos"), i), F.lit(" "), pick(TAILS, seed, "tail", F.col("pos"), i), F.lit("."))
    count = max(1, -(-chars // each))
    return spark.range(n).select(F.col("id").alias("pos")).select("pos", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), sentence), " ").alias("text"))


#: Characters that a synthetic document of a shard has at least.
LEAST_CHARS = 200


def synthetic_shard(spark: SparkSession, index: int, chars: int, docs: int, seed: int = 0) -> DataFrame:
    """pos and text of a synthetic shard: documents of ``chars / docs`` characters or a little more, until there are ``chars``.

    The last document is the one that takes the shard to ``chars`` or over it.
    """
    each = max(LEAST_CHARS, chars // max(1, docs))
    from textloom.operators.ranking import running_sum

    made = synthetic_documents(spark, max(1, -(-chars // each)), each, seed * 1_000_003 + index + 1)
    sized = running_sum(made.withColumn("chars", F.length("text").cast("long")), "pos", "chars")
    return sized.where(F.col("before") < chars).select("pos", "text")
