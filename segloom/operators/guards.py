"""Guards on generated text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segloom.functions.text import SPACES, is_blank, strip_thinking, utrim
from segloom.operators.ordered import null_safe_join

KEY_BYTES = 15
HITS = 3


def guard_repetition(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, guarded_text and was_cut: generated text cut where a sentence comes for the third time.

    Sentences are what full stops part, compared trimmed and in lower case; those under 15 bytes are kept and
    never counted. The rest from the third occurrence on is dropped, short sentences included, and the
    result is trimmed; if nothing is left the text stays as it was. Null stays null; repeated rows stay, each by itself.

    A text with fewer than two repeated sentences is settled within its row. Only the others, which are few unless
    nearly all text is broken, are taken apart and shuffled.
    """
    rows = df.select(key, F.col(text).alias("__text"))
    # Equal sentences stay equal without any white space, and lower case at most doubles their bytes: a cheap test that misses none.
    bare = lambda s: F.translate(F.lower(s), SPACES, "")
    long = F.transform(F.filter(F.split("__text", "[.]"), lambda s: F.octet_length(s) >= KEY_BYTES // 2), bare)
    repeats = F.transform(F.array(long), lambda k: F.size(k) - F.size(F.array_distinct(k)))[0]
    suspect = F.coalesce(repeats >= HITS - 1, F.lit(False))
    whole = rows.where(~suspect)
    broken = rows.where(suspect).withColumn("__mark", F.md5("__text"))
    by = [key, "__mark"]
    sentence = (
        broken.dropDuplicates(by)
        .select(*by, F.posexplode(F.split("__text", "[.]")).alias("__pos", "__s"))
        .select(*by, "__pos", F.lower(utrim(F.col("__s"))).alias("__k"))
    )
    w = Window.partitionBy(*by, "__k").orderBy("__pos")
    hits = sentence.where(F.octet_length("__k") >= KEY_BYTES).withColumn("__r", F.row_number().over(w)).where(F.col("__r") == HITS)
    cuts = hits.groupBy(*by).agg(F.min("__pos").alias("__cut"))
    joined = null_safe_join(broken, cuts, by, "left").select(key, "__text", "__cut")
    both = whole.withColumn("__cut", F.lit(None).cast("int")).unionByName(joined)
    kept = F.when(
        F.col("__cut").isNotNull(), F.array_join(F.slice(F.split("__text", "[.]"), 1, F.col("__cut")), ".")
    ).otherwise(F.col("__text"))
    trimmed = utrim(kept)
    return both.select(
        key,
        F.when(F.octet_length(trimmed) == 0, F.col("__text")).otherwise(trimmed).alias("guarded_text"),
        F.col("__cut").isNotNull().alias("was_cut"),
    )


def answer_of(content):
    """(text, error) of a vision answer: thinking removed, or its inside if nothing else is left; blank is an error."""
    answer = strip_thinking(content)
    inside = utrim(F.regexp_replace(content, "</?think>", ""))
    text = F.when(F.octet_length(answer) > 0, answer).when(F.octet_length(inside) > 0, inside)
    error = (
        F.when(content.isNull(), F.lit("vision model error: response has no message content"))
        .when(is_blank(content), F.lit("vision model error: empty response"))
        .when(text.isNull(), F.lit("vision model error: response holds no text"))
    )
    return F.when(error.isNull(), text), error


def parse_vision_response(df: DataFrame, body: str = "body") -> DataFrame:
    """Adds content and error for JSON answers of the vision model; extra keys are ignored."""
    parsed = F.from_json(F.col(body), "message struct<content: string>")
    text, error = answer_of(F.col("__content"))
    return df.withColumn("__content", parsed["message"]["content"]).withColumn("content", text).withColumn("error", error).drop("__content")


RESPONSES_SCHEMA = "output array<struct<type: string, content: array<struct<type: string, text: string>>>>"
CHAT_SCHEMA = "choices array<struct<message: struct<role: string, content: string>>>"


def responses_text(body):
    """Output text of a stored-prompt answer: message items, their output_text parts, parted by blank lines."""
    output = F.from_json(body, RESPONSES_SCHEMA)["output"]
    messages = F.filter(output, lambda o: o["type"] == "message")
    items = F.filter(F.flatten(F.transform(messages, lambda o: o["content"])), lambda c: c["type"] == "output_text")
    return F.array_join(F.transform(items, lambda c: c["text"]), "\n\n")


def chat_text(body):
    """Text of the first choice of a chat answer, or the empty string."""
    return F.coalesce(F.get(F.from_json(body, CHAT_SCHEMA)["choices"], F.lit(0))["message"]["content"], F.lit(""))


def model_present(names, model: str):
    """True if any installed model's name starts with the configured one."""
    return F.exists(names, lambda n: F.startswith(n, F.lit(model)))
