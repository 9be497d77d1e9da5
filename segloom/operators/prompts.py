"""Prompts and request bodies for the external models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from segloom.functions.text import is_blank

#: Wording the vision model is given, in this order.
CONTEXT_BEFORE = '\n\nContext from previous segment:\n"'
CONTEXT_AFTER = '"\nMaintain continuity with what was previously described.'
TRANSCRIPT_BEFORE = '\n\nAudio transcript for this segment:\n"'
TRANSCRIPT_AFTER = (
    '"\n\nUse this transcript as context to enrich your visual description. '
    "Note how the visual content relates to what is being said or heard."
)
DEFAULT_VISION_PROMPT = "Describe the visual content of these video frames in detail."


def _block(before: str, c: Column, after: str) -> Column:
    filled = F.concat(F.lit(before), c, F.lit(after))
    return F.coalesce(F.when(~is_blank(c), filled), F.lit(""))


def vision_prompt(template: Column | str, transcript: Column, context: Column) -> Column:
    """The template, then the context block, then the transcript block; a null or blank part has no block."""
    base = F.lit(template) if isinstance(template, str) else template
    return F.concat(base, _block(CONTEXT_BEFORE, context, CONTEXT_AFTER), _block(TRANSCRIPT_BEFORE, transcript, TRANSCRIPT_AFTER))


def chat_request(model: str, prompt: Column, images: Column, max_tokens: int = 4096, num_ctx: int = 65536) -> Column:
    """JSON body of one vision request: one user message, no streaming, no images key if there are none."""
    given = F.when(F.size(images) > 0, images)
    return F.to_json(
        F.struct(
            F.lit(model).alias("model"),
            F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"), given.alias("images"))).alias("messages"),
            F.lit(False).alias("stream"),
            F.struct(F.lit(max_tokens).alias("num_predict"), F.lit(num_ctx).alias("num_ctx")).alias("options"),
        )
    )
