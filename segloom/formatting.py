"""Timelines as Markdown through a chat model."""

from __future__ import annotations

import json
from collections.abc import Callable

from segloom.errors import ClientError
from segloom.operators.sections import SECTION_TOKENS, SEGMENT_OVERHEAD, fill_sections

#: What later sections are told, around the first section's header.
CONTINUATION_BEFORE = (
    "You are continuing a video transcript document. "
    "Here is the summary and character identification from the first section:\n\n"
)
CONTINUATION_AFTER = (
    "\n\nNow continue the scene-by-scene transcript for the next batch of segments.\n\n"
    "Rules:\n"
    "- Do NOT repeat the summary or character identification\n"
    "- Do NOT re-introduce characters — they are already established\n"
    "- Continue scene numbering from where the previous section left off\n"
    "- Only describe what is in the segments provided — do not fabricate or infer beyond the data\n"
    "- Maintain the same writing style and format as the previous section\n"
    "- Start directly with the next scene heading\n"
    "- IMPORTANT: Group consecutive segments into coherent SCENES based on visual context, "
    "not raw segment boundaries. Multiple segments sharing the same chart, setting, or topic "
    "belong in ONE scene with a descriptive heading. Do NOT create one scene per segment."
)
HEADER_CHARS = 2000
Post = Callable[[str, dict, dict, float], dict]


def header_of(text: str) -> str:
    """All before the first scene heading, or the first 2,000 characters."""
    at = text.find("## Scene")
    return text[:at] if at >= 0 else text[:HEADER_CHARS]


def sections_of(timeline: dict, budget: int = SECTION_TOKENS) -> list[dict]:
    """The timeline in parts of bounded size, each a timeline of its own."""
    segments = timeline["segments"]
    placed = fill_sections([len(s["content"].encode()) // 4 + SEGMENT_OVERHEAD for s in segments], budget)
    parts: list[dict] = []
    for section, segment in zip(placed, segments, strict=True):
        if section == len(parts):
            parts.append(timeline | {"segments": []})
        parts[section]["segments"].append(segment)
    return parts


class ChatFormatter:
    """Calls of the chat and the stored-prompt endpoint; an empty answer is an error, nothing is tried again."""

    def __init__(self, endpoint: str, key: str, model: str, max_tokens: int, post: Post, timeout: float = 600):
        if not key:
            raise ClientError("no API key is set")
        self.endpoint, self.model, self.max_tokens, self.post, self.timeout = endpoint, model, max_tokens, post, timeout
        self.headers = {"Authorization": f"Bearer {key}"}

    def chat(self, system: str, user: str) -> str:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        body = {"model": self.model, "messages": messages, "max_completion_tokens": self.max_tokens}
        choices = self.post(self.endpoint, body, self.headers, self.timeout).get("choices") or []
        text = ((choices[0].get("message") or {}).get("content") if choices else "") or ""
        if not text:
            raise ClientError("empty response from the model")
        return text

    def stored(self, prompt_id: str, user: str) -> str:
        url = self.endpoint.replace("/chat/completions", "/responses")
        body = {"model": self.model, "prompt": {"id": prompt_id}, "input": user}
        text = responses_text(self.post(url, body, self.headers, self.timeout))
        if not text:
            raise ClientError("empty response from the model")
        return text


def responses_text(answer: dict) -> str:
    """Output texts of message items, parted by blank lines; reasoning items are passed over."""
    items = [c for o in answer.get("output", []) if o.get("type") == "message" for c in o.get("content") or []]
    return "\n\n".join(c["text"] for c in items if c.get("type") == "output_text")


def format_timeline(timeline: dict, formatter: ChatFormatter, system: str, prompt_id: str | None = None, say: Callable[[str], None] = lambda s: None) -> str:
    """Markdown of a timeline: whole with a stored prompt, else whole or in sections by its estimated size; tells each section."""
    body = json.dumps(timeline, ensure_ascii=False, separators=(",", ":"))
    if prompt_id:
        return formatter.stored(prompt_id, body)
    if len(body.encode()) // 4 <= SECTION_TOKENS:
        return formatter.chat(system, body)
    out: list[str] = []
    parts = sections_of(timeline)
    for i, part in enumerate(parts, 1):
        say(f"section {i}/{len(parts)}, {len(part['segments'])} segments")
        prompt = CONTINUATION_BEFORE + header_of(out[0]) + CONTINUATION_AFTER if out else system
        out.append(formatter.chat(prompt, json.dumps(part, ensure_ascii=False, separators=(",", ":"))))
    return "\n\n".join(out)
