"""Optional language-model hooks. Nothing here opens a connection: a client is handed in."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Protocol

# Defaults of the calls.
TIMEOUT_SECONDS = 300
LEAF_TRIES = 3
ANSWER_TRIES = 2
EXPLAIN_TRIES = 2

HINT = "Your last reply was no JSON array. Reply with the JSON array alone: no prose around it and no code fence."


class ModelClient(Protocol):
    def generate(self, prompt: str, temperature: float = 0.0, timeout: float = TIMEOUT_SECONDS) -> str: ...


def is_array_text(text: str) -> bool:
    try:
        return isinstance(json.loads(text), list)
    except (TypeError, ValueError):
        return False


def ask_for_array(client: ModelClient, prompt: str, tries: int = ANSWER_TRIES, temperature: float = 0.0, note: Callable[..., None] = lambda kind, **fields: None) -> str:
    """The first reply that is a JSON array, or the last reply; later tries carry a hint, and every try is noted."""
    reply = ""
    for attempt in range(1, max(1, tries) + 1):
        reply = client.generate(prompt if attempt == 1 else f"{prompt}\n\n{HINT}", temperature=temperature, timeout=TIMEOUT_SECONDS)
        good = is_array_text(reply)
        note("attempt", attempt=attempt, ok_json_array=good, preview=reply[:200])
        if good:
            break
    return reply


def answer_prompt(question: str, context: list[dict]) -> str:
    """Ask for an answer over given rows, in the answer format with provenance."""
    return "\n".join([
        "Answer from the rows below and nothing else.",
        'Reply with a JSON array of {"result": object, "provenance": list of lists of row ids}: the ids of a list together give the result, several lists are alternatives.',
        f"Question: {question}",
        "Rows:",
        *(json.dumps(row, ensure_ascii=False) for row in context),
    ])
