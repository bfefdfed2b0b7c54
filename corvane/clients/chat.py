"""Chat clients: messages in, one answer out, and the same over tables of turns."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.config import Settings
from corvane.sources.fetch import FetchError, Response, retrying

ROLES = ("system", "user", "assistant")


@dataclass(frozen=True)
class Message:
    role: str
    content: str

    def __post_init__(self):
        if self.role not in ROLES:
            raise ValueError(f"role must be one of {', '.join(ROLES)}, not {self.role!r}")


@dataclass(frozen=True)
class Answer:
    content: str
    model: str
    input_tokens: int
    output_tokens: int
    stop_reason: str


class ChatError(RuntimeError):
    """A service that gives no answer."""


class Chat(Protocol):
    def complete(self, messages: Sequence[Message], max_tokens: int = 1024) -> Answer: ...


class EchoChat:
    """Answers with the last user's words; four characters count as a token."""

    def complete(self, messages: Sequence[Message], max_tokens: int = 1024) -> Answer:
        said = [m.content for m in messages if m.role == "user"]
        if not said:
            raise ChatError("no user message")
        text = f"echo: {said[-1]}"
        return Answer(text, "echo", sum(len(m.content) for m in messages) // 4, len(text) // 4, "end_turn")


class RemoteChat:
    """A messages service, through a transport (url, headers, body) -> Response that the caller gives."""

    def __init__(self, post: Callable[[str, dict[str, str], bytes], Response], url: str, key: str, model: str, attempts: int = 5, sleep: Callable[[float], None] = time.sleep):
        if not key:
            raise ValueError("the remote client needs a key")
        self.post, self.url, self.model, self.attempts, self.sleep = post, url, model, attempts, sleep
        self.headers = {"Content-Type": "application/json", "X-Api-Key": key}

    def complete(self, messages: Sequence[Message], max_tokens: int = 1024) -> Answer:
        system, rest = lifted(messages)
        if not rest:
            raise ChatError("no message but the system's")
        body = {"model": self.model, "max_tokens": max_tokens, "messages": [{"role": m.role, "content": m.content} for m in rest]}
        if system:
            body["system"] = system
        try:
            found = json.loads(retrying(lambda: self.post(self.url, self.headers, json.dumps(body).encode()), self.attempts, sleep=self.sleep).body)
            text = "".join(b["text"] for b in found["content"] if b.get("type") == "text")
            use = found.get("usage") or {}
            return Answer(text, found.get("model", self.model), int(use.get("input_tokens", 0)), int(use.get("output_tokens", 0)), found.get("stop_reason") or "")
        except (FetchError, ValueError, KeyError, TypeError) as e:
            raise ChatError(f"no answer: {e}") from e


def lifted(messages: Sequence[Message]) -> tuple[str | None, list[Message]]:
    """(the system messages with blank lines between, or None; the others)."""
    system = [m.content for m in messages if m.role == "system"]
    return "\n\n".join(system) if system else None, [m for m in messages if m.role != "system"]


def chat(settings: Settings, post: Callable | None = None) -> Chat:
    if settings.chat_backend == "echo":
        return EchoChat()
    if post is None:
        raise ValueError("the remote client needs a transport")
    return RemoteChat(post, settings.chat_url, settings.chat_key, settings.chat_model)


def echo(turns: DataFrame) -> DataFrame:
    """(conv_id, answer, input_tokens, output_tokens) of conversations (conv_id, turn, role, text) by EchoChat."""
    user: Column = F.when(F.col("role") == "user", F.col("turn"))
    out = turns.groupBy("conv_id").agg(F.concat(F.lit("echo: "), F.max_by("text", user)).alias("answer"), F.expr("sum(length(text)) div 4").alias("input_tokens"))
    return out.withColumn("output_tokens", F.expr("length(answer) div 4"))


def lift(turns: DataFrame) -> DataFrame:
    """(conv_id, system, n_rest): the system messages of each conversation in one text, and how many others there are."""
    part = F.sort_array(F.collect_list(F.when(F.col("role") == "system", F.struct("turn", "text"))))
    out = turns.groupBy("conv_id").agg(part.alias("s"), F.count_if(F.col("role") != "system").alias("n_rest"))
    return out.select("conv_id", F.when(F.size("s") > 0, F.array_join(F.col("s.text"), "\n\n")).alias("system"), "n_rest")
