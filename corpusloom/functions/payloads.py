"""Request bodies and response fields as JSON columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import CHAT_STOPS, COMPLETION_STOPS

# Sampling options sent with each kind of request, in the order in which they are sent.
CHAT_SAMPLING = {
    "temperature": 0.7, "max_tokens": 1000, "top_p": 0.7, "frequency_penalty": 0.0, "presence_penalty": 0.0, "stop": CHAT_STOPS,
    "repetition_penalty": 1, "top_k": 50,
}
COMPLETION_SAMPLING = {
    "temperature": 0.7, "max_tokens": 1000, "top_p": 0.7, "stop": COMPLETION_STOPS, "repetition_penalty": 1, "top_k": 50,
}
BATCH_SAMPLING = {
    "max_tokens": 1000, "min_tokens": 1, "temperature": 0.9, "top_k": 50, "top_p": 0.95, "skip_special_tokens": True,
}
INSTRUCTION_SAMPLING = {"max_tokens": 1000}
SERVING_SAMPLING = {"temperature": 0.9, "max_tokens": 1000, "min_tokens": 1}
SERVING_EXTRA = {"min_tokens": 1, "skip_special_tokens": True, "top_k": 50}


def message(role: Column, content: Column) -> Column:
    return F.struct(role.alias("role"), content.alias("content"))


def _options(values: Mapping[str, object]) -> list[Column]:
    """Columns of sampling options; lists become arrays."""
    return [
        (F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v)).alias(name) for name, v in values.items()
    ]


def chat_payload(messages: Column, model: Column, sampling: Mapping[str, object] = CHAT_SAMPLING) -> Column:
    return F.to_json(F.struct(model.alias("model"), messages.alias("messages"), *_options(sampling)))


def completion_payload(prompt: Column, model: Column, sampling: Mapping[str, object] = COMPLETION_SAMPLING) -> Column:
    return F.to_json(F.struct(model.alias("model"), prompt.alias("prompt"), *_options(sampling)))


def serving_payload(prompt: Column, model: Column, n: int = 1, sampling: Mapping[str, object] = SERVING_SAMPLING,
                    extra: Mapping[str, object] = SERVING_EXTRA) -> Column:
    """Body for a served model: ``n`` choices and nested extra parameters."""
    outer = {name: extra[name] for name in ("skip_special_tokens", "top_k") if name in extra}
    return F.to_json(F.struct(
        F.array(message(F.lit("user"), prompt)).alias("messages"), F.lit(n).alias("n"), *_options(sampling),
        model.alias("model"), *_options(outer), F.struct(*_options(extra)).alias("SamplingParams"),
    ))


def first_chat_choice(body: Column) -> Column:
    return F.get_json_object(body, "$.choices[0].message.content")


def first_text_choice(body: Column) -> Column:
    return F.get_json_object(body, "$.choices[0].text")


_CHOICES = "struct<choices:array<struct<text:string,message:struct<role:string,content:string>>>>"


def all_choices(body: Column) -> Column:
    """Every returned choice, for requests with ``n`` above one."""
    return F.transform(
        F.from_json(body, _CHOICES)["choices"],
        lambda c: F.coalesce(c["message"]["content"], c["text"]),
    )
