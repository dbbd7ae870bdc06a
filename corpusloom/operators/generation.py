"""Calls to a text model, in Arrow batches, through a client the caller supplies."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.payloads import first_chat_choice, first_text_choice
from corpusloom.functions.text import strip

TIMEOUT = 30.0
_ANSWER = "struct<http_status: int, response: string, error: string>"

#: A client takes a request body (JSON text) and returns ``(http_status, body)``.
Client = Callable[[str], tuple[int, str]]
Answer = tuple[int, str | None, str | None]


class Caller:
    """One client per task; calls run side by side, each with its own time limit."""

    def __init__(self, make_client: Callable[[], Client], timeout: float | None, attempts: int, parallel: int):
        self.client, self.timeout = make_client(), timeout
        self.attempts, self.parallel = attempts, parallel
        self.pool: ThreadPoolExecutor | None = None

    def one(self, request: str) -> Answer:
        failure: Answer = (0, None, "not called")
        for _ in range(self.attempts):
            try:
                code, body = self.client(request)
            except Exception as exc:  # the row carries the failure, the job goes on
                failure = (0, None, f"{type(exc).__name__}: {exc}")
                continue
            if code == 200:
                return code, body, None
            failure = (code, None, f"Error {code}: {body}")
        return failure

    def many(self, requests: Sequence[str]) -> list[Answer]:
        """Answers in the order of the requests; a slot takes the next request as soon as it is free."""
        if self.parallel <= 1 and self.timeout is None:
            return [self.one(r) for r in requests]
        answers: list[Answer] = [(0, None, "timeout")] * len(requests)
        running: dict[Future, tuple[int, float]] = {}
        waiting = iter(enumerate(requests))
        hung = 0
        while True:
            while len(running) < self.parallel and (item := next(waiting, None)) is not None:
                if self.pool is None:
                    self.pool = ThreadPoolExecutor(max_workers=self.parallel)
                running[self.pool.submit(self.one, item[1])] = (item[0], time.monotonic())
            if not running:
                return answers
            limit = None
            if self.timeout is not None:
                limit = max(0.0, min(begun for _, begun in running.values()) + self.timeout - time.monotonic())
            finished, _ = wait(running, timeout=limit, return_when=FIRST_COMPLETED)
            for future in finished:
                answers[running.pop(future)[0]] = future.result()
            if self.timeout is not None:
                late = [f for f, (_, begun) in running.items() if time.monotonic() - begun >= self.timeout and not f.done()]
                for future in late:
                    running.pop(future)
                hung += len(late)
                # A hung call keeps its thread. Once no thread of the pool is free, later calls get a new pool.
                if hung >= self.parallel - len(running) and late:
                    self.pool.shutdown(wait=False)
                    self.pool, hung = None, 0

    def close(self) -> None:
        if self.pool is not None:
            self.pool.shutdown(wait=False, cancel_futures=True)
            self.pool = None


def call_model(rows: DataFrame, request: str, make_client: Callable[[], Client], timeout: float | None = TIMEOUT,
               attempts: int = 1, parallel: int = 8) -> DataFrame:
    """Add ``http_status``, ``response`` (JSON) and ``error``; one row in, one row out.

    Only the request goes to Python. ``timeout=None`` with ``parallel=1`` calls in the task's own thread.
    """
    @F.pandas_udf(_ANSWER)
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        caller = Caller(make_client, timeout, attempts, parallel)
        try:
            for requests in batches:
                answers = caller.many(requests.tolist())
                columns = list(zip(*answers, strict=True)) if answers else [(), (), ()]
                yield pd.DataFrame({"http_status": columns[0], "response": columns[1], "error": columns[2]}, dtype=object)
        finally:
            caller.close()

    # Declared non-deterministic so that the optimizer never repeats a call.
    answered = rows.withColumn("_answer", call.asNondeterministic()(F.col(request)))
    return answered.select(*rows.columns, "_answer.http_status", "_answer.response", "_answer.error")


def with_answer(answered: DataFrame, kind: str = "chat") -> DataFrame:
    """Add ``generated_text`` and ``status`` (ok, timeout, failed, too_short)."""
    first = first_chat_choice if kind == "chat" else first_text_choice
    text = strip(first(F.col("response")))
    status = (
        F.when(F.col("error") == "timeout", "timeout")
        .when((F.col("http_status") != 200) | text.isNull(), "failed")
        .when(text == "", "too_short")
        .otherwise("ok")
    )
    return answered.withColumn("generated_text", text).withColumn("status", status)


def route(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)`` by status."""
    return rows.where(F.col("status") == "ok"), rows.where(F.col("status") != "ok")


def status_column(http_status: Column, body: Column) -> tuple[Column, Column]:
    """``(answer, error)`` of a raw response: text on 200, message otherwise."""
    ok = http_status == 200
    answer = F.when(ok, first_chat_choice(body))
    error = F.when(~ok, F.concat(F.lit("Error "), http_status.cast("string"), F.lit(": "), body))
    return answer, error


def per_model(prompts: DataFrame, models: Sequence[str]) -> DataFrame:
    """Each prompt once per model of the argument list."""
    return prompts.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))


def _content(body: str) -> str | None:
    """Text of the first choice; None if the answer is not of that form."""
    try:
        text = json.loads(body)["choices"][0]["message"]["content"]
    except (ValueError, TypeError, KeyError, IndexError):
        return None
    return text if isinstance(text, str) else None


def multi_turn(prompts: DataFrame, model: str, make_client: Callable[[], Client], conv: str = "conv_id", turn: str = "turn",
               system: str | None = None, timeout: float | None = TIMEOUT, attempts: int = 1) -> DataFrame:
    """Run conversations: every answer enters the history of the next request.

    Conversations are spread by id and streamed in turn order; a task keeps only the
    history of the conversation it is in, never a whole group of rows. A call that fails, takes
    too long or brings an answer without text leaves the history as it was.
    """
    schema = f"{conv} long, {turn} long, n_messages int, http_status int, answer string, error string"
    ordered = prompts.select(conv, turn, "text").repartition(conv).sortWithinPartitions(conv, turn)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller = Caller(make_client, timeout, attempts, 1)
        current, history = None, []
        try:
            for batch in batches:
                out = []
                for key, at, text in batch.itertuples(index=False, name=None):
                    if key != current:
                        current, history = key, []
                    lead = [{"role": "system", "content": system}] if system and not history else []
                    user = {"role": "user", "content": text}
                    messages = lead + history + [user]
                    code, body, error = caller.many([json.dumps({"model": model, "messages": messages})])[0]
                    answer = _content(body) if code == 200 else None
                    if code == 200 and answer is None:
                        error = "malformed answer"
                    if answer is not None:
                        history += [*lead, user, {"role": "assistant", "content": answer}]
                    out.append((key, at, len(messages), code, answer, error))
                yield pd.DataFrame(out, columns=[conv, turn, "n_messages", "http_status", "answer", "error"])
        finally:
            caller.close()

    return ordered.mapInPandas(run, schema)
