"""Text providers behind one call. The engine brings no model: a provider is any function from prompts to answers, and
failures, retries, latency and cost are recorded in the same row."""

from __future__ import annotations

import hashlib
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Answer = tuple[str, int, int]
Provider = Callable[[str, str], Answer]
#: A token with its log probability and the alternatives (token, log probability) at its place.
Token = tuple[str, float, list[tuple[str, float]]]
TokenProvider = Callable[[str, str], tuple[str, list[Token]]]
#: Seconds that a call may take, and seconds before the k-th repetition, times k.
TIMEOUT, BACKOFF = 900.0, 10.0

RESULT = "status string, raw_text string, latency_ms long, input_tokens long, output_tokens long, cost double, retry_count int, error string"


@dataclass
class Replay:
    """Recorded answers by a hash of model and prompt; without one, a fixed text made of it. For tests and offline runs."""

    answers: dict[str, str]

    def __call__(self, model: str, prompt: str) -> Answer:
        key = hashlib.sha256(f"{model}\n{prompt}".encode()).hexdigest()
        text = self.answers.get(key) or f'{{"overview": "answer {key[:8]}", "tech_stack": [], "services": [], "dependencies": []}}'
        return text, len(prompt.split()), len(text.split())


def _tried(call: Callable[[], object], retries: int, timeout: float, backoff: float) -> tuple[object, int, str | None]:
    """(what the call gives, repetitions, None), or (None, repetitions, the last error). A call runs in a thread of its
    own, which is left behind when its time is up; waits grow with each repetition."""
    error = None
    for k in range(retries + 1):
        if k:
            time.sleep(backoff * k)
        box: list = []

        def run(box: list = box) -> None:
            try:
                box.append((call(), None))
            except Exception as x:  # whatever a provider raises is that row's failure
                box.append((None, f"{type(x).__name__}: {x}"))

        worker = threading.Thread(target=run, daemon=True)
        worker.start()
        worker.join(timeout)
        got, error = box[0] if box else (None, f"TimeoutError: no answer in {timeout:g} s")
        if error is None:
            return got, k, None
    return None, retries, error


def ask(
    prompts: DataFrame,
    provider: Provider,
    retries: int = 2,
    price: Callable[[str, int, int], float] | None = None,
    model: str = "model",
    prompt: str = "prompt",
    timeout: float = TIMEOUT,
    backoff: float = BACKOFF,
) -> DataFrame:
    """prompts with the provider's answer to each. A failed call, or one beyond `timeout` seconds, is tried again after
    `backoff` seconds, twice that, and so on; after `retries` more the row has status `failed`, zeros and the error. Calls
    run in the tasks, so partitions decide how many go at once; a lost executor's rows are asked again. Write the result
    before it is used twice, or it is asked for twice."""
    keep = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for m, p in zip(b[model], b[prompt]):
                began = time.monotonic()
                got, k, error = _tried(lambda m=m, p=p: provider(m, p), retries, timeout, backoff)
                if error is None:
                    text, tokens_in, tokens_out = got
                    rows.append((
                        "success",
                        text,
                        int(1000 * (time.monotonic() - began)),
                        tokens_in,
                        tokens_out,
                        price(m, tokens_in, tokens_out) if price else 0.0,
                        k,
                        None,
                    ))
                else:
                    rows.append(("failed", None, 0, 0, 0, 0.0, k, error))
            names = [c.split()[0] for c in RESULT.split(", ")]
            yield pd.concat([b.reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    return prompts.mapInPandas(each, f"{keep}, {RESULT}")


TOKENS = "array<struct<token:string,logprob:double,top:array<struct<token:string,logprob:double>>>>"


def ask_tokens(
    prompts: DataFrame,
    provider: TokenProvider,
    retries: int = 2,
    model: str = "model",
    prompt: str = "prompt",
    timeout: float = TIMEOUT,
    backoff: float = BACKOFF,
) -> DataFrame:
    """prompts with raw_text and tokens of a raw generation: each token with its log probability and alternatives, as
    judge.criterion_score() and judge.confidence() read them. Failed calls give nulls and the error."""
    keep = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for m, p in zip(b[model], b[prompt]):
                got, _, error = _tried(lambda m=m, p=p: provider(m, p), retries, timeout, backoff)
                text, tokens = got if error is None else (None, None)
                shaped = None if tokens is None else [{"token": t, "logprob": v, "top": [{"token": a, "logprob": w} for a, w in top]} for t, v, top in tokens]
                rows.append((text, shaped, error))
            yield pd.concat([b.reset_index(drop=True), pd.DataFrame(rows, columns=["raw_text", "tokens", "error"])], axis=1)

    return prompts.mapInPandas(each, f"{keep}, raw_text string, tokens {TOKENS}, error string")


def prompt_from(template: str, columns: list[str]):
    """A template with %s for each column."""
    return F.format_string(template, *columns)
