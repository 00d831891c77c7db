"""The boundary to language models: a protocol, an offline client, and one map over prompts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import Settings


class Answer(NamedTuple):
    content: str
    input_tokens: int
    output_tokens: int


class ModelClient(Protocol):
    """What a Python worker calls for each prompt."""

    def generate(self, prompt: str, system: str | None = None, temperature: float | None = None, max_tokens: int | None = None) -> Answer: ...


class RuleClient:
    """The offline client: keywords are the longest words of a prompt, fragments are valid if they have enough words."""

    def generate(self, prompt: str, system: str | None = None, temperature: float | None = None, max_tokens: int | None = None) -> Answer:
        fragments = re.findall(r"^\[(\d+)\] (.*)$", prompt, re.M)
        if fragments:
            made = [{"fragment_id": int(k), "is_valid": len(t.split()) >= 4, "confidence": round(min(1.0, 0.6 + 0.02 * len(t.split())), 4), "core_text": t.strip()} for k, t in fragments]
        else:
            made = sorted(set(re.findall(r"\w{6,}", prompt.lower())), key=lambda w: (-len(w), w))[:8]
        content = json.dumps(made)
        return Answer(content, int(len(prompt.split()) * 1.3), int(len(content.split()) * 1.3))


CLIENTS: dict[str, type] = {"rules": RuleClient}


def get_client(provider: str, **options) -> ModelClient:
    if provider not in CLIENTS:
        raise ValueError(f"unknown model provider {provider!r}; known: {sorted(CLIENTS)}")
    return CLIENTS[provider](**options)


def call_cost(input_tokens: Column, output_tokens: Column, settings: Settings = Settings()) -> Column:
    """Dollars of one call; prices are for a million tokens."""
    return input_tokens / F.lit(1e6) * F.lit(settings.input_price) + output_tokens / F.lit(1e6) * F.lit(settings.output_price)


def call_model(prompts: DataFrame, client: ModelClient, prompt_col: str = "prompt", max_calls: int | None = None, **options) -> DataFrame:
    """prompts with content, input_tokens, output_tokens, cost and error. A failed call is an error row, never a lost one.

    Write the result before using it twice, so that no call is paid for again. max_calls bounds the calls at a time.
    """
    schema = ", ".join([*(f"`{n}` {t}" for n, t in prompts.dtypes), "content string", "input_tokens long", "output_tokens long", "error string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for prompt in batch[prompt_col]:
                try:
                    rows.append((*client.generate(prompt, **options), None))
                except Exception as e:  # the client is foreign code: its failure is data here
                    rows.append((None, 0, 0, f"{type(e).__name__}: {e}"))
            yield batch.assign(**{c: [r[k] for r in rows] for k, c in enumerate(("content", "input_tokens", "output_tokens", "error"))})

    asked = prompts.repartition(max_calls) if max_calls else prompts
    return asked.mapInPandas(run, schema).withColumn("cost", call_cost(F.col("input_tokens"), F.col("output_tokens")))
