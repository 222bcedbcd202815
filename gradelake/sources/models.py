"""Text models behind one small interface; the default answers by rule and needs no network."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class TextModel(Protocol):
    def __call__(self, prompt: str) -> str: ...


class Refused(Exception):
    """The model will not answer any prompt (credentials, say): nothing else is tried."""


class Missing(Exception):
    """There is no such model: the next one is tried at once."""


def answered(prompt: str, models: list[Callable[[str], str]], tries: int = 4, wait_s: float = 1.0) -> str | None:
    """The first answer of the models in turn; failing ones are asked again with growing waits."""
    for model in models:
        for attempt in range(tries):
            try:
                return model(prompt)
            except Refused:
                return None
            except Missing:
                break
            except Exception:  # noqa: BLE001
                if attempt + 1 < tries:
                    time.sleep(wait_s * (attempt + 1))
    return None


def replies(prompt: Column, models: list[Callable[[str], str]], tries: int = 4, wait_s: float = 1.0) -> Column:
    """Replies to a column of prompts, null where no model answers: the rule-based operators take over there."""

    @F.pandas_udf("string")
    def asked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield pd.Series([None if p is None else answered(p, models, tries, wait_s) for p in prompts], dtype=object)

    return asked(prompt)
