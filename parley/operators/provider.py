"""The seam for language models: batches of prompts to a provider, with retries; without one, rules answer."""

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from parley.session import share_code

#: Parts of a message that tell of a rate limit.
RATE_WORDS = ("429", "rate", "limit", "quota", "exhausted")
Provider = Callable[[str], str]


def ask(prompt: str, providers: list[Provider], tries: int = 3, pause: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The answer of the first provider that gives one; None if none does.

    A rate limit is waited out, longer each time; another error is raised unless it is the last try's.
    """
    for attempt in range(1, tries + 1):
        try:
            for provider in providers[:-1]:
                try:
                    return provider(prompt)
                except Exception:
                    continue
            return providers[-1](prompt) if providers else None
        except Exception as error:
            if attempt == tries:
                return None
            if not any(w in str(error).lower() for w in RATE_WORDS):
                raise
            sleep(pause * attempt)
    return None


def answers(rows: DataFrame, prompt: str, providers: Callable[[], list[Provider]] | None = None, pace: float = 0.0, column: str = "answer") -> DataFrame:
    """rows with the raw answer to the column `prompt`; all null without providers.

    providers is called once in each task: clients are made where they are used.
    """
    share_code(rows.sparkSession)
    schema = T.StructType([*rows.schema.fields, T.StructField(column, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clients = providers() if providers else []
        for batch in batches:
            out = []
            for text in batch[prompt]:
                out.append(ask(text, clients) if clients and text is not None else None)
                if clients and pace:
                    time.sleep(pace)
            yield batch.assign(**{column: pd.Series(out, index=batch.index, dtype=object)})

    return rows.mapInPandas(run, schema)
