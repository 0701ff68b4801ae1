"""Batch inference with a user-supplied generation function.

The model call is outside Spark; this operator runs it partition-parallel
through ``mapInPandas`` (Arrow batches), with the reference's fixed,
deterministic settings passed along, and isolates failures per row: a
failed call yields ``response = null`` and an error text and class (P6),
never a failed job.  The prompt × model matrix is a generator
(``explode`` of the model list), not a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelake.functions.prompts import MODEL_ERROR_WORDS
from codelake.operators.calls import limited

# Generation settings (fixed values).
GEN_SETTINGS = {"temperature": 0.0, "top_p": 1.0, "top_k": 1, "seed": 42}

CALL_TIMEOUT_S = 300.0

GenerateFn = Callable[[str, str, dict], str]


def _error_class(msg: str) -> str:
    low = msg.lower()
    if "model" in low and any(w in low for w in MODEL_ERROR_WORDS):
        return "model_unavailable"
    return "other"


def batch_infer(df: DataFrame, prompt_col: str, fn: GenerateFn, model_col: str = "model",
                settings: dict | None = None, timeout_s: float = CALL_TIMEOUT_S) -> DataFrame:
    """Adds ``response``, ``error``, ``error_class`` per row; a call over ``timeout_s`` is an error of its row."""
    opts = dict(GEN_SETTINGS, **(settings or {}))
    fields = [f for f in df.schema.fields if f.name not in ("response", "error", "error_class")]
    out_schema = T.StructType(fields + [T.StructField("response", T.StringType()),
                                        T.StructField("error", T.StringType()),
                                        T.StructField("error_class", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            res, err, cls = [], [], []
            for p, m in zip(pdf[prompt_col], pdf[model_col]):
                try:
                    res.append(limited(fn, timeout_s, p, m, opts))
                    err.append(None)
                    cls.append(None)
                except Exception as e:  # noqa: BLE001 - isolated per cell
                    res.append(None)
                    err.append(str(e))
                    cls.append(_error_class(str(e)))
            pdf = pdf.assign(response=res, error=err, error_class=cls)
            yield pdf[[f.name for f in out_schema.fields]]

    return df.mapInPandas(run, out_schema)


def prompts_by_models(prompts: DataFrame, models: list[str]) -> DataFrame:
    """Every prompt with every model of a given list (a generator)."""
    return prompts.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))


