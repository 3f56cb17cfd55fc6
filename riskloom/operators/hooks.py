"""User hooks (U1–U3): plug a real model into the pipeline.

* U1 ``model_embedder(load_model)``: text -> vector with a user model. The
  model is loaded once per Python worker process (cached by loader) and fed
  Arrow batches through ``mapInPandas``; the result plugs into
  ``vectors.embed_dedup(embed=...)`` so each distinct code hash is embedded
  once.
* U2/U3 ``score_requests(requests, reply_fn)``: send the deduplicated
  explanation / fix requests (prompt column) to a user scorer in batches and
  get a reply column back, to be parsed with ``scalars.explain_parse`` /
  ``scalars.fix_parse``. With no scorer the deterministic fallback applies.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

def _model(load_model):
    """The loaded model of this Python worker process.

    The package is pickled by value, so its module globals arrive fresh with
    every task; the cache lives on a module registered in the worker's
    ``sys.modules`` instead, which survives across tasks of a reused worker.
    Keyed by the loader's name (the loader itself is unpickled per task).
    """
    import sys
    import types

    holder = sys.modules.get("_riskloom_worker_models")
    if holder is None:
        holder = types.ModuleType("_riskloom_worker_models")
        holder.models = {}
        sys.modules["_riskloom_worker_models"] = holder
    key = (getattr(load_model, "__module__", None), getattr(load_model, "__qualname__", repr(load_model)))
    if key not in holder.models:
        holder.models[key] = load_model()
    return holder.models[key]


def model_embedder(load_model: Callable[[], Callable[[list[str]], np.ndarray]], *,
                   dims: int, out_col: str = "vector"):
    """An ``embed(df, ids, text_col)`` function backed by a user model.

    ``load_model()`` returns ``encode(list[str]) -> ndarray[n, dims]``; rows are
    L2-normalised here (zero rows stay zero).
    """

    def embed(df: DataFrame, ids: list[str], text_col: str) -> DataFrame:
        schema = T.StructType([df.schema[c] for c in ids]
                              + [T.StructField(out_col, T.ArrayType(T.FloatType()))])

        def run(batches):
            encode = _model(load_model)
            for pdf in batches:
                m = np.asarray(encode(pdf[text_col].fillna("").tolist()), dtype=np.float64).reshape(len(pdf), dims)
                norm = np.linalg.norm(m, axis=1, keepdims=True)
                m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0).astype(np.float32)
                out = pdf[ids].copy()
                out[out_col] = list(m)
                yield out

        return df.select(*ids, text_col).mapInPandas(run, schema)

    return embed


def score_requests(requests: DataFrame, reply_fn: Callable[[pd.DataFrame], pd.Series], *,
                   key_cols: list[str], prompt_col: str = "prompt", out_col: str = "reply") -> DataFrame:
    """Replies of a user scorer for each request row (batched, per partition)."""
    schema = T.StructType([requests.schema[c] for c in key_cols] + [T.StructField(out_col, T.StringType())])

    def run(batches):
        for pdf in batches:
            out = pdf[key_cols].copy()
            out[out_col] = pd.Series(reply_fn(pdf[[prompt_col]]), index=pdf.index).astype("string")
            yield out

    return requests.select(*key_cols, prompt_col).mapInPandas(run, schema)
