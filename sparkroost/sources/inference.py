"""The surface that model clients plug into: provider choice, retries, and the inference of pending rows.

No client is here; a caller gives one function for each provider.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_RESULT = "response string, success boolean, error string, provider string, input_tokens long, output_tokens long, total_tokens long"


def provider_of(model: str, providers: dict[str, str]) -> str:
    """The provider of a model, by its exact name; an unknown model is an error."""
    if model not in providers:
        raise ValueError(f"no provider is known for the model {model}")
    return providers[model]


def with_retry(call: Callable[[], dict], attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> dict:
    """``call()``, again after 1, 2, 4, ... seconds if it raises; after the last attempt an entry with
    the error."""
    for k in range(attempts):
        try:
            return call()
        except Exception as e:  # a client may raise anything
            if k == attempts - 1:
                return {"response": "", "success": False, "error": str(e), "token_usage": {}}
            sleep(2.0**k)
    return {"response": "", "success": False, "error": "no attempt was made", "token_usage": {}}


def infer(rows: DataFrame, clients: dict[str, Callable[[str, str], dict]], providers: dict[str, str], attempts: int = 3, pause: float = 0.0) -> DataFrame:
    """``rows`` (global_index, model, prompt) with each model's answer. ``clients``: by provider, a
    function of (model, prompt) that gives response, success and token_usage. ``providers``: by model.
    A failed call is a row; a model without a provider fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, model, prompt in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                provider = provider_of(model, providers)
                client = clients.get(provider)
                if client is None:
                    got = {"response": "", "success": False, "error": f"no client for {provider}", "token_usage": {}}
                else:
                    got = with_retry(lambda: client(model, prompt), attempts)  # noqa: B023
                    time.sleep(pause)
                usage = got.get("token_usage") or {}
                counts = [int(usage.get(k, 0)) for k in ("input_tokens", "output_tokens", "total_tokens")]
                ok = bool(got.get("success", False))
                out.append((key, model, prompt, got.get("response", ""), ok, None if ok else got.get("error"), provider, *counts))
            kinds = [*(c.type for c in batch.columns), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            names = ["global_index", "model", "prompt", *(x.split()[0] for x in _RESULT.split(", "))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], names)

    own = rows.select("global_index", "model", "prompt")
    return own.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in own.dtypes) + ", " + _RESULT)


def estimate_tokens(rows: DataFrame, vocabulary: bytes, column: str, name: str = "n_tokens") -> DataFrame:
    """``rows`` with the number of tokens of a column's text by a byte-level vocabulary (a tokenizer
    file's content, which is broadcast); null: none."""
    held = rows.sparkSession.sparkContext.broadcast(vocabulary)
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        cut = Tokenizer.from_str(held.value.decode("utf-8"))
        for batch in batches:
            n = [len(x.ids) for x in cut.encode_batch([t or "" for t in batch.column(at).to_pylist()], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], [*batch.schema.names, name])

    return rows.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + f", {name} long")
