"""Results kept under the fingerprint of what they were made from, and read again while that is unchanged."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from tidemark.operators.feed import fingerprint
from tidemark.session import marked


def result_key(name: str, inputs: Mapping[str, DataFrame], parameters: Mapping[str, object]) -> str:
    """A digest of a result's name, its parameters and the values and types of its inputs, whatever their order.

    Parameters must have a JSON form. Costs one aggregation over each input.
    """
    printed = {
        label: [df.schema.json(), [str(value) for value in fingerprint(df).first()]] for label, df in inputs.items()
    }
    made_from = json.dumps([name, dict(parameters), printed], sort_keys=True)
    return hashlib.sha256(made_from.encode()).hexdigest()


def reused(
    store: str,
    name: str,
    inputs: Mapping[str, DataFrame],
    parameters: Mapping[str, object],
    compute: Callable[..., DataFrame],
) -> tuple[DataFrame, bool]:
    """``compute(**inputs, **parameters)``, or the stored rows of an earlier call on the same values; and which it is.

    Results lie in ``store`` (a shared folder), one folder per key. One counts only once its success mark is there,
    so a call that died half way is computed again, and two calls at once write the same rows. The inputs must not
    change during a call. Column order matters to ``compute`` and so to the key; row order does not.
    """
    spark = next(iter(inputs.values())).sparkSession
    path = f"{store.rstrip('/')}/{name}/{result_key(name, inputs, parameters)}"
    found = marked(spark, path)
    if not found:
        compute(**inputs, **parameters).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), found
