"""Operations by name: strategies, REPLACE or ENRICH, null strategies, conditions, and hooks for own code."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fake, generalize, mask, metrics, noise, pseudonymize, suppress

Change = Callable[..., DataFrame]


@dataclass(frozen=True)
class Operation:
    """A change of one field: the first strategy is the default; each is called as f(df, field, output=..., **parameters)."""

    name: str
    category: str
    strategies: dict[str, Change] = field(default_factory=dict)


_OPERATIONS: dict[str, Operation] = {}


def register(name: str, category: str, **strategies: Change) -> Operation:
    """A new operation, or more strategies of a known one."""
    known = _OPERATIONS.get(name)
    _OPERATIONS[name] = Operation(name, category, {**(known.strategies if known else {}), **strategies})
    return _OPERATIONS[name]


def names(category: str | None = None) -> list[str]:
    return sorted(n for n, o in _OPERATIONS.items() if category in (None, o.category))


def get(name: str) -> Operation:
    if name not in _OPERATIONS:
        raise KeyError(f"unknown operation {name}; known: {names()}")
    return _OPERATIONS[name]


def operate(
    df: DataFrame, name: str, target: str, strategy: str | None = None, mode: str = "REPLACE", output: str | None = None, null_strategy: str = "PRESERVE", null_value: str = "*",
    where: Column | None = None, **parameters: Any,
) -> DataFrame:
    """``target`` changed by an operation's strategy.

    mode REPLACE changes the field, ENRICH adds ``output`` (``_field`` if not
    given).  null_strategy: PRESERVE keeps nulls null, EXCLUDE drops their
    rows, ERROR raises, ANONYMIZE puts ``null_value``.  Rows that fail
    ``where`` keep their value.
    """
    operation = get(name)
    change = operation.strategies[strategy or next(iter(operation.strategies))]
    x = F.col(target)
    if null_strategy == "EXCLUDE":
        df = df.where(x.isNotNull())
    elif null_strategy == "ERROR" and not df.where(x.isNull()).isEmpty():
        raise ValueError(f"{target} holds nulls")
    done = change(df, target, output="__new", **parameters)
    new = F.col("__new")
    kind = done.schema["__new"].dataType
    if null_strategy == "ANONYMIZE":
        new, kind = F.when(x.isNull(), F.lit(null_value)).otherwise(new.cast("string")), "string"
    else:
        new = F.when(x.isNotNull(), new)
    if where is not None:
        new = F.when(where, new).otherwise(x.cast(kind))
    return done.withColumn(target if mode == "REPLACE" else output or f"_{target}", new).drop("__new")


def process_batches(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str | None = None) -> DataFrame:
    """Own code over batches of rows, Arrow-batched: what no operation says."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return map(f, batches)

    return df.mapInPandas(run, schema or df.schema)


def process_values(df: DataFrame, target: str, f: Callable[[Any], Any], kind: str = "string", output: str | None = None) -> DataFrame:
    """Own code over single values of a field; nulls stay null."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(f, na_action="ignore")

    return df.withColumn(output or target, run(F.col(target)))


def _binned(kind: str) -> Change:
    return lambda df, target, output=None, **p: generalize.bin_dates(df, target, kind, output=output, **p)


def _cells(strategy: str) -> Change:
    return lambda df, target, output=None, **p: suppress.suppress_cells(df, target, strategy=strategy, output=output, **p)


register("numeric_generalization", "anonymization", binning=generalize.equal_width, quantile=generalize.equal_frequency, rounding=generalize.round_numbers, range=generalize.ranges)
register("datetime_generalization", "anonymization", rounding=generalize.truncate_dates, component=generalize.keep_components, relative=generalize.relative_dates, **{k: _binned(k) for k in ("hour_range", "day_range", "business_period", "seasonal", "custom")})
register("categorical_generalization", "anonymization", hierarchy=generalize.hierarchy, merge_low_freq=generalize.group_rare, frequency_based=generalize.keep_frequent)
register("full_masking", "anonymization", fixed=mask.full_mask, format=mask.mask_by_format, numeric=mask.mask_numbers)
register("partial_masking", "anonymization", fixed=mask.mask_middle, positions=mask.mask_positions, pattern=mask.mask_pattern, random=mask.mask_share, words=mask.mask_words)
register("cell_suppression", "anonymization", **{k: _cells(k) for k in ("null", "constant", "mean", "median", "mode", "group_mean", "group_mode")})
register("uniform_numeric_noise", "anonymization", uniform=noise.uniform_numeric_noise)
register("uniform_temporal_noise", "anonymization", uniform=noise.uniform_temporal_noise)
register("keyed_noise", "anonymization", uniform=noise.keyed_noise)
register("hash_pseudonymization", "anonymization", sha2=pseudonymize.sha2_pseudonym, sha3=pseudonymize.sha3_pseudonym, hmac=pseudonymize.hmac_pseudonym)
register("fake_name", "fake_data", prgn=fake.fake_name)
register("fake_email", "fake_data", prgn=fake.fake_email)
register("fake_phone", "fake_data", prgn=fake.fake_phone)
register("fake_organization", "fake_data", prgn=fake.fake_organization)

#: Metrics of two tables by name, each f(before, after, ...) -> DataFrame.
FIDELITY = {"ks": metrics.ks, "ks_keyed": metrics.ks_keyed, "kl": metrics.kl_js, "wasserstein": metrics.wasserstein, "statistical": metrics.statistical_fidelity}
UTILITY = {"information_loss": metrics.information_loss, "suppression_loss": metrics.suppression_loss, "generalization_loss": metrics.generalization_loss}


def fidelity(before: DataFrame, after: DataFrame, metric: str, *args: Any, **parameters: Any) -> DataFrame:
    return FIDELITY[metric](before, after, *args, **parameters).select(F.lit(metric).alias("metric"), "*")


def utility(before: DataFrame, after: DataFrame, metric: str, *args: Any, **parameters: Any) -> DataFrame:
    return UTILITY[metric](before, after, *args, **parameters).select(F.lit(metric).alias("metric"), "*")


def privacy(before: DataFrame, after: DataFrame, metric: str, fields: list[str], **parameters: Any) -> DataFrame:
    """``dcr``, ``nndr`` (distances of the released rows to the original ones) or ``uniqueness`` (of the released rows)."""
    from . import attacks

    if metric == "uniqueness":
        return metrics.uniqueness(after, fields, **parameters).select(F.lit(metric).alias("metric"), "*")
    return {"dcr": attacks.dcr, "nndr": attacks.nndr}[metric](after, before, fields, **parameters).select(F.lit(metric).alias("metric"), "*")
