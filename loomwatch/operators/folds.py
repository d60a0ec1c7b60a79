"""Ordered folds: what is said of each row depends on what was said of those before it in its group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

#: Takes the state of a group (changed in place, empty at its first row) and a row; gives the new columns.
Step = Callable[[dict, dict], tuple]


def in_order(rows: DataFrame, by: list[str], order: list[str], step: Step, out: dict[str, str]) -> DataFrame:
    """``rows`` with the columns ``out`` (name to type) that ``step`` gives, in ``order`` within each group of ``by``.

    A group is read as a sorted stream, one Arrow batch at a time, so its size is bounded by no
    memory; the state that ``step`` keeps is. Groups are told apart by values that are not null.
    Rows are dealt by a digest of ``by``: where they come from a join on ``by`` itself, Spark leaves a
    second dealing by the same columns out, and adaptive execution, to which a map over partitions
    states no need, may then read that join's shuffle piecewise and part the groups.
    """
    shape = T.StructType([*rows.schema, *T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in out.items()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, {}
        for pdf in batches:
            said = []
            for row in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                mine = tuple(row[c] for c in by)
                if mine != key:
                    key, state = mine, {}
                said.append(step(state, row))
            yield pdf.assign(**{n: pd.Series([s[i] for s in said], dtype=object, index=pdf.index) for i, n in enumerate(out)})

    return rows.repartition(F.xxhash64(*by)).sortWithinPartitions(*by, *order).mapInPandas(run, shape)
