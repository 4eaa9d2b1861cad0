"""Registration of named queries."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcost.functions.columns import round_half_up
from fleetcost.oracle import compose
from fleetcost.plans.pricecard import price_card, with_pricing_struct
from fleetcost.refdata import RefData
from fleetcost.sources.inputs import AS_OF, load


class Inputs:
    """Derived inputs and reference tables for one session and data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str, spread: bool = False) -> DataFrame:
        return load(self.spark, self.sf_dir, name, spread)

    @property
    def ref(self) -> RefData:
        """Reference tables of the session, with the price card built once."""
        ref = _REFS.get(self.spark)
        if ref is None:
            ref = RefData.fixtures(self.spark)
            ref.prices = with_pricing_struct(ref.prices)
            ref.price_card = ref.keep("price_card", lambda: price_card(ref.dbu_rates, ref.sku_region_map, ref.prices, AS_OF))
            _REFS[self.spark] = ref
        return ref


_REFS: WeakKeyDictionary[SparkSession, RefData] = WeakKeyDictionary()


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(key: str, sql: str | None = None):
    """Register a function of Inputs under `key`, with its checking SQL."""
    def register(fn):
        REGISTRY[key] = Query(lambda spark, sf_dir: fn(Inputs(spark, sf_dir)), compose(sql) if sql else None)
        return fn
    return register


def rounded(df: DataFrame, columns: str, digits: int = 6) -> DataFrame:
    """Round the named double columns, so two engines agree on the last digits."""
    return df.withColumns({c: round_half_up(c, digits) for c in columns.split()})


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


__all__ = ["F", "Inputs", "Query", "REGISTRY", "query", "rounded", "union_all"]
