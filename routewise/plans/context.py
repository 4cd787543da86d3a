"""Per-query build context: the bound fact table, the route dimension and
lazily-built feature state.  Nothing is shared between queries, so each
registered query does (and is timed for) its whole work."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routewise.operators.features import FeatureState, build_state, feature_table
from routewise.operators.prefix import DEFAULT_BLOCK_SIZE
from routewise.sources.bindings import read_attempts
from routewise.sources.routes import eligibility_dim, route_dim
from routewise.sources.tables import read_table


class Ctx:
    def __init__(self, spark: SparkSession, sf_dir: str, tick_seconds: int = 3600,
                 block_size: int | None = None, probes: bool = False):
        self.spark, self.sf_dir = spark, sf_dir
        self.tick_seconds, self._block_size, self.probes = tick_seconds, block_size, probes

    @property
    def block_size(self) -> int:
        """Transaction-block width: explicit, or sized from the id range (bounded block tables)."""
        if self._block_size is None:
            from routewise.operators.features import adaptive_block_size
            self._block_size = adaptive_block_size(self.attempts)
        return self._block_size

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def attempts(self) -> DataFrame:
        return read_attempts(self.spark, self.sf_dir, self.tick_seconds)

    @cached_property
    def routes(self) -> DataFrame:
        return route_dim(self.spark)

    @cached_property
    def eligibility(self) -> DataFrame:
        return eligibility_dim(self.spark)

    @cached_property
    def state(self) -> FeatureState:
        return build_state(self.attempts, self.routes, self.tick_seconds, self.block_size, probes=self.probes)

    def features(self, engineered: bool = True) -> DataFrame:
        return feature_table(self.attempts, self.state, self.tick_seconds, self.state.block_size, engineered)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column half-up, like the oracle's round(x, 6)."""
    return df.select(*[F.round(F.col(f.name), places).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def candidates(c: Ctx, score: str = "bank_route_success_rate_15m") -> DataFrame:
    """Eligible candidates of test transactions with looked-up features and score ``p``.

    ``p`` defaults to the SQL-expressible ``bank_route_success_rate_15m``;
    the trained model's calibrated probability replaces it in the model
    policy report.  ``outcome_proxy`` (M12) = candidate route_success_rate_5m.
    """
    from routewise.operators.candidates import candidate_features, eligible_routes, test_transactions
    c.probes = True
    txns = test_transactions(c.features(True))
    cands = candidate_features(eligible_routes(txns, c.eligibility), c.state)
    return cands.withColumn("p", F.col(score)).withColumn("outcome_proxy", F.col("route_success_rate_5m"))
