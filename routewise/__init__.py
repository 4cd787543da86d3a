"""routewise: Spark-native payment-route analytics.

Point-in-time route/bank/network features, candidate expansion, routing
policy evaluation, model evaluation sweeps, Spark ML training and
Structured Streaming feature maintenance -- all as DataFrame plans.
"""

__version__ = "0.1.0"
