"""vitalspark: Spark-native clinical and tabular analytics.

DataFrame-in, DataFrame-out operators for profiling, data quality, risk
scoring, entity profiles, similarity, trends, survival, alert rules, dataset
comparison, privacy, clinical coding and tabular machine learning.
"""

__version__ = "0.1.0"
