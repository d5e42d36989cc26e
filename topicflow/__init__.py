"""topicflow: multi-domain topic classification data engine on PySpark.

Layout
------
sources/    scans, sinks, driver-table derivations, run registry (S*)
functions/  Column-expression builders: cleaning, tokens, text helpers (X*, P*)
operators/  DataFrame -> DataFrame operators: taxonomy, sampling, quotas,
            features, classifiers, search, metrics, curves (P/J/G/W/T/M)
plans/      composed jobs: corpus preparation, training, evaluation
streaming/  Structured Streaming ingest and scoring (R*)
"""

__version__ = "0.1.0"
