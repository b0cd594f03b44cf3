"""relevo: search-relevance analytics expressed as Spark DataFrame / SQL jobs.

Sub-packages:
  sources/    table readers, derived views, sinks, synthetic data
  functions/  Column-level helpers (text, arithmetic, fixed values)
  operators/  the relational operators (signals, text analysis, retrieval,
              vectors, features, scoring, fusion, evaluation, quality, training)
  plans/      composed jobs (hybrid search, the end-to-end pipeline) and the
              registry of named queries with their SQL oracles
  streaming/  Structured Streaming version of the utility counter
"""

__version__ = "0.1.0"
