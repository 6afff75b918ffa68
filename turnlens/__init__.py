"""turnlens: Spark-native preparation and evaluation of text generated from dialogue acts.

Layout:
  sources/    readers and sinks (parquet fixture views, JSON/TSV/CSV/text files)
  functions/  pure ``Column -> Column`` helpers (text cleaning, tokens, n-grams)
  operators/  ``DataFrame -> DataFrame`` operators (linearizers, SER, BLEU, ROUGE,
              METEOR, PARENT, analysis, token arrays, phrase mining)
  plans/      the registered queries and their DuckDB oracle SQL
  streaming/  Structured Streaming variants of the additive metrics
"""

from turnlens.session import get_session, checkpoint_dir  # noqa: F401
