"""tessera: a PySpark star-schema, engagement-analytics and scoring library.

Sub-packages:
  sources    - scans, ingestion, sinks, write-back, load audit, test bindings
  functions  - Column-level rules (calendar parts, age bands, zones, ratios)
  operators  - dimension/fact builders, measures, quality rules, features,
               recommendation, segmentation, churn scoring
  plans      - the registered queries and their SQL oracles
  streaming  - stream validation of arriving rows against an id mirror
"""

from tessera.session import get_session, checkpoint_dir  # noqa: F401
