"""All registered queries: name -> (Spark query, SQL or None)."""

from checks import evaluate, features, ingest, wear

QUERIES = {**ingest.QUERIES, **features.QUERIES, **wear.QUERIES, **evaluate.QUERIES}
