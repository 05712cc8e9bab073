"""Identity resolution over feature vectors on Spark: ingest, gates, similarity join, clustering, ledger, overrides, review and emission."""
