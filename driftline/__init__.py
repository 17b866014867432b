"""driftline: reconcile two large keyed snapshots with Spark and analyse what the reconciliation did."""
