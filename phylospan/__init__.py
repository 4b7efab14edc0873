"""phylospan: lineage-divergence interval analytics expressed as Spark DataFrame operators."""
