"""Population rates on Spark: cells, standardised rates, shares, code prevalence and panels."""
