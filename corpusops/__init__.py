"""corpusops: DataFrame-in, DataFrame-out operators for curating text corpora and analysing model evaluations."""
