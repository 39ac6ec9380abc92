"""helixmill: Spark-first curation, tokenisation and evaluation of sequence corpora."""

__version__ = "0.1.0"
