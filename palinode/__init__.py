"""Corpus, conversation and evaluation analytics on Spark, with text direction as a first-class choice."""
