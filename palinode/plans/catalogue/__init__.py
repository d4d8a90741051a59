"""The registered queries, by area. Importing this package fills the registry."""

from palinode.plans.catalogue import chat, corpus, files, lm, runs, scoring, tokens, vocab  # noqa: F401
