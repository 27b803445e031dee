"""Corpus-preparation operators for training data, each a plain DataFrame function.

Nothing outside this folder imports it; ``ragloom.llm.registry`` holds the
named queries and their SQL twins.
"""
