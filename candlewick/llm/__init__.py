"""Operators for training-data pipelines: secrets, toxicity, near-duplicate joins, decontamination, chat formatting, WARC, packing, URL filters, quality rules, language-model scoring."""
