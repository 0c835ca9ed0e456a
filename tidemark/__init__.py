"""Tidemark: DataFrame operators for feeds, storage listings, text style, research timelines and governance audits."""
