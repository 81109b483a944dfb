"""The answering job: questions to ranked chunks, with counts and quality."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from quarry.operators import embedding, search
from quarry.sources.scratch import stored


@dataclass
class Answers:
    ranked: DataFrame
    counters: DataFrame
    metrics: DataFrame
    response: DataFrame


def answer(questions: DataFrame, collection: DataFrame, encoder: embedding.Encoder | None = None, per_query: int = search.PER_QUERY, limit: int = search.GLOBAL_LIMIT) -> Answers:
    """Answers to all of ``questions`` (``user_query``) with the encoder that made the collection."""
    hits = stored(search.query_hits(questions, collection, lambda df, text: embedding.embed_chunks(df, encoder, text), per_query), "hits")
    ranked = search.rank_dedup(hits, limit)
    return Answers(ranked, search.search_counters(hits, ranked), search.quality_metrics(ranked, questions), search.search_response(ranked))
