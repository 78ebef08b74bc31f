"""Table operators: joins, pre-processing, evaluation, quality, fundamentals, markets, strategies."""
