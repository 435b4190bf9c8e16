"""Column expressions and the small Arrow-batched helpers behind them."""
