"""Panel forecasting as DataFrame plans: features, candidates, backtests, ensembles."""
