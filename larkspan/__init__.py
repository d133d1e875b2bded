"""larkspan: counterfactual text-audit analytics as DataFrame operators on Spark."""
