"""DataFrame operators: cleaning, candidates, pairs, judging, evaluation, comparison, agent."""
