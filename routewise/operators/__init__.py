"""DataFrame operators: timelines, features, candidates, policies, evaluation, ML."""
