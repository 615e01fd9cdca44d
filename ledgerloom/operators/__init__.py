"""DataFrame operators: evaluation, summaries, audit, serving, request logs."""
