"""DataFrame operators: words, patterns, matches, statistics, contexts, spans, joins."""
