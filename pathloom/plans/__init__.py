"""From the text of a path expression to what Spark runs: syntax, automaton, regular expression."""
