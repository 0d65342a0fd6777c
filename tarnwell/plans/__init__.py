"""From a question to lazy DataFrames: metadata, rules, routing and compilation."""
