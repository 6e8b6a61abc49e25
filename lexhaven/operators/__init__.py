"""DataFrame-to-DataFrame operators: extract, split, identify, embed, upsert, search, render, report."""
