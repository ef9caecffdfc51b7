"""Row-stateless scoring of streaming DataFrames."""
