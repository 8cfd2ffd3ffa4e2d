"""DataFrame operators for broadcasts: each takes DataFrames and returns a DataFrame, partitioned by broadcast_id."""
