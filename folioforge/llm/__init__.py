"""Training-data operators: ten corpus jobs that read and write DataFrames."""
