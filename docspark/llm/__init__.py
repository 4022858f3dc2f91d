"""Operations for training-data corpora, each a function on DataFrames."""
