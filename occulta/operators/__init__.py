"""Detection, lists, vault and masking over DataFrames."""
