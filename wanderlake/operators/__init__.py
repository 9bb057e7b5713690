"""Graph construction, walks, laws, validators and generators over DataFrames."""
