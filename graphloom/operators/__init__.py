"""Graph operators on vertex and edge DataFrames."""
