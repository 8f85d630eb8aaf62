"""Training-data operators: ten independent DataFrame operators and their driver queries."""
