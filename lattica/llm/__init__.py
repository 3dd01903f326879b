"""Training-data operators: filters, de-duplication, token counting, archives, mixing and packing."""
