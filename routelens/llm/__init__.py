"""Training-data operators: packing, licence scans, chat formatting, exact top-k, de-duplication,
toxicity, token files and source mixing.  Nothing else in the library imports this package."""
