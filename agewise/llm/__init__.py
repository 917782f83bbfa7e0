"""Training-data operators on Spark: de-duplication, decontamination, quality, mixing."""
