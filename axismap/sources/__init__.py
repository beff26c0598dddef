"""Readers and writers: PAF, UCSC chain, BED, TSV and the Parquet store."""
