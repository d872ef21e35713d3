"""Training-data operators: filters, deduplication, scoring, extraction, mixing.

Nothing outside this subpackage imports it. Besides PySpark, numpy and pyarrow
some modules need pyahocorasick, xxhash, regex, zstandard, tokenizers,
sentencepiece and the package that holds the vocabulary files.
"""
