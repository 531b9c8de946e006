"""From documents to token files: five stages, each written as Parquet and read by the next.

A stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.
"""

from larder.llm import decontaminate, mixing, near_copies as near, tokens, toxicity
from larder.llm.common import stored
from larder.llm.queries import table, tokenizer_path

# A fitted model and token files cannot be expressed in SQL.
ORACLE_SQL = None


def toxic(spark, docs, sf_dir):
    """Documents that the toxicity model rejects go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies(spark, docs, sf_dir):
    """Of each group one document stays: linked by SimHash fingerprints, or by a Jaccard of 0.8 of five-word sets."""
    return near.first_of_each(docs)


def benchmark_leaks(spark, docs, sf_dir):
    """Documents that overlap a benchmark item go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark, docs, sf_dir):
    """Documents as often as the mix of their sources takes them, no more than three times."""
    return mixing.mixed_documents(docs)


def token_files(spark, docs, sf_dir):
    """Token files in the shared folder, and a row per document read back from them."""
    return tokens.encoded(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxic),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmark_leaks),
    ("mix_sources", mixed),
    ("token_output", token_files),
]


def run(spark, sf_dir):
    """All stages over documents; the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
