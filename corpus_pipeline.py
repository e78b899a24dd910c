"""The document pipeline: what a training run keeps of a crawl, cleaned and packed.

Each stage takes all that its predecessor kept. Stages 1 to 4 return the columns of documents; the last
returns pieces of token sequences. Between stages, the documents are a table on shared storage.
"""

from gridloom.llm import exact_dedup, near_dedup, packing, pii, quality_rules
from gridloom.llm.common import table, written
from gridloom.llm.queries import WORD_BPE, tokenizer

#: SQL can't express expectation-maximisation, Unicode-aware patterns with checks, nor the tokenizer.
ORACLE_SQL = None


def good_only(spark, docs, sf_dir):
    return quality_rules.keep_good(docs)


def without_copies(spark, docs, sf_dir):
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark, docs, sf_dir):
    return near_dedup.drop_near(docs)


def without_personal_data(spark, docs, sf_dir):
    return pii.redact(docs)


def packed(spark, docs, sf_dir):
    return packing.pack(docs, tokenizer(WORD_BPE))


STAGES: list = [
    ("quality_rules", good_only),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("pii", without_personal_data),
    ("packing", packed),
]


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
