"""The operators on the whole tables of a data folder."""

from __future__ import annotations

import public_tokenizers

from leafclock.llm import (
    ann,
    bpe,
    chat,
    html_extract,
    merkle,
    minhash,
    mixing,
    ngram_lm,
    quality_classifier,
    quality_rules,
    spelling,
    sql,
    toxicity,
    url_filter,
)

QUERIES: dict = {}
ORACLE: dict = {}

#: The public rank file; its place is a parameter of the operators.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_toxicity(spark, sf_dir):
    """Toxicity scores of all documents."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_byte_bpe(spark, sf_dir):
    """Digests of the token ids of all documents and of what they decode to."""
    return bpe.digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


@query
def op10_quality_classifier(spark, sf_dir):
    """Quality scores of all documents."""
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op1_mixing(spark, sf_dir):
    """What a mix of all documents takes of each."""
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op8_minhash(spark, sf_dir):
    """Groups of near-identical documents: shingles of three words, similarity 0.85."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


@query
def op9_ngram_lm(spark, sf_dir):
    """Log probabilities of all documents by a Kneser-Ney model of six of seven folds."""
    return ngram_lm.score_held_out(table(spark, sf_dir, "documents"))


@query
def op6_quality_rules(spark, sf_dir):
    """Measures of all documents, and whether rules and perplexity bands keep them."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@query
def op4_html_extract(spark, sf_dir):
    """Main text of all pages."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


#: Rules on hosts and paths, in no order.
URL_RULES = [
    url_filter.rule("block", "net/"),
    url_filter.rule("allow", "example.net/en/"),
    url_filter.rule("block", "example.com/de/"),
    url_filter.rule("allow", "org/fr/"),
]


@query
def op7_url_filter(spark, sf_dir):
    """Verdicts on the urls of all pages."""
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op3_cross_polytope(spark, sf_dir):
    """The ten nearest of every hundredth vector, among all vectors."""
    return ann.search(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


@query
def op11_chat_template(spark, sf_dir):
    """Digests of all conversations, formatted and read back."""
    return chat.digests(chat.with_planted(table(spark, sf_dir, "conversations"))).drop("formatted_sha256")


@query
def op12_spelling_variants(spark, sf_dir):
    """Words of all documents with their near words and the form that each is grouped under."""
    return spelling.variants(table(spark, sf_dir, "documents"))


@query
def op13_merkle_manifest(spark, sf_dir):
    """Proofs of all documents, checked after some were tampered with."""
    return merkle.audited(table(spark, sf_dir, "documents"))


ORACLE["op11_chat_template"] = sql.CHAT
ORACLE["op12_spelling_variants"] = sql.SPELLING
ORACLE["op13_merkle_manifest"] = sql.MERKLE
