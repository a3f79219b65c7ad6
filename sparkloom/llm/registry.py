"""The operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, jaccard, media, mixing, neighbours, pieces, repair, secrets, substrings, suffixes, tokens, toxicity, trie


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_codes": tokens.op1_token_codes,
        "op2_substrings": substrings.op2_substrings,
        "op3_suffixes": suffixes.op3_suffixes,
        "op4_pieces": pieces.op4_pieces,
        "op5_media": media.op5_media,
        "op6_jaccard": jaccard.op6_jaccard,
        "op7_secrets": secrets.op7_secrets,
        "op8_fingerprints": fingerprints.op8_fingerprints,
        "op9_mixing": mixing.op9_mixing,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_trie": trie.op11_trie,
        "op12_repair": repair.op12_repair,
        "op13_neighbours": neighbours.op13_neighbours,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_substrings": substrings.OP2_SQL, "op6_jaccard": jaccard.OP6_SQL, "op7_secrets": secrets.OP7_SQL, "op9_mixing": mixing.OP9_SQL, "op11_trie": trie.OP11_SQL, "op12_repair": repair.OP12_SQL}
