"""Symbol score and BM25 as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from codelake import settings as S


def symbol_score(name: Column, kind: Column, signature: Column, pattern: Column) -> Column:
    folded, needle = F.lower(name), F.lower(pattern)
    name_part = (
        F.when(folded == needle, S.SCORE_EXACT)
        .when(F.contains(folded, needle), S.SCORE_PARTIAL)
        .otherwise(0.0)
    )
    signature_part = F.when(F.length(signature) > 0, S.SCORE_SIGNATURE).otherwise(0.0)
    kind_part = F.lit(S.SCORE_OTHER_KIND)
    for value, worth in S.SCORE_KIND.items():
        kind_part = F.when(kind == value, worth).otherwise(kind_part)
    fixed = S.SCORE_BASE + S.SCORE_DEFINITION + S.SCORE_SYMBOL
    return F.lit(fixed) + name_part + signature_part + kind_part


def symbol_snippet(name: Column, kind: Column, signature: Column) -> Column:
    return F.coalesce(F.nullif(signature, F.lit("")), F.concat(kind, F.lit(": "), name))


def match_type(kind: Column) -> Column:
    return F.when(kind.isNull(), "text").otherwise(F.concat(F.lit("symbol:"), kind))


def inverse_document_frequency(n_chunks: Column, holding: Column) -> Column:
    idf = F.log((n_chunks - holding + 0.5) / (holding + 0.5))
    return F.when(idf > 0, idf).otherwise(S.BM25_MIN_IDF)


def bm25_part(tf: Column, length: Column, avg_length: Column, idf: Column) -> Column:
    norm = S.BM25_K1 * ((1 - S.BM25_B) + S.BM25_B * length / avg_length)
    return idf * tf * (S.BM25_K1 + 1) / (tf + norm)
