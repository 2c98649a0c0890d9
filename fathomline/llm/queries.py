"""Queries of the operators for training data, and the SQL of those that SQL can state on whole tables."""

from __future__ import annotations

from fathomline.llm import credentials, mixing, pieces, provenance, residue, tokens, vectors
from fathomline.plans.registry import Registry
from fathomline.session import materialise
from fathomline.tables import table

registry = Registry()


@registry.query("p3_found")
def p3_found(spark, sf):
    return vectors.similar_pairs(vectors.nearest_vectors(table(spark, sf, "chunks")))


@registry.query("p3_neighbours")
def p3_neighbours(spark, sf):
    return vectors.nearest_vectors(table(spark, sf, "chunks"))


@registry.query("p4_found")
def p4_found(spark, sf):
    return provenance.not_handwritten(table(spark, sf, "chunks"))


@registry.query("p4_classes")
def p4_classes(spark, sf):
    return provenance.classify_files(table(spark, sf, "chunks"))


@registry.query("p5_found", "select distinct id from chunks where id is not null and octet_length(encode(content)) > 4096")
def p5_found(spark, sf):
    return pieces.split_oversized(table(spark, sf, "chunks")).select("id").distinct()


@registry.query("p5_pieces")
def p5_pieces(spark, sf):
    return pieces.split_oversized(table(spark, sf, "chunks"))


@registry.query("p6_found")
def p6_found(spark, sf):
    return credentials.credential_lines(table(spark, sf, "chunks"))


@registry.query("p6_redacted")
def p6_redacted(spark, sf):
    return credentials.redacted(table(spark, sf, "chunks"))


@registry.query("p6_located")
def p6_located(spark, sf):
    """Every credential with its key path, kind and byte span."""
    return credentials.locate(table(spark, sf, "chunks"))


@registry.query("p8_ids")
def p8_ids(spark, sf):
    return tokens.encode_corpus(table(spark, sf, "documents"), "doc_id", "text")


def _counted(spark, sf, *columns):
    return tokens.count_tokens(table(spark, sf, "documents"), [*columns, "source"], "text")


@registry.query("p9_found")
def p9_found(spark, sf):
    """The sources whose targets the balancing cannot meet: Newton steps on their dual end without a solution."""
    histogram = materialise(mixing.token_histogram(_counted(spark, sf)), "histogram")
    plan = mixing.balance(histogram, table(spark, sf, "mix_targets"))
    return spark.createDataFrame([(r["source"],) for r in plan if r["falls_short"]], "source string")


@registry.query("p9_report")
def p9_report(spark, sf):
    counted = materialise(_counted(spark, sf, "doc_id"), "tokens")
    plan = mixing.balance(materialise(mixing.token_histogram(counted), "histogram"), table(spark, sf, "mix_targets"), spread=True)
    return mixing.mixture_report(counted, "doc_id", plan)


@registry.query("p9_copies")
def p9_copies(spark, sf):
    counted = materialise(_counted(spark, sf, "doc_id"), "tokens")
    plan = mixing.balance(materialise(mixing.token_histogram(counted), "histogram"), table(spark, sf, "mix_targets"), spread=True)
    return mixing.copies(counted, "doc_id", plan).where("copies > 0")


@registry.query("p10_found")
def p10_found(spark, sf):
    return residue.flag_residue(table(spark, sf, "documents"), "doc_id", "text").where("is_residue").select("doc_id")


@registry.query("p10_clean")
def p10_clean(spark, sf):
    """The documents that are content."""
    return residue.without_residue(table(spark, sf, "documents"), "text")
