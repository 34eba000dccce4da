"""Named queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratograph.llm import credentials, documented, language, mixing, packing, spans, tokens, written
from stratograph.session import cut
from stratograph.sources.tables import table


def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    return written.module_evidence(*(table(spark, folder, t) for t in ("module_nodes", "symbol_nodes", "class_nodes", "cache_files", "vendored_files")))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return written.unwritten_modules(_evidence(spark, folder)).select("id")


def p1_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return written.unwritten_modules(_evidence(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return documented.documented_ids(table(spark, folder, "symbol_nodes"))


def p2_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return documented.documented_functions(table(spark, folder, "symbol_nodes"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return credentials.credential_lines(table(spark, folder, "symbol_nodes")).select("id", "field", "line_no").distinct()


def p6_masked(spark: SparkSession, folder: str) -> DataFrame:
    return credentials.masked_texts(table(spark, folder, "symbol_nodes"))


def _codes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "symbol_nodes", "id", "code").withColumnRenamed("code", "text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.sharing_pairs(spans.sharing(_codes(spark, folder)))


def p7_shared(spark: SparkSession, folder: str) -> DataFrame:
    codes = _codes(spark, folder)
    return spans.shared_share(codes, spans.sharing(codes))


def p7_classes(spark: SparkSession, folder: str) -> DataFrame:
    codes = _codes(spark, folder)
    return spans.sharing_classes(codes, spans.sharing(codes))


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Token sizes, computed once per query: several passes read them."""
    return cut(tokens.token_sizes(table(spark, folder, "documents")))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_containers(_sizes(spark, folder), table(spark, folder, "pack_specs"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    specs = table(spark, folder, "pack_specs")
    return packing.fill_report(packing.fill_containers(_sizes(spark, folder), specs), specs)


def p9_copies(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(_sizes(spark, folder), table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    targets = table(spark, folder, "mix_targets")
    return mixing.mix_report(mixing.mix_sources(_sizes(spark, folder), targets), targets)


def _model(spark: SparkSession, folder: str) -> language.Model:
    return language.fit_model(table(spark, folder, "documents"), table(spark, folder, "language_codes"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return language.mislabelled(table(spark, folder, "documents"), table(spark, folder, "language_codes"), _model(spark, folder))


def p10_segments(spark: SparkSession, folder: str) -> DataFrame:
    return language.segment_languages(table(spark, folder, "documents"), _model(spark, folder))


QUERIES = {f.__name__: f for f in (p1_found, p1_reasons, p2_found, p2_pairs, p6_found, p6_masked, p7_found, p7_shared, p7_classes, p8_containers, p8_fill, p9_copies, p9_shares, p10_found, p10_segments)}

ORACLES: dict[str, str] = {}
