"""The training-data queries: pN_... by problem, each (spark, sf_dir) -> DataFrame over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusops.llm import answers, forms, leak, mixing, neardup, overlap, packing
from corpusops.llm.oracle import ORACLE  # noqa: F401
from corpusops.runtime import table


def p1_found(spark, sf_dir):
    rows = overlap.keyed_rows(table(spark, sf_dir, "final_rows"), "final_id", "split", "input")
    return overlap.cross_split_pairs(rows).select(F.col("id_a").alias("final_id_a"), F.col("id_b").alias("final_id_b"))


def _records(spark, sf_dir):
    return overlap.record_overlap(overlap.keyed_rows(table(spark, sf_dir, "final_rows"), "final_id", "split", "input"))


def p1_records(spark, sf_dir):
    return _records(spark, sf_dir).withColumnRenamed("id", "final_id")


def p1_report(spark, sf_dir):
    return overlap.overlap_report(table(spark, sf_dir, "final_rows"), _records(spark, sf_dir), "final_id", "split", "source")


def _mixed(spark, sf_dir):
    rows = mixing.sized_rows(table(spark, sf_dir, "final_rows"), "final_id", "source", "source_subtype", "condition_input_ids", "input_ids")
    return mixing.mix(rows, table(spark, sf_dir, "mix_targets"))


def p2_mix(spark, sf_dir):
    return _mixed(spark, sf_dir)[0].withColumnRenamed("id", "final_id")


def p2_shares(spark, sf_dir):
    return _mixed(spark, sf_dir)[1]


def _judged(spark, sf_dir):
    return answers.defective_pairs(table(spark, sf_dir, "prepared_rows").where("filter_reason = ''"), "row_id", "input", "target", "gold_answer")


def p3_found(spark, sf_dir):
    return _judged(spark, sf_dir).withColumnRenamed("id", "row_id")


def p3_report(spark, sf_dir):
    rows = table(spark, sf_dir, "prepared_rows").where("filter_reason = ''").select(F.col("row_id").alias("id"), mixing.label(F.col("source")).alias("source"))
    judged = rows.join(_judged(spark, sf_dir), "id", "left")
    return judged.groupBy("source", F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count("*").alias("rows"))


def p4_found(spark, sf_dir):
    pairs = neardup.near_duplicate_pairs(table(spark, sf_dir, "prepared_rows"), "row_id", "question_key")
    return pairs.select(F.col("id_a").alias("row_id_a"), F.col("id_b").alias("row_id_b"))


def p4_groups(spark, sf_dir):
    groups = neardup.near_duplicate_groups(table(spark, sf_dir, "prepared_rows"), "row_id", "question_key")
    return groups.withColumnRenamed("id", "row_id")


def p5_containers(spark, sf_dir):
    sizes = packing.document_sizes(table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.pack(sizes, table(spark, sf_dir, "pack_profiles"))[0]


def p5_report(spark, sf_dir):
    sizes = packing.document_sizes(table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.pack(sizes, table(spark, sf_dir, "pack_profiles"))[1]


def p6_found(spark, sf_dir):
    found = leak.leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "question")
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"))


def p6_report(spark, sf_dir):
    items = table(spark, sf_dir, "eval_items")
    found = leak.leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", items, "item_id", "question")
    return leak.leak_report(found, items, "item_id", "suite")


def p7_found(spark, sf_dir):
    pairs = forms.look_alike_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p7_classes(spark, sf_dir):
    return forms.look_alike_classes(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p7_forms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", forms.consistent_form(F.col("text")).alias("form"))


QUERIES = {f.__name__: f for f in (p1_found, p1_records, p1_report, p2_mix, p2_shares, p3_found, p3_report, p4_found, p4_groups, p5_containers, p5_report, p6_found, p6_report, p7_found, p7_classes, p7_forms)}
