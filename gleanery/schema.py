"""Schemas of the tables of an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = """file_id string, relative_path string, filename string, format string, mime_family string, fingerprint_hash string, size long,
modified_at_ms double, extraction_status string, index_status string, content_hash string, last_error string, chunk_count int,
extractor_version int, chunker_version int, schema_version int"""
CHUNKS = """chunk_id string, file_id string, relative_path string, filename string, format string, ordinal int, display_text string, search_text string,
embedding_input_hash string, embedding_model string, vector array<float>, start_line int, end_line int, start_offset long, end_offset long,
heading_trail array<string>, symbols array<string>, content_hash string, file_content_hash string, token_count int"""
POSTINGS = "unit string, chunk_id string, file_id string, length int, positions array<int>"
LENGTHS = "chunk_id string, file_id string, length int"
CELLS = "cell int, chunk_id string, file_id string, format string, vector array<float>"
QUANTISER = "cell int, centre array<double>, trained_on long, file_id string"
GENERATIONS = "file_id string, generation long"
TABLES = {"files": FILES, "chunks": CHUNKS, "postings": POSTINGS, "lengths": LENGTHS, "cells": CELLS, "quantiser": QUANTISER, "generations": GENERATIONS}

#: Terms are spread over so many folders; within a folder, files and row groups hold ranges of terms.
BUCKETS = 64
#: Tables kept in folders: by which column, and the order within.
LAYOUT = {"postings": ("bucket", ["unit", "chunk_id"]), "cells": ("cell", ["chunk_id"])}


def bucket(unit: Column) -> Column:
    """The folder of a term's postings."""
    return F.pmod(F.xxhash64(unit), F.lit(BUCKETS)).cast("int")


def placed(df: DataFrame, table: str) -> DataFrame:
    """df with the column that names its rows' folders."""
    return df.withColumn("bucket", bucket(F.col("unit"))) if table == "postings" else df


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def conformed(df: DataFrame, table: str) -> DataFrame:
    """df with the table's columns, in its order and types."""
    shape = empty(df.sparkSession, table).schema
    return df.select(*[df[f.name].cast(f.dataType) for f in shape])
