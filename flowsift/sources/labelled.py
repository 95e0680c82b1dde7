"""Labelled dataset sources: CSV with varying headers, and Zeek connection logs."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsift.constants import CSV_ALIASES, LENIENT_ALIASES, OBSERVATION_MISSING, OBSERVATION_NOTE, OBSERVATION_TYPE, UNMATCHED, ZEEK_FIELDS
from flowsift.functions.labels import exact_label, substring_label
from flowsift.functions.net import int_div
from flowsift.operators.ordered import CHUNK_ROWS, rank_rows
from flowsift.sources.files import file_hashes, for_join, header_lines, listed, names

NO_OBSERVATIONS = "path string, raw_label string, label string, measurements map<string,string>, model_ready boolean"
PROVENANCE = ", sha256 string, row bigint, raw_fields map<string,string>"


def header_cells(line: str | None) -> list[str]:
    return next(csv.reader([line])) if line else []


def _plain_name(header: str) -> str:
    return header.strip().lower()


def _loose_name(header: str) -> str:
    return _plain_name(header).replace("_", " ").replace("-", " ")


def resolve_headers(headers: list[str], aliases: dict[str, list[str]], clean=_plain_name) -> dict[str, int]:
    """Canonical column -> position; of several spellings the first listed one wins."""
    at = {clean(h): i for i, h in enumerate(headers)}
    return {name: at[hit] for name, spellings in aliases.items() for hit in [next((s for s in spellings if s in at), None)] if hit}


def _by_header(files: DataFrame) -> dict[tuple[str, ...], list[str]]:
    """Files by their header; the headers are read in tasks, and one row a file comes back."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in sorted(header_lines(files).select("load_path", "header").collect()):
        headers = header_cells(row["header"])
        if headers:
            groups.setdefault(tuple(headers), []).append(row["load_path"])
    return groups


def _cells(spark: SparkSession, paths: list[str], width: int) -> DataFrame:
    schema = ", ".join(f"_c{i} string" for i in range(width))
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option(
        "ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(paths).withColumns({
            "path": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"),
            "_mid": F.monotonically_increasing_id()})


def number_rows(rows: DataFrame, out: str = "row_index") -> DataFrame:
    """0-based row number within its file, from the split start and the row's place in the split."""
    starts = rows.groupBy("path", "_block").agg(F.min("_mid").alias("_from"))
    placed = rows.join(starts, ["path", "_block"]).withColumn("_place", F.col("_block") + F.col("_mid") - F.col("_from"))
    return rank_rows(placed, ["path"], "_place", out, chunk=int_div(F.col("_place"), CHUNK_ROWS)).withColumn(
        out, F.col(out) - 1).drop("_place", "_from")


def read_labelled_csv(spark: SparkSession, folder: str, dataset: str, provenance: bool = False) -> DataFrame:
    """Observations of all CSV files below a folder, label mapped, unmatched rows flagged.

    One scan per distinct header. Backward-direction columns have no alias, so they never become
    measurements. With provenance: file hash, source row number and the raw cells.
    """
    parts = []
    files = listed(spark, folder, ".csv")
    for headers, paths in _by_header(files).items():
        at = resolve_headers(list(headers), CSV_ALIASES)
        if "label" not in at:
            continue
        rows = _cells(spark, paths, len(headers))
        cell = lambda i: F.nullif(F.trim(F.col(f"_c{i}")), F.lit(""))
        pairs = [x for n, i in at.items() if n != "label" for x in (F.lit(n), cell(i))]
        measured = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        rows = rows.withColumns({
            "raw_label": F.coalesce(cell(at["label"]), F.lit("")), "measurements": measured,
            "raw_fields": F.map_from_arrays(
                F.array(*[F.lit(h) for h in dict.fromkeys(headers)]),
                F.array(*[F.col(f"_c{len(headers) - 1 - headers[::-1].index(h)}") for h in dict.fromkeys(headers)]))})
        parts.append(rows.select("path", "_block", "_mid", "raw_label", "measurements", "raw_fields"))
    if not parts:
        return spark.createDataFrame([], NO_OBSERVATIONS + (PROVENANCE if provenance else ""))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return _observations(rows, files, dataset, provenance, first_row=2)


def _observations(rows: DataFrame, files: DataFrame, dataset: str, provenance: bool, first_row: int) -> DataFrame:
    rows = rows.withColumn("label", exact_label(F.col("raw_label"), dataset)).withColumn("model_ready", F.lit(False))
    keep = ["path", "raw_label", "label", "measurements", "model_ready"]
    if not provenance:
        return rows.select(*keep)
    return number_rows(rows).join(for_join(file_hashes(files).drop("load_path")), "path", "left").select(
        *keep, "sha256", (F.col("row_index") + first_row).alias("row"), "raw_fields")


def matched(observations: DataFrame) -> DataFrame:
    return observations.filter(F.col("label") != UNMATCHED)


def unlabelled_files(spark: SparkSession, folder: str, lenient: bool = False) -> DataFrame:
    """path of the CSV files that have no label column, or no header at all: the readers have no rows of them."""
    aliases, clean = (LENIENT_ALIASES, _loose_name) if lenient else (CSV_ALIASES, _plain_name)
    labelled = {
        r["path"] for r in header_lines(listed(spark, folder, ".csv")).collect()
        if "label" in resolve_headers(header_cells(r["header"]), aliases, clean)}
    return spark.createDataFrame([(n,) for n in names(spark, folder, ".csv") if n not in labelled], "path string")


def load_report(observations: DataFrame, unlabelled: DataFrame | None = None) -> DataFrame:
    """Rows, kept, unmatched and invalid rows per file, and the files that could not be read as labelled.

    Invalid rows have fewer cells than a header or none to go by; they are counted as unmatched too.
    """
    report = observations.groupBy("path").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label") != UNMATCHED).alias("ok"),
        F.count_if(F.col("label") == UNMATCHED).alias("unmatched"),
        F.count_if(F.size("measurements") <= 0).alias("invalid")).withColumn("unlabelled", F.lit(False))
    if unlabelled is None:
        return report
    none = F.lit(0).cast("bigint")
    return report.unionByName(unlabelled.select(
        "path", *[none.alias(n) for n in ("rows", "ok", "unmatched", "invalid")], F.lit(True).alias("unlabelled")))


def dropped_labels(observations: DataFrame) -> DataFrame:
    return observations.filter(F.col("label") == UNMATCHED).groupBy("raw_label").agg(F.count(F.lit(1)).alias("n"))


def read_zeek(
    spark: SparkSession, folder: str, dataset: str = "iot23", provenance: bool = False, endings=(".log*",),
) -> DataFrame:
    """Observations of Zeek connection logs; each file's #fields line names its columns."""
    files = listed(spark, folder, *endings)
    # The paths alone, as the reader takes them.
    paths = sorted(r["load_path"] for r in files.select("load_path").collect())
    if not paths:
        return spark.createDataFrame([], NO_OBSERVATIONS + (PROVENANCE if provenance else ""))
    lines = spark.read.text(paths).withColumns({
        "path": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"),
        "_mid": F.monotonically_increasing_id()})
    headers = for_join(header_lines(files, "#fields").select("path", F.col("header").alias("_head")))
    numbered = number_rows(lines) if provenance else lines
    words = F.split(F.trim("value"), r"\s+")
    # A file without a #fields line keeps its rows: they have no measurement and no label.
    rows = numbered.filter(~F.col("value").startswith("#")).join(headers, "path", "left").withColumns({
        "_head": F.coalesce("_head", F.lit("#fields"))}).withColumns({
        "_names": F.slice(F.split(F.trim("_head"), r"\s+"), F.lit(2), F.size(F.split(F.trim("_head"), r"\s+"))),
        "_words": words})

    def named(*names: str) -> Column:
        spots = F.array(*[F.array_position("_names", n) for n in names])
        at = F.array_max(spots).cast("int")
        return F.when(at > 0, F.nullif(F.get("_words", at - 1), F.lit("")))

    label = named(*[k for k, v in ZEEK_FIELDS.items() if v == "label"])
    measures = {v: k for k, v in ZEEK_FIELDS.items() if v != "label"}
    measured = F.map_filter(
        F.create_map(*[x for v, k in measures.items() for x in (F.lit(v), named(k))]),
        lambda k, v: F.array_contains("_names", F.element_at(F.create_map(*[F.lit(x) for kv in measures.items() for x in kv]), k)))
    rows = rows.withColumns({
        "raw_label": F.coalesce(label, F.lit("")), "measurements": measured,
        "raw_fields": F.map_from_entries(F.filter(F.arrays_zip("_names", "_words"), lambda e: e["_names"].isNotNull()))})
    out = rows.withColumn("label", exact_label(F.col("raw_label"), dataset)).withColumn("model_ready", F.lit(False))
    keep = ["path", "raw_label", "label", "measurements", "model_ready"]
    if not provenance:
        return out.select(*keep)
    return out.join(for_join(file_hashes(files).drop("load_path")), "path", "left").select(
        *keep, "sha256", (F.col("row_index") + 1).alias("row"), "raw_fields")


def read_iot23(spark: SparkSession, folder: str, provenance: bool = False, log_endings=(".log*",)) -> DataFrame:
    """Observations of a folder that holds Zeek logs (``.log`` in the name) and CSV files side by side.

    A CSV file whose name holds ``.log`` is read both ways, as a log and as CSV.
    """
    return read_zeek(spark, folder, "iot23", provenance, log_endings).unionByName(read_labelled_csv(spark, folder, "iot23", provenance))


def observation_records(observations: DataFrame) -> DataFrame:
    """Matched observations with provenance as export records: measurements and source, never a model's input."""
    return matched(observations).select(
        F.lit(OBSERVATION_TYPE).alias("record_type"), "row", "measurements", "label",
        F.struct("path", "sha256", "row", "raw_fields").alias("source"), "model_ready",
        F.array(*[F.lit(m) for m in OBSERVATION_MISSING]).alias("missing_features"), F.lit(OBSERVATION_NOTE).alias("note"))


def read_lenient_csv(spark: SparkSession, path: str, limit: int | None = None, header_length_as_ttl: bool = False) -> DataFrame:
    """Labelled CSV rows (a file, or a folder of files, each with its own header) as flow records.

    A file without a label column gives no rows; ``unlabelled_files`` names it. Without any labelled file the read
    fails. Missing or non-finite numbers take defaults. Rows whose label maps to no class carry label
    NULL, so they can be counted. ``limit`` is the caller's wish to stop after that many usable rows.
    """
    aliases = dict(LENIENT_ALIASES)
    if not header_length_as_ttl:
        aliases["ttl"] = [a for a in aliases["ttl"] if a != "fwd header length"]
    flows = None
    for headers, paths in _by_header(listed(spark, path, ".csv")).items():
        at = resolve_headers(list(headers), aliases, _loose_name)
        if "label" not in at:
            continue
        rows = _cells(spark, paths, len(headers))
        own = lenient_flow(number_rows(rows.withColumn("label", substring_label(F.col(f"_c{at['label']}")))), at)
        flows = own if flows is None else flows.unionByName(own)
    if flows is None:
        raise ValueError(f"no CSV file with a label column below {path}")
    if limit is not None:
        flows = flows.filter(F.col("label").isNotNull()).orderBy("path", "row_index").limit(limit)
    return flows


def lenient_number(cell: Column | None, default=0.0) -> Column:
    """A cell as a double; missing, zero-length, NaN or infinite cells give the default."""
    default = default if isinstance(default, Column) else F.lit(float(default))
    if cell is None:
        return default
    text = F.lower(F.trim(cell))
    value = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"), text.try_cast("double"))
    finite = ~F.isnan(value) & ~F.abs(value).isin(float("inf"))
    return F.coalesce(F.when(finite, value), default)


def lenient_flow(rows: DataFrame, at: dict[str, int]) -> DataFrame:
    cell = lambda n: F.col(f"_c{at[n]}") if n in at else None
    num = lambda n, d=0.0: lenient_number(cell(n), d)
    mean, packets, size, duration = num("fwd_pkt_len_mean"), num("fwd_packets"), num("fwd_bytes"), num("flow_duration")
    gap = num("fwd_iat_mean")
    gap = F.when((gap <= 0) & (packets > 1) & (duration > 0), duration / F.greatest(F.lit(1.0), packets - 1)).otherwise(gap)
    gap = F.when(gap > 1000, gap / 1e6).otherwise(gap)
    possible = F.greatest(F.lit(1.0), packets * F.greatest(mean, F.lit(1.0)))
    ttl = num("ttl", 64).cast("int")
    none = F.lit(None)
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return rows.select(
        F.concat(F.lit("ext_"), stem, F.lit("_"), F.col("row_index").cast("string")).alias("flow_id"), "path", "row_index", "label",
        F.lit(0).alias("src_port"), num("dst_port").cast("int").alias("dst_port"),
        F.when(num("protocol", 6).cast("int") == 6, "TCP").otherwise("UDP").alias("protocol"),
        F.struct(num("fwd_pkt_len_min").alias("min"), num("fwd_pkt_len_max", mean).alias("max"), mean.alias("mean"),
                 num("fwd_pkt_len_std").alias("std")).alias("packet_size_stats"),
        F.struct(F.greatest(F.lit(0.0), gap).alias("mean"),
                 F.greatest(F.lit(0.0), num("fwd_iat_std") / 1e6).alias("std")).alias("inter_arrival_stats"),
        F.lit(0.0).alias("entropy"),
        F.when(size != 0, F.least(F.lit(1.0), size / possible)).otherwise(0.0).alias("byte_ratio"),
        F.when(ttl == 0, 64).otherwise(ttl).alias("ttl"),
        none.cast("string").alias("ja4"), none.cast("struct<mean:double,std:double>").alias("beacon_interval_stats"),
        none.cast("double").alias("dns_ngram_entropy"), none.cast("bigint").alias("fanout_count"))
