"""Corpora as folders: selecting pages, checking files against manifests, and writing a whole vintage."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivana.functions.lists import explode_group, or_not_found
from scrivana.operators.events import layout_annotations
from scrivana.operators.index import examples, set_differences
from scrivana.operators.tables import render_tables
from scrivana.operators.windows import first_per_group
from scrivana.sources.config import FieldDefinitions
from scrivana.sources.vintages import files_of, lines_of, write_vintage
from scrivana.sources.readers import stem_of, write_csv, write_json
from scrivana.staging import spread


def of_types(pages: DataFrame, types: list[str] | None, known: list[str]) -> DataFrame:
    """Pages of some document types; an unknown type fails."""
    unknown = sorted(set(types or ()) - set(known))
    if unknown:
        raise ValueError(f"unknown document types {unknown}; expected some of {sorted(known)}")
    return pages if types is None else pages.where(F.col("doc_type").isin(types))


def limited(pages: DataFrame, n: int, per: str | None = None, order: str = "case_id") -> DataFrame:
    """The first n pages of each ``per``, or overall; overall, 0 sets no limit."""
    if per is not None:
        return first_per_group(pages, [per], [order], n)
    return pages.orderBy(order).limit(n) if n else pages


def family_and_severity(manifest: DataFrame, corpus: Column, family: str | None = None, severity: str | None = None) -> DataFrame:
    """Stated by the caller, else by the record, else by a corpus named ``<family>_<severity>``; otherwise it fails."""
    named = r"^([a-z]+)_([a-z]+)$"

    def settled(given: str | None, column: str, group: int) -> Column:
        guess = F.nullif(F.regexp_extract(corpus, named, group), F.lit(""))
        found = F.coalesce(F.lit(given), F.nullif(F.col(column), F.lit("")), guess)
        return F.coalesce(found, F.raise_error(F.concat(F.lit(f"no {column} for corpus "), corpus)).cast("string"))

    return manifest.withColumns({"family": settled(family, "family", 1), "severity": settled(severity, "severity", 2)})


def nested_or_flat(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Each (stem, doc_type) with the path below its type's folder, or else with the flat path."""
    nested = files.select(F.col("stem"), F.element_at(F.split("path", "/"), -2).alias("doc_type"), F.col("path").alias("_nested"))
    flat = files.groupBy("stem").agg(F.min("path").alias("_flat"))
    return wanted.join(nested, ["stem", "doc_type"], "left").join(flat, "stem", "left").withColumn("path", F.coalesce("_nested", "_flat")).drop("_nested", "_flat")


def file_faults(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(stem, fault): manifest files that are missing, or whose bytes have another hash."""
    stated = manifest.select("stem", F.col("sha256").alias("stated"))
    joined = stated.join(files.select("stem", F.col("sha256").alias("found")), "stem", "left")
    return joined.where(F.col("found").isNull() | (F.col("found") != F.col("stated"))).select("stem", F.when(F.col("found").isNull(), "missing").otherwise("hash").alias("fault"))


def vintage_faults(index: DataFrame, manifests: DataFrame) -> DataFrame:
    """Corpora of an index whose manifest is absent or has another hash than the index states."""
    found = manifests.select("corpus", F.col("manifest_sha256").alias("found"))
    return index.join(found, "corpus", "left").where(~F.col("manifest_sha256").eqNullSafe(F.col("found"))).select("corpus", "manifest_sha256", "found")


def refreshed(carried: DataFrame, tier_pages: DataFrame) -> DataFrame:
    """Carried metadata of exactly the pages that a tier's manifest names."""
    return carried.join(tier_pages.select("stem").distinct(), "stem", "left_semi")


#: Tiers that a page may have; more is a mistake, as every page is copied for each.
MOST_TIERS = 10_000


def in_tiers(pages: DataFrame, tiers: DataFrame) -> DataFrame:
    """Each page in each tier. Tiers are counted before they are broadcast."""
    n = tiers.count()
    if n > MOST_TIERS:
        raise ValueError(f"{n} tiers; at most {MOST_TIERS} are expected")
    return pages.crossJoin(F.broadcast(tiers))


def summary(manifest: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """(what, name, n): pages by type and family, pages with tables; with events, also blocks and spans by category, and
    pages of several tables."""
    parts = [manifest.groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("what"), "name", "n") for c in ("doc_type", "family")]
    parts.append(manifest.agg(F.count("tables").alias("n")).select(F.lit("tables").alias("what"), F.lit("pages with tables").alias("name"), "n"))
    if events is not None:
        drawn = events.where(F.col("category_type").isNotNull() & (F.size("spans") > 0))
        by = drawn.groupBy(F.col("category_type").alias("name")).agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.size("spans")).alias("spans"))
        parts += [by.select(F.lit(what).alias("what"), "name", F.col(what).cast("long").alias("n")) for what in ("blocks", "spans")]
        several = drawn.where("category_type = 'table'").groupBy("stem").count().where("count > 1")
        parts.append(several.agg(F.count(F.lit(1)).alias("n")).select(F.lit("tables").alias("what"), F.lit("pages with several").alias("name"), "n"))
    return reduce(DataFrame.union, parts)


def readme(manifest: DataFrame, title: str, events: DataFrame | None = None) -> str:
    """A corpus description from its counts; the summary has a row for each type, family and category only."""
    rows = sorted(tuple(r) for r in summary(manifest, events).collect())
    return "\n".join([f"# {title}", "", "| What | Name | Pages |", "|---|---|---|", *(f"| {w} | {n} | {k} |" for w, n, k in rows), ""])


def extraction_rows(entries: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row a case: case_id, doc_type, image, and every column as authored, the sentinel where there is nothing."""
    image = F.concat("case_id", F.lit("_"), "doc_type", F.lit(".png"))
    return entries.select("case_id", "doc_type", image.alias("image"), *(or_not_found(F.col("fields")[c]).alias(c) for c in columns))


def line_item_rows(entries: DataFrame, definitions: FieldDefinitions) -> DataFrame:
    """One row an item of each parallel group of an entry's own document type, items' columns in one schema.

    Columns that a type doesn't have are null; a group that is the sentinel alone has no rows; a ragged group fails.
    """
    out = None
    image = F.concat("case_id", F.lit("_"), "doc_type", F.lit(".png"))
    for doc_type, groups in definitions.parallel_groups.items():
        own = entries.where(F.col("fields")["DOCUMENT_TYPE"] == doc_type).withColumn("image", image)
        for names in groups:
            lists_ = own.select("case_id", "doc_type", "image", *(or_not_found(F.col("fields")[n]).alias(n) for n in names))
            rows = explode_group(lists_, {n: definitions.item_columns[n] for n in names}, ["case_id", "doc_type", "image"])
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("no parallel groups are defined")
    return out


def export_extraction(entries: DataFrame, manifest: DataFrame, definitions: FieldDefinitions, folder: str) -> None:
    """The authored truth beside a clean corpus: JSON lines and CSV of the cases, JSON lines of their items.

    The cases must be exactly those whose images the manifest names; nothing that stands there is overwritten.
    """
    rows = extraction_rows(entries, definitions.columns)
    differing = set_differences(rows.select(stem_of("image").alias("stem")), manifest.select(stem_of("image").alias("stem")), "stem")
    found = {r.side: (r.rows, list(r.examples)) for r in examples(differing, ["side"], "stem", 5).collect()}
    if found:
        raise ValueError(f"cases that only the truth has: {found.get('left', (0, []))}; that only the corpus has: {found.get('right', (0, []))}")
    write_json(rows.orderBy("doc_type", "case_id"), f"{folder}/ground_truth")
    write_csv(rows.orderBy("doc_type", "case_id"), f"{folder}/ground_truth_csv")
    write_json(line_item_rows(entries, definitions).orderBy("doc_type", "case_id", "line_no"), f"{folder}/line_items", keep_nulls=False)


def write_pages(pages: DataFrame, folder: str, suffix: str = ".md") -> None:
    """One text file for each (stem, text), as a vintage: all of them or none, in a folder that isn't there yet."""
    write_vintage(files_of(spread(pages), F.concat(F.col("stem").cast("string"), F.lit(suffix)), F.col("text")), folder)


def manifest_rows(pages: DataFrame, files: DataFrame, texts: DataFrame) -> DataFrame:
    """A manifest record a page: paths, labels, and hashes of the image's bytes and pixels and of the transcript.

    pages: (stem, doc_type, layout, family, severity). files: (stem, sha256, pixels_sha256). texts: (stem, text). A page
    without an image or a transcript fails.
    """
    both = pages.join(files.select("stem", "sha256", "pixels_sha256"), "stem", "left").join(texts.select("stem", F.sha2("text", 256).alias("transcript_sha256")), "stem", "left")
    lacking = F.raise_error(F.concat(F.lit("no image or transcript of page "), F.col("stem"))).cast("string")
    return both.select(
        "stem", F.concat(F.lit("images/"), "stem", F.lit(".png")).alias("image"), F.concat(F.lit("transcripts/"), "stem", F.lit(".md")).alias("transcript"),
        *("doc_type", "layout", "family", "severity", "pixels_sha256"), *(F.coalesce(F.col(c), lacking).alias(c) for c in ("sha256", "transcript_sha256")),
    )


def export(spark: SparkSession, manifest: DataFrame, events: DataFrame, rows: DataFrame, folder: str, texts: DataFrame | None = None, title: str = "Corpus") -> None:
    """Layout annotations, table HTML, transcripts, description and manifest of a corpus, committed at once as ``folder``,
    which must not be there yet.

    events, rows and texts carry ``stem``; a page with events but no annotation fails.
    """
    html = render_tables(rows, ["stem", "table_no"], "row_no")
    dets = layout_annotations(events, ["stem"], html)
    bare = events.select("stem").distinct().join(dets.select("stem"), "stem", "left_anti")
    if not bare.isEmpty():
        raise ValueError(f"no annotation on {[r.stem for r in bare.limit(5).collect()]}")
    whole = html.groupBy("stem").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_no", "html"))), lambda x: x["html"]), "\n").alias("html"))
    named = manifest.join(whole.select("stem", F.concat(F.lit("tables/"), "stem").alias("_tables")), "stem", "left").withColumn("tables", F.col("_tables")).drop("_tables")
    parts = [lines_of(dets, "layout"), lines_of(whole, "tables"), lines_of(named, "manifest", keep_nulls=False)]
    if texts is not None:
        parts.append(files_of(texts, F.concat(F.lit("transcripts/"), "stem", F.lit(".md")), F.col("text")))
    parts.append(spark.createDataFrame([("README.md", readme(named, title, events), False)], "path string, content string, line boolean"))
    write_vintage(reduce(DataFrame.unionByName, parts), folder)
