"""Dataset catalogues, file datasets and attachments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowtrail.functions.text import format_file_size

# Marker directories and the kind each one stands for, in listing order.
MARKERS = {
    ".table-dataset": "table",
    ".file-dataset": "file",
    ".point-cloud-dataset.v1": "point cloud",
    ".raster-dataset.v1": "raster",
}


def discover_datasets(paths: DataFrame) -> DataFrame:
    """(name, kind) of the datasets in a listing of file paths.

    A dataset is the parent of a marker directory. Nothing is found below hidden directories,
    ``target`` or ``*.gpkg``, nor below a marker.
    """
    parts = F.split("path", "/")
    markers = F.array(*map(F.lit, MARKERS))
    # The file name itself is no directory.
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    spots = F.filter(
        F.transform(folders, lambda p, i: F.when(F.array_contains(markers, p), i + 1)), lambda i: i.isNotNull()
    )
    at = F.try_element_at(spots, F.lit(1))
    above = F.slice("_folders", F.lit(1), F.col("_at") - 1)
    hidden = F.exists(above, lambda p: p.startswith(".") | (p == "target") | p.endswith(".gpkg"))
    kinds = F.create_map(*[F.lit(x) for pair in MARKERS.items() for x in pair])
    rows = paths.select(folders.alias("_folders"), at.alias("_at")).filter(F.col("_at").isNotNull())
    return rows.filter(~hidden).select(
        F.array_join(above, "/").alias("name"), kinds[F.element_at("_folders", F.col("_at"))].alias("kind")
    ).distinct()


def list_datasets(catalogue: DataFrame) -> DataFrame:
    """(label, kind, name) in listing order: ``name (kind)``, grouped by kind, then the name."""
    rank = F.array_position(F.array(*map(F.lit, MARKERS.values())), F.col("kind"))
    rows = catalogue.select(F.concat("name", F.lit(" ("), "kind", F.lit(")")).alias("label"), "kind", "name")
    return rows.orderBy(rank, "name")


def count_datasets(catalogue: DataFrame) -> DataFrame:
    """Datasets per kind and their total (``kind`` NULL)."""
    per_kind = catalogue.groupBy("kind").agg(F.count(F.lit(1)).alias("datasets"))
    total = per_kind.agg(F.coalesce(F.sum("datasets"), F.lit(0)).alias("datasets"))
    return per_kind.unionByName(total.select(F.lit(None).cast("string").alias("kind"), "datasets"))


def dataset_info(columns: DataFrame, counts: DataFrame, attachments: DataFrame) -> DataFrame:
    """One row per dataset: columns, features, key list, geometry columns, attachment flags.

    ``columns`` is a column catalogue, ``counts`` has dataset and features, ``attachments`` dataset
    and name.
    """
    geometry = F.concat(
        "name", F.lit(" ("), F.coalesce("geometry_type", F.lit("GEOMETRY")), F.lit(") ["),
        F.coalesce("geometry_crs", F.lit("unknown CRS")), F.lit("]"),
    )

    def listing(when, order, text):
        entries = F.array_sort(F.collect_list(F.when(when, F.struct(order.alias("o"), text.alias("t")))))
        return F.array_join(F.transform(entries, lambda e: e["t"]), ", ")

    key, spot = F.col("primary_key_index"), F.col("position")
    shape = columns.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("columns"),
        listing(key.isNotNull(), key, F.col("name")).alias("primary_key"),
        listing(F.col("data_type") == "geometry", spot, geometry).alias("geometry"),
    )
    flags = attachments.groupBy("dataset").agg(
        F.bool_or(F.col("name") == "metadata.xml").alias("has_metadata"),
        F.bool_or(F.col("name").isin("license", "license.xml")).alias("has_license"),
    )
    joined = shape.join(counts, "dataset", "left").join(flags, "dataset", "left")
    return joined.fillna({"features": 0, "has_metadata": False, "has_license": False})


def count_files(files: DataFrame) -> DataFrame:
    """Files per dataset."""
    return files.groupBy("dataset").agg(F.count(F.lit(1)).alias("files"))


def file_inventory(files: DataFrame) -> DataFrame:
    """(dataset, name, size) with sizes for people, out of dataset, name and length."""
    return files.select("dataset", "name", format_file_size(F.col("length")).alias("size"))


def add_files(inventory: DataFrame, new: DataFrame) -> DataFrame:
    """``inventory`` with ``new`` files; the same name in a dataset is replaced."""
    kept = inventory.join(new.select("dataset", "name"), ["dataset", "name"], "left_anti")
    return kept.unionByName(new)


def rm_files(inventory: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The remaining files and a report (dataset, name, outcome Removed or Not found)."""
    keys = ["dataset", "name"]
    there = inventory.select(*keys, F.lit(True).alias("_there"))
    outcome = F.when(F.col("_there"), "Removed").otherwise("Not found")
    report = doomed.select(*keys).distinct().join(there, keys, "left").select(*keys, outcome.alias("outcome"))
    return inventory.join(doomed.select(*keys), keys, "left_anti"), report


def attachments_set(datasets: DataFrame, uploads: DataFrame) -> DataFrame:
    """(dataset, kind, name, content, accepted) of uploaded documents.

    ``uploads`` has dataset, ``role`` (metadata or license) and content. XML is content that starts
    with ``<`` after blanks. Metadata is stored as ``metadata.xml`` and must be XML for table
    datasets; a licence is ``license.xml`` or ``license``. A dataset that is both table and file
    takes the document as a table; an unknown dataset accepts none.
    """
    # Only table and file datasets take documents; one of the two is chosen before the join.
    best = F.min(F.array_position(F.array(F.lit("table"), F.lit("file")), F.col("kind")))
    owners = (
        datasets.filter(F.col("kind").isin("table", "file")).groupBy(F.col("name").alias("dataset"))
        .agg(F.when(best == 1, "table").otherwise("file").alias("kind"))
    )
    xml = F.ltrim(F.regexp_replace("content", r"^\s+", "")).startswith("<")
    is_metadata = F.col("role") == "metadata"
    name = F.when(is_metadata, "metadata.xml").when(xml, "license.xml").otherwise("license")
    accepted = F.col("kind").isNotNull() & (~is_metadata | (F.col("kind") == "file") | xml)
    joined = uploads.join(owners, "dataset", "left")
    return joined.select("dataset", "kind", name.alias("name"), "content", F.coalesce(accepted, F.lit(False)).alias("accepted"))


def metadata_show(attachments: DataFrame) -> DataFrame:
    """(dataset, kind, content): the metadata document of every dataset, of its table before its file."""
    rows = attachments.filter(F.col("name") == "metadata.xml")
    best = F.min_by(F.struct("kind", "content"), F.struct((F.col("kind") != "table").alias("rank"), "content"))
    return rows.groupBy("dataset").agg(best.alias("_best")).select("dataset", "_best.*")


def attachments_show(attachments: DataFrame) -> DataFrame:
    """The licence to show per dataset: table before file, plain before XML.

    ``attachments`` has dataset, kind, name and content.
    """
    rank = F.when(F.col("kind") == "table", 0).otherwise(2) + F.when(F.col("name") == "license", 0).otherwise(1)
    rows = attachments.filter(F.col("name").isin("license", "license.xml"))
    best = F.min_by(F.struct("kind", "name", "content"), F.struct(rank.alias("rank"), "content"))
    return rows.groupBy("dataset").agg(best.alias("_best")).select("dataset", "_best.*")
