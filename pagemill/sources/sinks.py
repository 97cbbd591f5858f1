"""Writers of results: tables as CSV, JSON and Parquet, chunks, captions, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Column order of the exports.
CSV_COLUMNS = {
    "images": ("url", "source_page", "original_url", "alt_text", "score", "page_title", "mime_type", "width", "height", "status"),
    "videos": ("url", "source_page", "type", "score", "page_title", "mime_type", "duration_seconds", "status", "file_path", "failure_reason"),
    "pages": ("url", "depth", "status", "reason", "discovered_links", "images_found", "videos_found"),
    "rejected": ("kind", "url", "source_page", "reason", "score"),
}


def csv(rows: DataFrame, kind: str, path: str) -> None:
    """Columns that rows lack are written empty."""
    rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in CSV_COLUMNS[kind]]).write.mode("overwrite").option("header", True).csv(path)


def json_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, rows in tables.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")


def partitioned(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("append").partitionBy(*by).parquet(path)


def chunks(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def caption(prompt: Column, tags: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(prompt), F.lit("")), F.array_join(tags, ", "))


def dataset(rows: DataFrame, path: str) -> None:
    """Entries (file_name, prompt, tags, …) as JSON lines, with the caption that a side-car file would hold."""
    rows.withColumn("caption", caption(F.col("prompt"), F.col("tags"))).write.mode("overwrite").json(path)


def destination(layout: str, subject: str) -> Column:
    """Path of an exported file under one of three layouts: flat, domain, kind."""
    name = F.regexp_extract("file_path", "([^/]*)$", 1)
    folder = {"flat": F.lit(""), "domain": F.concat(F.coalesce(F.nullif(F.col("source_domain"), F.lit("")), F.lit("unknown")), F.lit("/")), "kind": F.concat(F.col("kind"), F.lit("s/"))}[layout]
    return F.concat(F.lit(f"{subject}/"), folder, name)


def markdown(reports: DataFrame) -> Column:
    return F.format_string("# %s\n\n- depth: %d\n- status: %s\n- images: %d\n- videos: %d\n", "url", "depth", "status", "images_found", "videos_found")


def domain_report(items: DataFrame) -> DataFrame:
    """host, kept, rejected and a map of its reasons; one row per host."""
    counts = items.groupBy("host", "reason").agg(F.count("*").alias("n"))
    reasons = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n")))))
    return counts.groupBy("host").agg(F.sum(F.when(F.col("reason").isNull(), F.col("n")).otherwise(0)).alias("kept"), F.sum(F.when(F.col("reason").isNotNull(), F.col("n")).otherwise(0)).alias("rejected"), reasons.alias("reasons"))


def dead_links(rows: DataFrame) -> DataFrame:
    return rows.select("url").distinct().orderBy("url")


def run_summary(overall: DataFrame, by_host: DataFrame, reasons: DataFrame, path: str) -> None:
    """One JSON document: a run's figures, its hosts (name to figures) and its most frequent reasons.

    What it collects is aggregates, one row a host and ten reasons; the document is made and written by Spark.
    """
    hosts = by_host.agg(F.sort_array(F.collect_list(F.struct("host", *[c for c in by_host.columns if c != "host"]))).alias("hosts"))
    top = reasons.orderBy(F.desc("n"), "reason").limit(10).agg(F.collect_list(F.struct("reason", "n")).alias("top_reasons"))
    one = lambda df, k: df.withColumn("__k", F.lit(k))  # noqa: E731 - single rows, joined on a constant
    doc = one(overall, 1).join(one(hosts, 1), "__k").join(one(top, 1), "__k").drop("__k")
    doc.coalesce(1).write.mode("overwrite").json(path)


def archive(files: DataFrame, path: str) -> int:
    """A ZIP of files (name, content) on the driver, one file in memory at a time, with metadata.json last; how many."""
    import json
    import zipfile

    names = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for row in files.select("name", "content").orderBy("name").toLocalIterator():
            z.writestr(row["name"], bytes(row["content"] or b""))
            names.append(row["name"])
        z.writestr("metadata.json", json.dumps({"files": len(names)}))
    return len(names)


def console_report(by_host: DataFrame, dead: DataFrame, rows: int = 1000) -> str:
    """A table of hosts by name (of the first `rows`; a report to look at) and the first ten dead links."""
    names = by_host.columns
    lines = [" | ".join(names)] + [" | ".join(str(r[c]) for c in names) for r in by_host.orderBy("host").limit(rows).collect()]
    return "\n".join([*lines, *(f"dead: {r['url']}" for r in dead_links(dead).limit(10).collect())])
