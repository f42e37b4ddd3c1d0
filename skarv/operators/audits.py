"""Audit runs: the pages of each site audit as index rows, and what changed between audits."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarv.functions.arrow import slices
from skarv.functions.jsonio import as_list, parse
from skarv.functions.urls import normalize_url, url_col
from skarv.operators.bits import bit_set
from skarv.operators.snapshots import SnapshotIndex, chain, fetch_values
from skarv.runtime import cut, table_path
from skarv.sources.tables import latest

#: Reports that are Python objects at a time in a worker.
ROWS = 200
#: Fields of a page that are compared; schema.types counts as a set.
FIELDS = ("title", "metaDescription", "h1", "headings", "firstParagraph", "bodyText", "statusCode", "canonicalUrl", "noindex", "schema.types")


def _text(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, str):
        return " ".join(value.split())
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    if isinstance(value, (list, tuple)):
        return "\x1f".join(x for x in map(_text, value) if x)
    if isinstance(value, dict):
        return "\x1e".join(f"{k}={_text(value[k])}" for k in sorted(value))
    return str(value)


def page_fields(page: dict) -> list[str]:
    """The compared fields as texts: white space folded; absent, null, "" and [] as ""."""
    get = page.get
    schema = get("schema")
    types = as_list(schema.get("types")) if isinstance(schema, dict) else []
    return [_text(get(f)) for f in FIELDS[:-1]] + ["\x1f".join(sorted({_text(t) for t in types} - {""}))]


def _is_domain(request: str | None) -> bool:
    value = parse(request)
    mode = value.get("mode") if isinstance(value, dict) else None
    return mode is None or mode == "" or mode == "domain"


def _site_pages(row: dict) -> dict[str, list[str]] | None:
    """Compared fields by normalised URL, None where the row is no snapshot. Of pages with one URL the first counts."""
    if row["status"] != "completed" or not _is_domain(row["request_json"]):
        return None
    report = parse(row["report_json"])
    if not isinstance(report, dict):
        return None
    pages: dict[str, list[str]] = {}
    for page in as_list(report.get("pages")):
        if isinstance(page, dict) and isinstance(page.get("url"), str):
            url = normalize_url(page["url"])
            if url not in pages:
                pages[url] = page_fields(page)
    return pages


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    columns = batch.to_pydict()
    for values in zip(*columns.values(), strict=True):
        yield dict(zip(columns, values, strict=True))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, ROWS):
        found = []
        for row in _rows(batch):
            pages = _site_pages(row)
            found.append(None if pages is None else [{"page_url": u, "hash": blake2b("\0".join(v).encode("utf-8", "surrogatepass"), digest_size=16).digest()} for u, v in pages.items()])
        kind = pa.list_(pa.struct([("page_url", pa.string()), ("hash", pa.binary())]))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("target_url"), batch.column("completed_at"), batch.column("ingested_at"), pa.array(found, kind)], ["id", "target_url", "completed_at", "ingested_at", "pages"])


def _page_hash(run_id: str, url: str) -> int:
    return int.from_bytes(blake2b(f"{run_id}\0{url}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_READ = ("id", "target_url", "status", "request_json", "report_json", "completed_at", "ingested_at")


def audit_index(audit_runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshots: target, snapshot, at; pages: snapshot and its pages with the hash of their fields).

    Reads and parses every report once and writes a table of hashes; report texts are never shuffled.
    """
    src = audit_runs.select(*_READ).filter(F.col("id").isNotNull())
    times = {c: src.schema[c].dataType.simpleString() for c in ("completed_at", "ingested_at")}
    indexed = src.mapInArrow(_index, f"id string, target_url string, completed_at {times['completed_at']}, ingested_at {times['ingested_at']}, pages array<struct<page_url:string,hash:binary>>")
    counted = cut(latest(indexed, ["id"], ["target_url", "completed_at", "pages"]).filter(F.col("pages").isNotNull()), "audit-index")
    target = F.coalesce(url_col(F.col("target_url")), F.lit("\0"))
    snapshots = counted.select(target.alias("target"), F.col("id").alias("snapshot"), F.col("completed_at").alias("at"))
    return snapshots, counted.select(F.col("id").alias("snapshot"), "pages")


def audit_changes(audit_runs: DataFrame) -> DataFrame:
    """run_id, page_url, change_kind (added|removed|changed), prev_run_id of each site audit against the one before of its target.

    The history is delivered to a `SnapshotIndex` in two rounds: the first snapshots of all targets make the index, all later
    ones are probed against it and one another. Snapshots of a target follow each other by completed_at (null first), then id. Null ids are
    left out, null targets are one target; unparsable reports, page-mode and unfinished runs are no snapshots; a snapshot without pages
    is one. Extra columns don't matter. An empty table gives no rows.
    """
    spark = audit_runs.sparkSession
    snapshots, pages = audit_index(audit_runs)
    order = cut(chain(snapshots, "target", "at", "snapshot"), "audit-chain")
    index = SnapshotIndex(spark, table_path(spark, "snapshot-index"), buckets=max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    firsts, laters = order.filter(F.col("prev_id").isNull()), order.filter(F.col("prev_id").isNotNull())
    rounds = [
        firsts.withColumns({"next_id": F.lit(None).cast("string"), "new": F.lit(True)}),
        laters.withColumn("new", F.lit(True)).unionByName(firsts.filter(F.col("next_id").isNotNull()).withColumn("new", F.lit(False))),
    ]
    for linked in rounds:
        rows = pages.join(linked.filter("new"), "snapshot").select("target", "snapshot", "prev_id", "next_id", F.inline("pages")).withColumnRenamed("page_url", "key")
        changes = index.advance(rows, linked)
    return changes.select(F.col("snapshot").alias("run_id"), F.col("key").alias("page_url"), "change_kind", F.col("prev").alias("prev_run_id"))


def audit_field_changes(audit_runs: DataFrame) -> DataFrame:
    """run_id, page_url, field, old_value, new_value: values fetched for the changed pages only.

    A bit set of the changed pages goes along with the second scan of the reports, so only their values (and a few others') leave it;
    the join with the changes is exact.
    """
    wanted = cut(audit_changes(audit_runs).filter(F.col("change_kind") == "changed"), "audit-changes")
    both = wanted.select(F.explode(F.array("run_id", "prev_run_id")).alias("id"), "page_url")
    hashes = cut(both.mapInArrow(_hashed_pages, "h bigint"), "changed-pages")
    changed = audit_runs.sparkSession.sparkContext.broadcast(bit_set(hashes, "h"))
    names = [f.replace(".", "_") for f in FIELDS]

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = changed.value
        for batch in slices(batches, ROWS):
            out: dict[str, list] = {k: [] for k in ("run_id", "ingested_at", "page_url", *names)}
            for row in _rows(batch):
                for url, fields in (_site_pages(row) or {}).items():
                    if _page_hash(row["id"], url) in known:
                        for k, v in zip(out, (row["id"], row["ingested_at"], url, *fields), strict=True):
                            out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[k], batch.schema.field("ingested_at").type if k == "ingested_at" else pa.string()) for k in out], list(out))

    src = audit_runs.select(*_READ).filter(F.col("id").isNotNull())
    kind = src.schema["ingested_at"].dataType.simpleString()
    got = src.mapInArrow(values, f"run_id string, ingested_at {kind}, page_url string, " + ", ".join(f"{n} string" for n in names))
    return fetch_values(wanted, latest(got, ["run_id", "page_url"], names), "page_url", names)


def _hashed_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(map(_page_hash, batch.column("id").to_pylist(), batch.column("page_url").to_pylist()), pa.int64())], ["h"])
