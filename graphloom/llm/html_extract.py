"""Main text of HTML pages by consensus of each host's pages on where it stands.

Each page scores its containers and votes for the generalised paths (tags and classes, digits as
one sign) of the best; votes are summed by host and path in Spark; each page is then read again
with its host's winning path, or its own best container if it lacks that path.

Defined results: a null or empty page has empty text; pages of any length are read whole; ties of
votes go to the first path in order; pages without a host (null or malformed url) share one; repeated rows
give repeated results; an empty table gives no rows; ``extract`` keeps all other columns, its own
replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, materialize, prepare, scope, table, texts
from .html_page import Page


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host and the path that wins its pages' votes."""
    prepare(pages.sparkSession)

    def vote(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            found = [(i, *v) for i, x in enumerate(texts(batch.column(1))) for v in Page(x).votes()]
            of, path, share = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(path, pa.string()), pa.array(share, pa.float64())], ["host", "path", "share"])

    cast = pages.select(host(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`")).mapInArrow(vote, "host string, path string, share double")
    # whole millionths, so that sums don't depend on their order
    sums = cast.groupBy("host", "path").agg(F.sum(F.round(F.col("share") * 1_000_000).cast("long")).alias("votes"))
    return sums.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), "path")).alias("path"))


def extract(pages: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all) of ``pages``, ``text`` and ``n_chars``."""
    prepare(pages.sparkSession)
    keep = [c for c in (pages.columns if keep is None else keep) if c.lower() not in ("text", "n_chars")]
    plain = [f"c{i}" for i in range(len(keep))]
    with scope(pages.sparkSession) as kept:
        winners = kept(materialize(host_paths(pages, url, html), "paths")).select("host", "path")
    # broadcast only if the written table is small enough for Spark; beyond, a join whose skewed hosts Spark splits
    joined = pages.select(*[F.col(f"`{c}`").alias(p) for p, c in zip(plain, keep)], F.col(f"`{html}`").alias("html"), host(F.col(f"`{url}`")).alias("host")).join(winners, "host", "left")

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            found = [Page(x).text(path) for x, path in zip(texts(batch.column(len(keep))), batch.column(len(keep) + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], [*plain, "text", "n_chars"])

    kinds = "".join(f"{p} {pages.schema[c].dataType.simpleString()}, " for p, c in zip(plain, keep))
    return joined.select(*plain, "html", "path").mapInArrow(read, f"{kinds}text string, n_chars long").toDF(*keep, "text", "n_chars")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
