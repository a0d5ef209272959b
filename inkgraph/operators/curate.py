"""The curation passes over markup rows: cheap rejects first, then the parser, then the pool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import native
from ..functions.markup import report_columns, with_report
from ..sources.tables import written
from .funnel import reject, with_leak_flag


def scan(rows: DataFrame, tests: DataFrame, max_chars: int = 20_000) -> DataFrame:
    """rows (row_pos, filename, svg) with their reject_reason and the columns of the pool.

    Order of reasons: no_svg, too_long (both before any parsing), validate, test_leak, exact_dup, then the code filter.
    tests: (sha256) of held-out texts."""
    blob = native.blob_or_raw(F.col("svg"))
    rows = rows.select("row_pos", "filename", F.coalesce(blob, F.lit("")).alias("blob"))
    early = F.when(F.length("blob") == 0, "no_svg").when(F.length("blob") > max_chars, "too_long")
    short = rows.withColumn("reject_reason", early).filter("reject_reason is not null")
    seen = with_report(rows.withColumn("_early", early).filter("_early is null").drop("_early"), "blob")
    seen = written(seen.withColumn("sha256", F.col("report.sha256")), "reports")  # the parser runs once; rejection reads it twice
    r = F.col("report")
    pool = report_columns(r)
    seen = with_leak_flag(seen.withColumns(pool), tests, "sha256").withColumn("bucket", native.bucket(r["normalized"])).withColumn("id", native.derived_id(F.col("filename")))
    code = native.code_reason(F.lit(True), F.col("vfig_N"), F.col("vfig_clean"), F.col("vfig_C"))
    late = [(n, code == n) for n in ("vfig_no_geometry", "vfig_low_clean", "vfig_too_many_complex")]
    judged = reject(seen, [("validate", ~r["ok"]), ("test_leak", F.col("leaked"))], "sha256", "row_pos", late)
    return judged.drop("leaked").unionByName(short, allowMissingColumns=True)


def pool(scanned: DataFrame) -> DataFrame:
    """The kept rows with an index in row order. Indexes are dense only per sort; use them as keys, not as offsets."""
    kept = scanned.filter("reject_reason is null").drop("reject_reason", "blob")
    return kept.withColumn("pool_idx", F.col("row_pos"))


def error_rows(scanned: DataFrame, stage: str) -> DataFrame:
    """The quarantine form of rejected rows; messages keep 500 characters."""
    bad = scanned.filter("reject_reason is not null")
    return bad.select(F.lit(stage).alias("stage"), F.col("row_pos").cast("string").alias("row_id"), "sha256", F.col("reject_reason").alias("error_type"), native.cut(F.concat_ws("; ", "report.errors"), 500).alias("message"))
