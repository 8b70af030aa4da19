"""String functions: natural order, file-name filters, slugs, log lines, table cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Endings of image files, and of names that are results rather than images (fixed values).
IMAGE_ENDINGS = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".flex", ".dax", ".nd2", ".nrrd")
RESULT_SUFFIXES = ("_cp_output", "_flows", "_flows_0", "_flows_1", "_flows_2", "_cellprob", "_masks")


def natural_key(name: Column) -> Column:
    """A key in whose order numbers within names count as numbers: every run of digits is padded to 20 digits."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def is_image(path: Column, suffixes: Sequence[str] = RESULT_SUFFIXES, endings: Sequence[str] = IMAGE_ENDINGS) -> Column:
    """Ends like an image, and its stem does not end like a result (a stem that is no longer than the suffix may)."""
    kind = F.lower(path).rlike("(" + "|".join(e.replace(".", r"\.") for e in endings) + ")$")
    clean = F.lit(True)
    for s in suffixes:
        clean = clean & ((F.length(stem(path)) <= len(s)) | ~F.endswith(stem(path), F.lit(s)))
    return kind & clean


def slug(name: Column) -> Column:
    """Lower case, without parenthesised parts; runs of other characters become one underscore, none at the ends; ``layer`` if nothing is left."""
    parts = F.regexp_extract_all(F.regexp_replace(F.lower(name), r"\s*\(.*?\)\s*", ""), F.lit("[a-z0-9]+"), 0)
    return F.when(F.size(parts) == 0, "layer").otherwise(F.array_join(parts, "_"))


#: Shapes of log lines, by what became of a cell (fixed formats, any name of the kept mask and of the tool); the first group is the label.
LOG_LINES = {
    "pasted": r"^label\s+(\d+):\s+bbox=\((\d+),(\d+),(\d+),(\d+)\)\s+placed_pixels=(\d+)(?:\s+merge=.*)?\s*$",
    "min_cell_area_fallback": r"^label\s+(\d+):\s+area=(\d+)\s+<\s+min_cell_area,\s+kept \w+ mask\s*$",
    "no_fg_seeds_fallback": r"^label\s+(\d+):\s+no fg seeds,\s+kept \w+ mask\s*$",
    "failed_fallback": r"^label\s+(\d+):\s+\w+ failed\s+\((.+)\),\s+kept \w+ mask\s*$",
}


def parse_log(lines: DataFrame, order: str = "n", line: str = "line", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, label, status, r0, r1, c0, c1, placed, error) of log lines; other lines are left out.

    ``keys`` tell logs apart, such as the name of the file; of a log's lines on one label the last wins.
    """
    def group(kind: str, k: int) -> Column:
        return F.regexp_extract(line, LOG_LINES[kind], k)

    status = F.coalesce(*[F.when(F.col(line).rlike(p), kind) for kind, p in LOG_LINES.items()])
    is_ = lambda kind: F.col("status") == kind
    rows = lines.withColumn("status", status).where("status is not null")
    label = F.coalesce(*[F.when(is_(kind), group(kind, 1)) for kind in LOG_LINES]).cast("int")
    box = [F.when(is_("pasted"), group("pasted", k)).cast("int").alias(n) for k, n in ((2, "r0"), (3, "r1"), (4, "c0"), (5, "c1"))]
    placed = F.when(is_("pasted"), group("pasted", 6)).when(is_("min_cell_area_fallback"), group("min_cell_area_fallback", 2)).cast("int")
    error = F.when(is_("failed_fallback"), F.substr(F.trim(group("failed_fallback", 2)), F.lit(1), F.lit(500)))
    parsed = rows.select(*keys, order, label.alias("label"), F.struct("status", *box, placed.alias("placed"), error.alias("error")).alias("r"))
    return parsed.groupBy(*keys, "label").agg(F.max_by("r", order).alias("r")).select(*keys, "label", "r.*")


#: Trained models by the name of the data set (fixed values), and the one of all others.
MODELS, OTHER_MODEL = {"dsb2018": "2D_versatile_fluo", "ihc_tma": "2D_versatile_fluo"}, "2D_versatile_he"


def model_of(dataset: Column) -> Column:
    """The trained model that fits a data set."""
    out = F.lit(OTHER_MODEL)
    for name in sorted(set(MODELS.values())):
        out = F.when(dataset.isin(*[k for k, v in MODELS.items() if v == name]), name).otherwise(out)
    return out


def first_existing(rows: DataFrame, key: str, priority: str) -> DataFrame:
    """The candidate of each key with the smallest priority."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), priority).alias("r")).select(key, "r.*")


#: Characters that a typesetting system takes for commands, and what stands for them (fixed values).
ESCAPES = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def latex_escape(text: Column) -> Column:
    """The text character by character, so that no replacement is replaced again."""
    table = F.create_map(*[F.lit(x) for pair in ESCAPES.items() for x in pair])
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")


def mean_cell(v: Column, digits: int = 4) -> Column:
    """A mean as a table cell, a dash if there is none."""
    return F.when(v.isNull(), "—").otherwise(F.format_string(f"%.{digits}f", v))


def markdown_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
