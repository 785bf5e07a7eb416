"""Landed reading pages in any JSON layout.

A page is an object ``{total, records: [...]}``.  A landed file may hold one
page a line, arrays of pages, pages printed over many lines, or what is left of
a response that broke off.  Files are read as lines:

* a line that has the shape of a whole page (or array of pages) is parsed as it
  is;
* all other lines of a file are joined, in order, to the text that they are
  pieces of.  If that text isn't read to its end as one, it is cut where a line
  begins another object, and each part is tried.  Only these lines are shuffled.

What still doesn't parse, holds no ``records``, or holds more pages than could
be read is not lost silently: ``rejects`` lists it with its file, place, reason
and text.  Fields are read as text first, so a value of another type never
costs its record.  Blank lines and lone brackets or commas are no content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aqlens.operators.ordering import running_total
from aqlens.session import broadcast_if_bounded, written

READING_FIELDS = [
    "state",
    "city",
    "station",
    "last_update",
    "latitude",
    "longitude",
    "pollutant_id",
    "pollutant_min",
    "pollutant_max",
    "pollutant_avg",
]
# The live feed names the values differently.
LIVE_FIELDS = ["min_value", "max_value", "avg_value"]
RECORD_SCHEMA = T.StructType(
    [T.StructField("reading_id", T.LongType())] + [T.StructField(f, T.StringType()) for f in READING_FIELDS + LIVE_FIELDS]
)
_TEXT_RECORD = T.StructType([T.StructField(f.name, T.StringType()) for f in RECORD_SCHEMA.fields])
_TEXT_PAGES = T.ArrayType(T.StructType([T.StructField("records", T.ArrayType(_TEXT_RECORD))]))

# A file above this size is no single response: its broken lines are rejected
# one by one instead of being joined into one text.
DOCUMENT_BYTES = 64 << 20
RECORDS_KEY = r'"records"\s*:'
NO_CONTENT = ["", "[", "]", ","]
FINEST_CUT = r"\n(?=[{\[])"


def read_lines(reader, path: str) -> DataFrame:
    """Lines of the files below ``path`` with their place; ``reader`` is
    ``spark.read`` or ``spark.readStream`` (with its options)."""
    lines = reader.format("text").load(path)
    meta = F.col("_metadata")
    return lines.select(
        "*",
        meta["file_path"].alias("path"),
        meta["file_block_start"].alias("block"),
        meta["file_size"].alias("size"),
    )


def _parsed(texts: DataFrame, cut: str) -> DataFrame:
    """Add ``pages`` (those with records) and ``broken`` (reason and text of
    what was not read).  A text that isn't read to its end in one go is cut at
    ``cut`` and its parts are read one by one."""
    read = lambda text: F.from_json(text, _TEXT_PAGES, {"mode": "PERMISSIVE"})
    held = lambda pages: F.filter(F.coalesce(pages, F.array().cast(_TEXT_PAGES)), lambda p: p["records"].isNotNull())

    def reason(text: Column, pages: Column) -> Column:
        return (
            F.when(pages.isNull(), "malformed")
            .when(F.size(held(pages)) == 0, "no records")
            .when(F.size(held(pages)) < F.regexp_count(text, F.lit(RECORDS_KEY)), "not read to the end")
        )

    def tried(parts: Column) -> Column:
        each = F.transform(parts, lambda p: F.struct(p.alias("text"), read(p).alias("pages")))
        return F.filter(each, lambda p: ~F.trim(p["text"]).isin(*NO_CONTENT))

    out = texts.withColumn("first", read(F.col("text")))
    out = out.withColumn("parts", F.when(reason(F.col("text"), F.col("first")).isNotNull(), F.split("text", cut)))
    out = out.withColumn("tried", tried(F.col("parts")))
    # a part that broke off may have taken the next page along: cut it finer
    # where that brings a page to light
    finer = lambda p: F.when(p["pages"].isNull(), tried(F.split(p["text"], FINEST_CUT)))
    better = lambda f: F.exists(f, lambda q: F.size(held(q["pages"])) > 0)
    each = F.transform("tried", lambda p: F.struct(p.alias("p"), finer(p).alias("f")))
    chosen = F.transform(each, lambda x: F.when(better(x["f"]), x["f"]).otherwise(F.array(x["p"])))
    out = out.withColumn("tried", F.flatten(chosen))
    told = F.transform("tried", lambda p: F.struct(reason(p["text"], p["pages"]).alias("reason"), p["text"].alias("text")))
    none = F.array().cast("array<struct<reason:string,text:string>>")
    found = F.when(F.col("parts").isNull(), held(F.col("first"))).otherwise(
        F.flatten(F.transform("tried", lambda p: held(p["pages"])))
    )
    broken = F.coalesce(F.filter(told, lambda p: p["reason"].isNotNull()), none)
    return out.withColumns({"pages": found, "broken": broken}).drop("first", "parts", "tried")


def _shaped() -> Column:
    """Lines in the shape of whole pages."""
    t = F.trim("value")
    opens = t.startswith("{") | t.startswith("[")
    closes = t.endswith("}") | t.endswith("]") | t.endswith("},")
    return opens & closes & F.col("value").rlike(RECORDS_KEY)


def _whole(lines: DataFrame) -> DataFrame:
    texts = lines.filter(_shaped()).withColumn("text", F.col("value")).withColumn("kind", F.lit(0))
    return _parsed(texts, r'(?<=\})\s*(?=\{\s*"(?:total|records)"\s*:)')


def _joined(lines: DataFrame) -> DataFrame:
    """The other lines, joined by file."""
    lines = lines.withColumn("row", F.monotonically_increasing_id())
    others = lines.filter(~_shaped() & (F.trim("value") != "") & (F.col("size") <= DOCUMENT_BYTES))
    extra = [c for c in lines.columns if c not in ("value", "path", "block", "size", "row")]
    files = others.groupBy("path", *extra).agg(F.array_sort(F.collect_list(F.struct("block", "row", "value"))).alias("lines"))
    # brackets and commas alone are what whole lines leave of an array of pages
    files = files.filter(F.exists("lines", lambda x: ~F.trim(x["value"]).isin(*NO_CONTENT)))
    text = F.array_join(F.transform("lines", lambda x: x["value"]), "\n")
    texts = files.select("path", *extra, F.col("lines")[0]["block"].alias("block"), text.alias("text"), F.lit(1).alias("kind"))
    # an object that follows a comma, colon or bracket belongs to the one around it
    return _parsed(texts, r"(?<![,\[:])(?<![,\[:]\r)\n(?=[{\[])")


def _record(r: Column) -> Column:
    fields = [r[f.name].try_cast("long").alias(f.name) if f.name == "reading_id" else r[f.name].alias(f.name) for f in RECORD_SCHEMA.fields]
    return F.struct(*fields)


def records(lines: DataFrame) -> DataFrame:
    """(path, block, kind, r): the records of all pages of ``lines``, in order
    within a task; columns that the landing folders add are kept."""
    own = [c for c in lines.columns if c not in ("value", "size")]
    each = _whole(lines).select(*own, "kind", "pages").unionByName(_joined(lines).select(*own, "kind", "pages"))
    # outer, as the filter that the planner derives from an inner one would
    # parse every line again
    each = each.select(*own, "kind", F.explode_outer(F.flatten(F.transform("pages", lambda p: p["records"]))).alias("r"))
    return each.filter("r IS NOT NULL").withColumn("r", _record(F.col("r")))


def rejects(lines: DataFrame) -> DataFrame:
    """(path, block, reason, text): all content of ``lines`` that gave no
    records, or not all of its records."""
    large = lines.filter(~_shaped() & ~F.trim("value").isin(*NO_CONTENT) & (F.col("size") > DOCUMENT_BYTES))
    large = large.select("path", "block", F.lit("broken line of a large file").alias("reason"), F.col("value").alias("text"))
    broken = _whole(lines).select("path", "block", "broken").unionByName(_joined(lines).select("path", "block", "broken"))
    broken = broken.select("path", "block", F.explode_outer("broken").alias("b")).filter("b IS NOT NULL")
    return broken.select("path", "block", "b.*").unionByName(large)


def numbered(rows: DataFrame, out: str, keys: list[str], name: str) -> DataFrame:
    """``rows`` (columns path, block and the like in ``keys``) with ``out``:
    their number in the order of the keys, and in their own order within.

    Rows are written once, in the order of the scan.  A small table counts them
    by key, running totals over it say where each key begins, and a row adds its
    place behind the first of its key: no row is sorted or ranged.
    """
    placed = written(rows.withColumn("_n", F.monotonically_increasing_id()), name)
    spans = placed.groupBy(*keys).agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_count"))
    begin = running_total(spans, keys, "_count", "_before", f"{name}-spans").drop("_count")
    begin = broadcast_if_bounded(begin, derived=True)
    return placed.join(begin, keys).withColumn(out, F.col("_before") + F.col("_n") - F.col("_first")).drop("_n", "_before", "_first")
