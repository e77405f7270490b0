"""Schemas that drift between files of a feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

# The lattice: integer < decimal < string, boolean < string, array < string, object < string.
_BITS = {"boolean": 1, "integer": 2, "decimal": 4, "string": 8, "array": 16, "object": 32}
_FLOATING = 64  # beside decimal: a number written with an exponent or of more than 38 digits
_DECIMAL = "^DECIMAL\\(([0-9]+),([0-9]+)\\)$"


def _bits(s: Column) -> Column:
    """Type bit of a JSON value as written, by its variant schema; null for a JSON null."""
    return (
        F.when(s == "VOID", F.lit(None).cast("int")).when(s == "BIGINT", 2).when(s == "STRING", 8).when(s == "BOOLEAN", 1).when(s.startswith("ARRAY"), 16).when(s.startswith("OBJECT"), 32)
        .when(s.rlike("^DECIMAL\\((19|[2-9][0-9]),0\\)$"), 2)  # whole numbers too long for a bigint; 41.0 is DECIMAL(2,0)
        .when(s.startswith("DECIMAL"), 4).otherwise(4 + _FLOATING)
    )


def promote(bits: Column) -> Column:
    """Least type of the lattice above all types in a set of type bits."""
    plain = bits.bitwiseAND(F.lit(_FLOATING - 1))
    exact = F.lit(None).cast("string")
    for name, bit in _BITS.items():
        exact = F.when(plain == bit, name).otherwise(exact)
    return F.coalesce(exact, F.when(plain == _BITS["integer"] + _BITS["decimal"], "decimal").otherwise("string"))


def _comparable(kind: Column, text: Column) -> Column:
    """A value's content whatever its type: numbers as doubles, lists joined by a bar, an
    object of one member as that member."""
    plain = F.when(kind == "object", F.regexp_replace(text, '^\\{"[^"]*":"?(.*?)"?\\}$', "$1")).when(kind == "array", F.regexp_replace(text, '^\\[|\\]$|"', "")).otherwise(F.trim(text))
    number = F.when(plain.rlike("^[-+]?[0-9][0-9,]*(\\.[0-9]*)?([eE][-+]?[0-9]+)?$"), F.regexp_replace(plain, ",", "").try_cast("double"))
    return F.coalesce(number.cast("string"), F.regexp_replace(plain, "\\s*[|,;]\\s*", "|"))


BROADCAST_FILES = 100_000  # a list of files of at most this many rows is sent to all tasks, a longer one is shuffled


def _object(body: Column) -> Column:
    """The line's JSON value; a byte order mark before it is ignored, null if it can't be read."""
    text = F.trim(body)
    return F.try_parse_json(F.when(text.startswith("\ufeff"), F.ltrim(text, F.lit("\ufeff"))).otherwise(text))


def _members(parsed: DataFrame) -> DataFrame:
    """Adds ``key`` and ``value``: the members of the object ``_v``. Lines that aren't one JSON object are left out.

    They are left out by their missing key: a condition on ``_v`` itself would be evaluated before it and parse each line twice.
    """
    return parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("_v").outer())).where("key IS NOT NULL")


def _known(lines: DataFrame) -> DataFrame:
    return lines.where("feed IS NOT NULL AND file_id IS NOT NULL")


def file_schemas(lines: DataFrame) -> DataFrame:
    """``feed, file_id, exported_at, field, bits, whole, scale, type``: each file's fields, folded over its lines.

    A file has a field if any line of it holds a non-null value there; repeated lines change
    nothing. whole and scale are the most digits before and after the point. The fold takes a line's values one by one,
    first per type as written, so it is combined map-side; exported_at is the file's earliest one.
    """
    each = _members(_known(lines).select("feed", "file_id", "exported_at", _object(F.col("body")).alias("_v"))).select("feed", "file_id", "exported_at", F.col("key").alias("field"), F.schema_of_variant("value").alias("_s")).where("_s <> 'VOID'")
    written = each.groupBy("feed", "file_id", "field", "_s").agg(F.min("exported_at").alias("exported_at"))
    p, s = (F.regexp_extract("_s", _DECIMAL, k).try_cast("int") for k in (1, 2))
    folded = written.groupBy("feed", "file_id", "field").agg(F.bit_or(_bits(F.col("_s"))).alias("bits"), F.max(F.when(F.col("_s") == "BIGINT", 19).otherwise(p - s)).alias("whole"), F.max(s).alias("scale"), F.min("exported_at").alias("exported_at"))
    return folded.select("feed", "file_id", "exported_at", "field", "bits", "whole", "scale", promote(F.col("bits")).alias("type"))


def schema_changes(lines: DataFrame) -> DataFrame:
    """Every change of a file against the file before it in its feed.

    Gives ``feed, file_id, exported_at, field, new_field, change, old_type, new_type`` with change
    added, removed, renamed or retyped. Files of a feed are ordered by exported_at, then
    file_id; the first file has no changes, and a file without a readable line isn't one. A
    field is renamed if it is gone, new_field is new in the same file, and the two hold the
    same values for more than half of the queries that have both; the best partner counts,
    then the first name, each field once. A new type of a renamed field is also a retyped
    case under the new name. new_field is '' except for renamed.

    Lines are read once for the schemas. A second reading takes only files in which fields
    came and others went, or the files before them, and of those only these fields.
    """
    schemas = cut_lineage(file_schemas(lines))  # one row per file and field, read in several places
    files = schemas.groupBy("feed", "file_id").agg(F.min("exported_at").alias("exported_at"))
    w = Window.partitionBy("feed").orderBy("exported_at", "file_id")
    order = files.select("feed", "file_id", "exported_at", F.lag("file_id").over(w).alias("before"), F.lead("file_id").over(w).alias("after"))
    # each file's fields once as the newer and once as the older side of a pair, met by (pair, field)
    placed = schemas.select("feed", "file_id", "field", "type").join(order, ["feed", "file_id"]).select(
        "feed", "field", "type", F.explode(F.array(F.struct(F.when(F.col("before").isNotNull(), F.col("file_id")).alias("pair"), F.lit(True).alias("newer")), F.struct(F.col("after").alias("pair"), F.lit(False).alias("newer")))).alias("s")
    ).where("s.pair IS NOT NULL")
    met = placed.groupBy("feed", F.col("s.pair").alias("file_id"), "field").agg(
        F.max(F.when(F.col("s.newer"), F.col("type"))).alias("new_type"), F.max(F.when(~F.col("s.newer"), F.col("type"))).alias("old_type")
    )
    # one row per pair with the fields of its two files that differ
    differ = F.when(F.col("new_type").isNull() | F.col("old_type").isNull() | (F.col("new_type") != F.col("old_type")), F.struct("field", "old_type", "new_type"))
    pairs = cut_lineage(met.groupBy("feed", "file_id").agg(F.collect_list(differ).alias("_f")).where(F.size("_f") > 0).join(order.select("feed", "file_id", "exported_at", "before"), ["feed", "file_id"]))
    gone, came = F.filter("_f", lambda x: x["new_type"].isNull()), F.filter("_f", lambda x: x["old_type"].isNull())

    # values of fields that went and came in the same file, met by (pair, query)
    names = lambda a: F.transform(a, lambda x: x["field"])
    sides = pairs.where((F.size(gone) > 0) & (F.size(came) > 0)).select(
        "feed", F.col("file_id").alias("pair"), F.explode(F.array(F.struct(F.col("file_id").alias("of"), F.lit(True).alias("newer"), names(came).alias("names")), F.struct(F.col("before").alias("of"), F.lit(False).alias("newer"), names(gone).alias("names")))).alias("s")
    )
    wanted = sides.groupBy("feed", F.col("s.of").alias("file_id")).agg(F.collect_list(F.struct("pair", "s.newer", "s.names")).alias("_w"))  # at most two a file
    wanted = cut_lineage(wanted)
    if wanted.count() <= BROADCAST_FILES:
        wanted = F.broadcast(wanted)
    raw = _known(lines).select("feed", "file_id", "body").join(wanted, ["feed", "file_id"])  # text is joined, and only what is left is parsed
    read = raw.select("feed", "_w", _object(F.col("body")).alias("_v"), F.try_variant_get(_object(F.col("body")), "$.query", "string").alias("query"))
    asked = F.when(F.col("query").isNotNull(), F.col("key"))
    kept = _members(read).where(F.exists("_w", lambda x: F.array_contains(x["names"], asked))).select("feed", "query", F.col("key").alias("field"), F.schema_of_variant("value").alias("_s"), F.col("value").cast("string").alias("value"), F.explode(F.filter("_w", lambda x: F.array_contains(x["names"], F.col("key")))).alias("x"))
    held = kept.where("_s <> 'VOID'").groupBy("feed", F.col("x.pair").alias("pair"), "query", F.col("x.newer").alias("newer"), "field").agg(F.min(_comparable(promote(_bits(F.col("_s"))), F.col("value"))).alias("v"))
    # a query has a handful of fields in two files, so the pairs within it are few
    both = held.groupBy("feed", "pair", "query").agg(F.collect_list(F.when(~F.col("newer"), F.struct("field", "v"))).alias("_o"), F.collect_list(F.when(F.col("newer"), F.struct("field", "v"))).alias("_n"))
    tried = both.select("feed", "pair", F.explode("_o").alias("o"), "_n").select("feed", "pair", "o", F.explode("_n").alias("n"))
    same = tried.groupBy("feed", "pair", F.col("o.field").alias("gone"), F.col("n.field").alias("came")).agg(F.avg((F.col("o.v") == F.col("n.v")).cast("int")).alias("share")).where("share > 0.5").repartition("feed", "pair")
    best = same.withColumn("_a", F.row_number().over(Window.partitionBy("feed", "pair", "gone").orderBy(F.desc("share"), "came"))).withColumn("_b", F.row_number().over(Window.partitionBy("feed", "pair", "came").orderBy(F.desc("share"), "gone"))).where("_a = 1 AND _b = 1")
    renamed = best.groupBy("feed", F.col("pair").alias("file_id")).agg(F.collect_list(F.struct("gone", "came")).alias("_r"))

    none = F.array().cast("array<struct<gone:string,came:string>>")
    all_ = pairs.join(renamed, ["feed", "file_id"], "left").withColumn("_r", F.coalesce("_r", none))
    types = lambda column, kind: F.map_from_entries(F.transform(column, lambda x: F.struct(x["field"], x[kind])))
    case = lambda field, new, change, old_type, new_type: F.struct(field.alias("field"), new.alias("new_field"), F.lit(change).alias("change"), old_type.alias("old_type"), new_type.alias("new_type"))
    blank, null = F.lit(""), F.lit(None).cast("string")
    cases = all_.withColumns({"_go": types(gone, "old_type"), "_ne": types(came, "new_type")}).select(
        "feed", "file_id", "exported_at",
        F.explode(F.concat(
            F.transform(F.filter(came, lambda x: ~F.exists("_r", lambda r: r["came"] == x["field"])), lambda x: case(x["field"], blank, "added", null, x["new_type"])),
            F.transform(F.filter(gone, lambda x: ~F.exists("_r", lambda r: r["gone"] == x["field"])), lambda x: case(x["field"], blank, "removed", x["old_type"], null)),
            F.transform(F.filter("_f", lambda x: x["new_type"].isNotNull() & x["old_type"].isNotNull()), lambda x: case(x["field"], blank, "retyped", x["old_type"], x["new_type"])),
            F.transform("_r", lambda r: case(r["gone"], r["came"], "renamed", F.col("_go")[r["gone"]], F.col("_ne")[r["came"]])),
            F.transform(F.filter("_r", lambda r: F.col("_go")[r["gone"]] != F.col("_ne")[r["came"]]), lambda r: case(r["came"], blank, "retyped", F.col("_go")[r["gone"]], F.col("_ne")[r["came"]])),
        )).alias("c"),
    )
    return cases.select("feed", "file_id", "exported_at", "c.*")


def _column_type(kind: str, bits: int, whole: int | None, scale: int | None) -> str:
    """Spark type that holds every value of a field without losing a digit; numbers written with
    an exponent or of more than 38 digits are doubles, as JSON readers see them."""
    whole, scale = whole or 0, scale or 0
    if kind == "boolean":
        return "boolean"
    if kind == "integer":
        return "bigint" if whole <= 19 and not bits & _FLOATING else "decimal(38,0)"
    if kind == "decimal":
        return "double" if bits & _FLOATING else f"decimal({max(whole + scale, 1)},{scale})" if whole + scale <= 38 else "string"
    return "string"


def union_schema(lines: DataFrame) -> list[tuple[str, str]]:
    """(field, Spark type) of the union of all files' schemas, by name; one row per field reaches the driver."""
    folded = file_schemas(lines).groupBy("field").agg(F.bit_or("bits").alias("bits"), F.max("whole").alias("whole"), F.max("scale").alias("scale"))
    rows = folded.select("field", "bits", "whole", "scale", promote(F.col("bits")).alias("type")).orderBy("field").collect()
    return [(r["field"], _column_type(r["type"], r["bits"], r["whole"], r["scale"])) for r in rows]


def _member(name: str) -> Column:
    quote = "'" if "'" not in name else '"'
    if quote in name:  # both kinds of quotes: no path can spell it
        return F.element_at(F.from_json(F.to_json("_v"), "map<string,string>"), F.lit(name))
    return F.try_variant_get("_v", f"$[{quote}{name}{quote}]", "string")


def union_table(lines: DataFrame) -> DataFrame:
    """All readable lines as one table with one column per field, cast to the union schema.

    The union schema folds the types of all files through the lattice; whole numbers beyond
    64 bits are decimal(38,0), decimals have the digits that the widest value needs; a number in a column of text has
    no zeros after its last digit behind the point. A line that is
    delivered again (same feed, file and line number) is one row, the one delivered last; equal times
    are decided by the text. Lines without a number are told apart by their text. Names
    that differ only in case are one column each, as Spark can't tell them: the second is called name_2.
    """
    delivered = F.col("delivered_at") if "delivered_at" in lines.columns else F.lit(None).cast("timestamp").alias("delivered_at")
    rows = _known(lines).where(F.schema_of_variant(_object(F.col("body"))).startswith("OBJECT"))
    last = rows.groupBy("feed", "file_id", "line_no", F.when(F.col("line_no").isNull(), F.col("body")).alias("_text")).agg(F.max(F.struct(delivered, F.col("body").alias("body"), F.col("exported_at").alias("exported_at"))).alias("m"))
    once = last.select("feed", "file_id", "line_no", "m.exported_at", _object(F.col("m.body")).alias("_v"))
    taken, columns = {"feed": 1, "file_id": 1, "exported_at": 1, "line_no": 1}, []
    for name, kind in union_schema(lines):
        low = name.lower()
        taken[low] = taken.get(low, 0) + 1
        own = low in ("feed", "file_id", "exported_at", "line_no")
        columns.append(_member(name).try_cast(kind).alias(f"field_{name}" if own else name if taken[low] == 1 else f"{name}_{taken[low]}"))
    return once.select("feed", "file_id", "exported_at", "line_no", *columns)
