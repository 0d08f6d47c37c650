"""Schemas that drift between files (problem 3).

Method: a column-lifespan catalogue. Each file's footer (field -> set of JSON types) is exploded into rows; per
producer, field and type the presence over the files in order is cut into islands with ``lag``; an island's start and
end are the events. An alias table generates the casts that read all files into one table.

JSON stays JVM-side: ``try_parse_json`` and ``variant_explode``.

Edge cases: lines that don't parse, or that hold no object, add no field but their file still counts; null values
don't make a field present; a file without usable lines has no fields; a producer's first file has no changes; null
line, empty table: no rows. Keys are compared exactly. Repeated rows change nothing. Extra input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plover.runtime import materialize

#: JSON types by the first letter of Spark's variant schema names.
_KINDS = {"S": "string", "B": "boolean", "O": "object", "A": "array"}


def json_object(text: Column) -> Column:
    """The text as a variant if it is one well-formed JSON object, or a JSON string that holds one; else null."""
    return F.expr(_JSON_OBJECT.replace("?", _name(text)))


_JSON_OBJECT = """CASE WHEN ? RLIKE '^\\\\s*\\\\{[\\\\s\\\\S]*\\\\}\\\\s*$' THEN try_parse_json(?)
 WHEN ? RLIKE '^\\\\s*"[\\\\s\\\\S]*"\\\\s*$' THEN try_parse_json(try_variant_get(try_parse_json(?), '$', 'string')) END"""


def _name(column: Column | str) -> str:
    return column if isinstance(column, str) else column._jc.toString()


def fields_of_files(lines: DataFrame) -> DataFrame:
    """The exploded footers: producer, file_no, source_file, field, json_types (sorted array).

    ``lines``: producer, file_no, source_file, line (JSON text).
    """
    parsed = lines.select("producer", "file_no", "source_file", json_object("line").alias("object"))
    cells = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("object").outer()))
    kind = F.expr("schema_of_variant(value)")
    first = F.substring(kind, 1, 1)
    typed = F.when(kind == "VOID", None).when(kind == "BOOLEAN", "boolean")
    for letter, name in _KINDS.items():
        if letter != "B":
            typed = typed.when(first == letter, name)
    return (
        cells.select("producer", "file_no", "source_file", F.col("key").alias("field"), typed.otherwise("number").alias("kind"))
        .filter(F.col("kind").isNotNull())
        .groupBy("producer", "file_no", "source_file", "field")
        .agg(F.array_sort(F.collect_set("kind")).alias("json_types"))  # at most five types
    )


def numbered_files(lines: DataFrame) -> DataFrame:
    """producer, file_no, source_file, ordinal (1, 2, ... in the producer's order), n_files."""
    files = lines.groupBy("producer", "file_no").agg(F.min("source_file").alias("source_file"))
    order = Window.partitionBy("producer").orderBy("file_no")
    return files.withColumn("ordinal", F.row_number().over(order)).withColumn("n_files", F.count(F.lit(1)).over(Window.partitionBy("producer")))


def lifespans(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The catalogue: one row per island of files in which a producer's field has one and the same set of types.

    producer, field, json_types, from_ordinal, to_ordinal, n_files, and the neighbours' types: before and after
    (null where the field is absent).
    """
    files = numbered_files(lines) if files is None else files
    cells = fields_of_files(lines).join(files.select("producer", "file_no", "ordinal", "n_files"), ["producer", "file_no"])
    cells = cells.withColumn("types", F.array_join("json_types", "|"))
    track = Window.partitionBy("producer", "field").orderBy("ordinal")
    starts = F.coalesce((F.lag("ordinal").over(track) != F.col("ordinal") - 1) | (F.lag("types").over(track) != F.col("types")), F.lit(True))
    islands = cells.withColumn("start", starts.cast("int")).withColumn("island", F.sum("start").over(track))
    spans = islands.groupBy("producer", "field", "island", "types", "n_files").agg(
        F.min("ordinal").alias("from_ordinal"), F.max("ordinal").alias("to_ordinal")
    )
    by = Window.partitionBy("producer", "field").orderBy("from_ordinal")
    before = F.when(F.lag("to_ordinal").over(by) == F.col("from_ordinal") - 1, F.lag("types").over(by))
    after = F.when(F.lead("from_ordinal").over(by) == F.col("to_ordinal") + 1, F.lead("types").over(by))
    return spans.withColumn("types_before", before).withColumn("types_after", after).drop("island")


def schema_changes(lines: DataFrame) -> DataFrame:
    """Every change against the producer's previous file: producer, source_file, field_name, change_kind, new_name, old_types, new_types.

    change_kind is added, removed, retyped or renamed. A rename is one field vanishing and one of the same types
    appearing in the same file, when no other of these types vanishes or appears there.
    """
    numbered = materialize(numbered_files(lines), "files")
    spans = materialize(lifespans(lines, numbered), "lifespans")  # a row per producer, field and type: read by every kind of change
    files = numbered.select("producer", "ordinal", "source_file")
    begun = spans.filter("from_ordinal > 1").select(
        "producer",
        F.col("from_ordinal").alias("ordinal"),
        "field",
        F.when(F.col("types_before").isNull(), "added").otherwise("retyped").alias("kind"),
        F.col("types_before").alias("old_types"),
        F.col("types").alias("new_types"),
    )
    ended = spans.filter("to_ordinal < n_files AND types_after IS NULL").select(
        "producer",
        (F.col("to_ordinal") + 1).alias("ordinal"),
        "field",
        F.lit("removed").alias("kind"),
        F.col("types").alias("old_types"),
        F.lit(None).cast("string").alias("new_types"),
    )
    events = begun.unionByName(ended).withColumn("types", F.coalesce("new_types", "old_types"))
    moved = (
        events.filter("kind IN ('added', 'removed')")
        .groupBy("producer", "ordinal", "types")
        .agg(
            F.count_if(F.col("kind") == "added").alias("n_added"),
            F.count_if(F.col("kind") == "removed").alias("n_removed"),
            F.min(F.when(F.col("kind") == "removed", F.col("field"))).alias("old_name"),
            F.min(F.when(F.col("kind") == "added", F.col("field"))).alias("new_name"),
        )
        .filter("n_added = 1 AND n_removed = 1")
    )
    renamed = moved.select(
        "producer", "ordinal", F.col("old_name").alias("field_name"), F.lit("renamed").alias("change_kind"), "new_name", F.col("types").alias("old_types"), F.col("types").alias("new_types")
    )
    keep = events.join(moved.select("producer", "ordinal", "types", F.lit(1).alias("pair")), ["producer", "ordinal", "types"], "left").filter(
        (F.col("kind") == "retyped") | F.col("pair").isNull()
    )
    plain = keep.select("producer", "ordinal", F.col("field").alias("field_name"), F.col("kind").alias("change_kind"), F.lit("").alias("new_name"), "old_types", "new_types")
    return renamed.unionByName(plain).join(files, ["producer", "ordinal"])


#: Columns generated for fields no alias names: at most this many, those in most files first; the others stay in ``rest``.
MAX_COLUMNS = 500
_COLUMN_TYPES = {"boolean": "boolean", "string": "string", "number": "double"}


def generated_aliases(lines: DataFrame, declared: dict[str, tuple[str, list[str]]]) -> dict[str, tuple[str, list[str]]]:
    """``declared`` (as ``unified`` takes it) completed from the catalogue: a name the files renamed from or to a declared one joins
    its column; every other field gets a column of its own, typed by the JSON types it has had (JSON text for several or nested
    ones). ``lines``: as ``schema_changes``. A row per field reaches the driver."""
    spans = lifespans(lines).groupBy("field").agg(F.sum(F.col("to_ordinal") - F.col("from_ordinal") + 1).alias("n"), F.array_sort(F.collect_set("types")).alias("types"))
    fields = {r["field"]: r["types"] for r in spans.orderBy(F.desc("n"), "field").limit(MAX_COLUMNS).collect() if r["field"].isidentifier()}
    renamed = schema_changes(lines).filter("change_kind = 'renamed'").select("field_name", "new_name").distinct().collect()
    out = {name: (kind, list(paths)) for name, (kind, paths) in declared.items()}
    column = {path[2:]: name for name, (_, paths) in out.items() for path in paths}
    for old, new in sorted(map(tuple, renamed)):
        for known, other in ((old, new), (new, old)):
            if known in column and other not in column and other.isidentifier():
                column[other] = column[known]
                out[column[known]][1].append(f"$.{other}")
    for name, types in fields.items():
        if name not in column:
            out[name if name not in out else f"{name}_field"] = (_COLUMN_TYPES.get(types[0], "json") if len(types) == 1 else "json", [f"$.{name}"])
    return out


_NESTED = "schema_of_variant(?) RLIKE '^(OBJECT|ARRAY)'"


def _read(path: str, kind: str) -> str:
    """A path's value as ``kind``; objects and arrays are read as JSON text only, never as a string."""
    inner = f"try_variant_get(object, '{path}', 'variant')"
    if kind == "json":
        return f"CASE WHEN NOT is_variant_null({inner}) THEN to_json({inner}) END"
    plain = f"try_variant_get(object, '{path}', '{kind}')"
    return plain if kind != "string" else f"CASE WHEN NOT {_NESTED.replace('?', inner)} THEN {plain} END"


def _taken(name: str, kind: str) -> str:
    """Whether the column holds the field's value whole."""
    if kind == "json":
        return f"to_json(v) = `{name}`"
    return f"(NOT {_NESTED.replace('?', 'v')} AND try_variant_get(v, '$', 'string') = CAST(`{name}` AS STRING))"


def unified(lines: DataFrame, aliases: dict[str, tuple[str, list[str]]], keep: list[str]) -> DataFrame:
    """All lines as one table. ``aliases``: canonical column -> (Spark type, or json for JSON text; JSON paths in order
    of preference). ``keep``: columns passed on.

    Every path is cast with ``try_variant_get``; what can't be cast is null, never an error. ``rest`` (field -> JSON text)
    holds each top-level field, null apart, whose value no column holds whole: fields without an alias, values that
    couldn't be cast or lose by it, nested values of which only a part was read. So no value of a line is dropped.
    """
    parsed = lines.select(*keep, json_object("line").alias("object")).filter(F.col("object").isNotNull())
    columns = [F.coalesce(*[F.expr(_read(path, kind)) for path in paths]).alias(name) for name, (kind, paths) in aliases.items()]
    held: dict[str, list[str]] = {}
    for name, (kind, paths) in aliases.items():
        for path in paths:
            if path[2:].isidentifier():
                held.setdefault(path[2:], []).append(_taken(name, kind))
    cases = "".join(f" WHEN '{field}' THEN NOT coalesce({' OR '.join(of)}, false)" for field, of in held.items())
    left = f"CASE k{cases} ELSE true END" if cases else "true"
    rest = f"map_filter(try_variant_get(object, '$', 'map<string,variant>'), (k, v) -> v IS NOT NULL AND NOT is_variant_null(v) AND {left})"
    return parsed.select(*keep, *columns, "object").select(*keep, *aliases, F.expr(f"transform_values({rest}, (k, v) -> to_json(v))").alias("rest"))
