"""Typed bookings from raw records: every cell is a value, missing or invalid."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyhouse.sources.arrays import array_objects
from tallyhouse.sources.bookings import FIELDS, KINDS, TYPES
from tallyhouse.sources.raw import table_of

#: White space that is no part of a cell.
_EDGES = " \t\n\x0b\f\r"


def _date(text: Column, pattern: str, shape: str) -> Column:
    # the shape has no month or day that no date has: a refused text costs an exception
    dated = F.when(text.rlike(shape), text)
    day = dated.try_cast("date") if pattern == "yyyy-MM-dd" else F.try_to_date(dated, pattern)
    return F.when(F.year(day) >= 1, day)


def _record(line: Column) -> Column:
    """A line that is a JSON object, as a variant, by its one parse; null for other lines."""
    # the parser does not look behind the first value
    text = F.btrim(line, F.lit(" \t\r\n"))
    return F.when(F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}")), F.try_parse_json(line))


#: How a plain line's cell is read, by its kind. An amount stays a variant, which says how it is written.
_PLAIN = {"text": "string", "identifier": "string", "date": "string", "integer": "bigint", "boolean": "boolean", "decimal": "variant"}
_CORRUPT = "_corrupt"


def _plain(line: Column) -> Column:
    """A line as typed cells by one strict read, where it may be plain; null for other lines, and with _CORRUPT set if it could not be read."""
    schema = ", ".join([f"{f} {_PLAIN[KINDS[f]]}" for f in FIELDS] + [f"{_CORRUPT} string"])
    options = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "columnNameOfCorruptRecord": _CORRUPT}
    has = lambda x: F.contains(line, F.lit(x))
    # one flat object and nothing behind it; every quote begins or ends a name or text; no space before a colon
    flat = F.startswith(line, F.lit("{")) & (F.octet_length(F.substring_index(line, "}", 1)) == F.octet_length(line) - 1) & ~has("[") & ~has("\\")
    close = ~has(" :") & ~has("\t:") & ~has("\n:") & ~has("\r:")
    # far below the sizes that one reader takes and the other refuses
    return F.when((F.octet_length(line) < 1 << 20) & flat & close, F.from_json(line, schema, options))


def _is_plain(line: Column, plain: Column) -> Column:
    """Whether _plain() holds all that the line says, of the types that the line has.

    As many names as cells that were read: none is unknown, repeated, null or of a type that cannot be read. Texts read
    what other types hold too, so there must be as many texts in quotes as cells read as texts. A text that begins with a
    colon looks like a name: its line, like all that are not plain, is read as a variant.
    """
    count = lambda x: F.octet_length(line) - F.octet_length(F.replace(line, F.lit(x), F.lit("")))
    held = lambda *types: sum((plain[f].isNotNull().cast("int") for f in FIELDS if _PLAIN[KINDS[f]] in types), F.lit(0))
    quoted = [(F.schema_of_variant(plain[f]) == "STRING").cast("int") for f in FIELDS if _PLAIN[KINDS[f]] == "variant"]
    texts = sum((F.coalesce(x, F.lit(0)) for x in quoted), held("string"))
    names = held("string") + held("bigint", "boolean", "variant")
    return F.coalesce(plain.isNotNull() & plain[_CORRUPT].isNull() & (count('":') == names * 2) & (count('"') == (names + texts) * 2), F.lit(False))


def _plain_seen(field: Column, of_kind: str) -> tuple[Column, Column]:
    """What _seen() gives, of a plain line's cell that is read as a text or variant."""
    if _PLAIN[of_kind] == "variant":
        return _seen(field)
    return F.when(field.isNotNull(), F.lit("STRING")), F.btrim(field, F.lit(_EDGES))


def _seen(field: Column) -> tuple[Column, Column]:
    """(type, stripped text) of a variant; the type of an absent field is null."""
    return F.schema_of_variant(field), F.btrim(F.try_variant_get(field, "$", "string"), F.lit(_EDGES))


def _amount(text: Column) -> Column:
    """Decimal text as a price; null beyond the places or digits that a price has, since a rounded price is not the one given."""
    value = text.try_cast(TYPES["decimal"])
    return F.when(text.try_cast("decimal(38,18)") == value, value)


def _value(of_kind: str, kind: Column, text: Column, exact: Column) -> Column:
    """The value of a cell that is not missing, by the type and text that _seen() gave; null if it is invalid. exact is the cell as the line has it, for numbers beyond a variant's."""
    is_text, is_integer = kind == "STRING", kind == "BIGINT"
    number = F.when(is_integer, text.try_cast("bigint"))
    if of_kind == "text":
        return F.when(is_text, text)
    if of_kind == "identifier":
        beyond = F.when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), F.when(exact.rlike(r"^-?\d+$"), exact))
        return F.when(is_text | is_integer, text).otherwise(beyond)
    if of_kind == "integer":
        return F.when(number >= 0, number)
    if of_kind == "boolean":
        return F.when(kind == "BOOLEAN", text == "true").when(number.isin(0, 1), number == 1)
    if of_kind == "date":
        return F.when(is_text, _date(text, "yyyy-MM-dd", r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$"))
    double = text.try_cast("double")
    rounded = double.try_cast(TYPES["decimal"])
    amount = F.when(is_integer | kind.startswith("DECIMAL"), _amount(text)).when((kind == "DOUBLE") & (rounded.cast("double") == double), rounded)
    return F.when(amount >= 0, amount)


def _is_missing(kind: Column, text: Column) -> Column:
    return F.coalesce((kind == "VOID") | ((kind == "STRING") & (text == "")), F.lit(True))


def _exact(line: Column, name: Column | str) -> Column:
    """A number of a JSON object as whole-number text, however long; read from the line again only where a variant has it as no 64-bit integer."""
    return F.get_json_object(line, f"$.{name}") if isinstance(name, str) else F.call_function("get_json_object", line, F.concat(F.lit("$."), name))


def cell(record: Column, name: str, line: Column) -> tuple[Column, Column, Column]:
    """(value, is missing, is invalid) of a field of a variant record and the line that it came from.

    Null, absent and blank are missing; a value of another type, out of range, or a price of more than six places is
    invalid. Neither ever fails. Identifiers may be whole numbers of any size, counts up to 64 bits.
    """
    kind, text = _seen(F.variant_get(record, f"$.{name}", "variant"))
    missing = _is_missing(kind, text)
    value = F.when(~missing, _value(KINDS[name], kind, text, _exact(line, name)))
    return value, missing, ~missing & value.isNull()


def parse_json(lines: DataFrame, line: str = "line", with_issue: bool = False) -> DataFrame:
    """lines with one typed column per field, and the names of missing, of invalid and of unknown fields.

    A line that is no JSON object has all fields missing; with_issue adds the code of load_issues() or BLANK as issue.
    A plain line is read by type at once, any other as a variant, whose cells cost several times as much; both say the
    same of a cell. Each step has a function with a lambda, which Spark keeps out of whole-stage code: the fields' expressions are then
    generated as many small methods, which the JVM compiles, and not as a large one, which it does not.
    """
    rows = lines.withColumn("_plain", _plain(F.col(line)))
    plain = _is_plain(F.col(line), F.col("_plain"))
    rows = rows.select(*lines.columns, "_plain", (plain & F.exists(F.array(F.lit(True)), lambda x: x)).alias("_is_plain"))
    is_plain, cell_of = F.col("_is_plain"), {f: F.col("_plain")[f] for f in FIELDS}
    rows = rows.select(*lines.columns, "_plain", "_is_plain", F.when(~is_plain, _record(F.col(line))).alias("_record"))
    blank = F.coalesce(F.trim(line) == "", F.lit(True))
    issue = F.when(blank, "BLANK").when(~is_plain & F.col("_record").isNull(), F.when(F.try_parse_json(line).isNull() | F.startswith(F.ltrim(line, F.lit(" \t\r\n")), F.lit("{")), "RECORD_INVALID_JSON").otherwise("RECORD_NOT_OBJECT"))
    more = [issue.alias("issue")] if with_issue else []
    issued = ["issue"] if with_issue else []
    # by one map of all fields: a variant looks each name up by a walk through its own
    rows = rows.select(*lines.columns, "_plain", "_is_plain", F.try_variant_get("_record", "$", "map<string,variant>").alias("_fields"), *more)
    known = F.array(*map(F.lit, FIELDS))
    unknown = F.coalesce(F.sort_array(F.array_except(F.map_keys("_fields"), known)), F.array().cast("array<string>"))
    either = lambda a, b: tuple(F.when(is_plain, x).otherwise(y) for x, y in zip(a, b, strict=True))
    seen = {f: _seen(F.try_element_at("_fields", F.lit(f))) for f in FIELDS}
    typed = [f for f in FIELDS if KINDS[f] in ("integer", "boolean")]
    seen |= {f: either(_plain_seen(cell_of[f], KINDS[f]), seen[f]) for f in FIELDS if f not in typed}
    some = is_plain | F.coalesce(F.exists(F.map_keys("_fields"), lambda name: name.isNotNull()), F.lit(False))
    rows = rows.select(*lines.columns, "_is_plain", *[cell_of[f].alias(f"_cell_{f}") for f in typed], some.alias("_some"), *[x.alias(f"_{part}_{f}") for f in FIELDS for part, x in zip(("kind", "text"), seen[f], strict=True)], unknown.alias("unknown_fields"), *issued)
    missing = {f: ~F.col("_some") | _is_missing(F.col(f"_kind_{f}"), F.col(f"_text_{f}")) for f in FIELDS}
    value = {f: F.when(~missing[f], _value(KINDS[f], F.col(f"_kind_{f}"), F.col(f"_text_{f}"), _exact(F.col(line), f))).cast(TYPES[KINDS[f]]) for f in FIELDS}
    missing |= {f: F.when(is_plain, F.col(f"_cell_{f}").isNull()).otherwise(missing[f]) for f in typed}
    whole = lambda f: F.when(F.col(f"_cell_{f}") >= 0, F.col(f"_cell_{f}")) if KINDS[f] == "integer" else F.col(f"_cell_{f}")
    value |= {f: F.when(is_plain, whole(f)).otherwise(value[f]) for f in typed}
    # a row's number keeps filters on values above this step: moved below, they would parse a line once for each of its uses
    given = F.exists(F.array("_some"), lambda x: x) & (F.monotonically_increasing_id() >= 0)
    rows = rows.select(*lines.columns, given.alias("_some"), *[value[f].alias(f"_value_{f}") for f in FIELDS], *[missing[f].alias(f"_no_{f}") for f in FIELDS], "unknown_fields", *issued)
    # in the order of FIELDS, which is that of their names
    names = lambda test: F.array_remove(F.array(*[F.when(test(f), F.lit(f)).otherwise("") for f in FIELDS]), "")
    listed = {"missing_fields": names(lambda f: F.col(f"_no_{f}")), "invalid_fields": names(lambda f: ~F.col(f"_no_{f}") & F.col(f"_value_{f}").isNull())}
    all_ = F.exists(F.array("_some"), lambda x: x)
    listed["missing_fields"] = F.when(all_, listed["missing_fields"]).otherwise(known)
    return rows.select(*lines.columns, *[F.when(F.col("_some"), F.col(f"_value_{f}")).alias(f) for f in FIELDS], *[c.alias(n) for n, c in listed.items()], "unknown_fields", *issued)


def load(lines: DataFrame, line: str = "line") -> DataFrame:
    """The typed records of lines, written once; the whole input is refused if a line is no record, there are none, or none holds a valid value.

    Everything that a refusal needs is observed while the records are written: one parse and one pass serve both. The
    pass has no shuffle, so a task that is tried again is counted once.
    """
    seen = Observation("load")
    rows = parse_json(lines, line, with_issue=True)
    valid = (F.size("missing_fields") + F.size("invalid_fields")) < len(FIELDS)
    codes = ("RECORD_INVALID_JSON", "RECORD_NOT_OBJECT")
    watched = rows.observe(seen, F.count_if(F.col("issue").isNull()).alias("records"), F.count_if(valid).alias("valid"), *[F.count_if(F.col("issue") == c).alias(c) for c in codes])
    records = table_of(watched.where("issue is null").drop("issue", line), "records")
    found = seen.get
    for code in codes:
        if found[code]:
            raise InputError("INPUT_INVALID_JSON" if code == codes[0] else code, f"{found[code]} lines")
    if not found["records"]:
        raise InputError("INPUT_EMPTY", "there is no record")
    if not found["valid"]:
        raise InputError("NO_VALID_RECORDS", "no booking record holds a valid value")
    return records


def csv_cell(column: Column, name: str) -> tuple[Column, Column, Column]:
    """(value, is missing, is invalid) of a text cell: days as dd-mm-yyyy, flags as 0/1/true/false, whole numbers as -?digits."""
    text = F.btrim(column, F.lit(_EDGES))
    missing = text.isNull() | (text == "")
    whole = F.when(text.rlike(r"^-?\d+$"), text.try_cast("bigint"))
    kind = KINDS[name]
    if kind in ("text", "identifier"):
        value = text
    elif kind == "integer":
        value = F.when(whole >= 0, whole)
    elif kind == "boolean":
        value = F.when(F.lower(text).isin("1", "true"), True).when(F.lower(text).isin("0", "false"), False)
    elif kind == "date":
        value = _date(text, "dd-MM-yyyy", r"^(0[1-9]|[12]\d|3[01])-(0[1-9]|1[0-2])-\d{4}$")
    else:
        amount = F.when(text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), _amount(text))
        value = F.when(amount >= 0, amount)
    value = F.when(~missing, value)
    return value, missing, ~missing & value.isNull()


def parse_csv(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """rows of text cells as typed columns; absent columns are missing. keep names columns that are passed on."""
    cells = {name: csv_cell(F.col(name) if name in rows.columns else F.lit(None).cast("string"), name) for name in FIELDS}
    names = lambda i: F.filter(F.array(*[F.when(c[i], F.lit(n)) for n, c in cells.items()]), lambda x: x.isNotNull())
    return rows.select(*(keep or []), *[c[0].cast(TYPES[KINDS[n]]).alias(n) for n, c in cells.items()], names(1).alias("missing_fields"), names(2).alias("invalid_fields"))


def unknown_fields(lines: DataFrame, line: str = "line") -> DataFrame:
    """(field): names in the records that the contract does not have."""
    keys = lines.select(F.explode(F.json_object_keys(F.col(line))).alias("field"))
    return keys.where(~F.col("field").isin(FIELDS)).distinct()


def load_issues(lines: DataFrame, line: str = "line", position: str = "position") -> DataFrame:
    """(position, code) of lines that are no records: RECORD_INVALID_JSON or RECORD_NOT_OBJECT; blank lines are skipped."""
    record = F.try_parse_json(F.col(line))
    code = F.when(record.isNull(), "RECORD_INVALID_JSON").when(~F.schema_of_variant(record).startswith("OBJECT"), "RECORD_NOT_OBJECT")
    return lines.where(F.trim(line) != "").select(position, code.alias("code")).where("code is not null")


class InputError(ValueError):
    """An input that cannot be read as bookings; code says why."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """(position, line) of the objects of the JSON array in a file of any size, read by byte ranges; refused as a whole if it is no array of objects."""
    try:
        found, faults = array_objects(spark, path)
    except Exception as e:
        code = "INPUT_NOT_FOUND" if "PATH_NOT_FOUND" in str(e) else "INPUT_UNREADABLE"
        raise InputError(code, path) from e
    for code in ("INPUT_INVALID_JSON", "INPUT_NOT_ARRAY", "RECORD_NOT_OBJECT"):
        if faults.get(code):
            raise InputError(code, path)
    if "INPUT_EMPTY" in faults and found.isEmpty():
        raise InputError("INPUT_EMPTY", path)
    return found.select("position", "line")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line): one record per line, at any size."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Text cells of ;-separated files with a header."""
    return spark.read.option("sep", ";").option("header", True).csv(path)


def read_csv_strictly(spark: SparkSession, path: str) -> DataFrame:
    """read_csv(), refused as a whole if it cannot be read, a line has more or fewer cells than the header, or there are no records."""
    try:
        names = read_csv(spark, path).columns
        rows = spark.read.schema(", ".join(f"`{n}` string" for n in [*names, "_bad"])).option("sep", ";").option("header", True).option("enforceSchema", True).option("columnNameOfCorruptRecord", "_bad").option("columnPruning", False).csv(path)
        # Spark reads the column of bad lines beside another one only
        bad, any_, _ = rows.agg(F.count("_bad"), F.count("*"), F.max(f"`{names[0]}`")).first() if names else (0, 0, None)
    except Exception as e:
        code = "INPUT_NOT_FOUND" if "PATH_NOT_FOUND" in str(e) else "INPUT_UNREADABLE"
        raise InputError(code, path) from e
    if bad:
        raise InputError("INPUT_INVALID_CSV", path)
    if not any_:
        raise InputError("INPUT_EMPTY", path)
    return rows.drop("_bad")


def with_valid_records(parsed: DataFrame) -> DataFrame:
    """parsed, refused if no record holds a valid value."""
    if parsed.where(F.size("missing_fields") + F.size("invalid_fields") < len(FIELDS)).isEmpty():
        raise InputError("NO_VALID_RECORDS", "no booking record holds a valid value")
    return parsed


def _digests():
    """The digest of files from their lines; a function inside one, so that executors need no copy of this module."""

    def run(batches):
        """SHA-256 of each file from its lines in order."""
        name, size, count, plain, marked = None, 0, 0, None, None

        def done():
            # what the lines do not show of a file: its last line break, and a byte order mark, which the reader passes over
            rest = size - count
            digest = {0: plain, 1: plain, 3: marked, 4: marked}.get(rest)
            if digest is None:
                raise ValueError(f"{name}: the bytes read are not the file's; is it compressed?")
            if rest in (1, 4):
                digest.update(b"\n")
            return pa.RecordBatch.from_pydict({"file": [name.rsplit("/", 1)[-1]], "sha256": [digest.hexdigest()]})

        for batch in batches:
            for path, length, line in zip(batch["path"].to_pylist(), batch["size"].to_pylist(), batch["line"].to_pylist(), strict=True):
                if path == name:
                    line = b"\n" + line
                else:
                    if name is not None:
                        yield done()
                    name, size, count, plain, marked = path, length, 0, hashlib.sha256(), hashlib.sha256(b"\xef\xbb\xbf")
                plain.update(line)
                marked.update(line)
                count += len(line)
        if name is not None:
            yield done()

    return run


def input_fingerprint(spark: SparkSession, path: str, at_once: int = 1 << 28) -> DataFrame:
    """(file, sha256) of each input file's bytes.

    A file of up to at_once bytes is one value. A larger one is read by byte ranges, its lines are sorted by their place
    (Spark spills them), and one digest takes them in as they stream past: its task holds a batch of lines, however
    large the file. Larger files that Spark would decompress, and lines beyond 2 GB, fail.
    """
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= at_once).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))
    large = [r.path for r in files.where(F.col("length") > at_once).select("path").collect()]  # names only
    if not large:
        return small
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(large).select(
        meta["file_path"].alias("path"), meta["file_size"].alias("size"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("line")
    )
    ordered = lines.repartition("path").sortWithinPartitions("path", "block", "at").select("path", "size", "line")
    return small.unionByName(ordered.mapInArrow(_digests(), "file string, sha256 string"))


def input_digest(spark: SparkSession, path: str) -> str:
    """One SHA-256 of an input of one or more files: of a single file's bytes, or of the files' own digests in order of name."""
    files = [r.sha256 for r in input_fingerprint(spark, path).orderBy("file").collect()]  # one row per file
    return files[0] if len(files) == 1 else hashlib.sha256("".join(files).encode()).hexdigest()
