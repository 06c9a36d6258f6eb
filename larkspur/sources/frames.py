"""Readers and writers of the typed text formats, and of bounded views of a table.

csv has one line per column (NAME:COUNT:<type>:values), csv2 a header of NAME:COUNT:<type>
and one line per row, json an object of columns with name, count, type and values. All are
read and written by Spark's tasks; in the column-wise ones a column is one line and thus one
task's work, at most 2 GB of text. Only headers come to the driver. Parquet takes the place
of the binary format, and Arrow's stream that of a table as bytes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Type tags of the formats and the Spark types that hold them.
TYPES = {
    "float": "float", "double": "double", "longdouble": "double", "short": "smallint", "ushort": "int", "int": "int", "uint": "bigint", "long": "bigint", "longlong": "bigint", "ulong": "bigint",
    "ulonglong": "bigint", "char": "string", "uchar": "string", "bool": "boolean", "string": "string", "vstr8": "string", "vstr16": "string", "vstr32": "string", "vstr64": "string", "vstr128": "string",
    "vstr512": "string", "vstr1K": "string", "vstr2K": "string", "DateTime": "timestamp", "DateTimeAME": "timestamp", "DateTimeEUR": "timestamp", "DateTimeISO": "timestamp",
    "str_dbl_pair": "struct<first:string,second:double>", "str_str_pair": "struct<first:string,second:string>", "dbl_dbl_pair": "struct<first:double,second:double>",
    "dbl_vec": "array<double>", "str_vec": "array<string>", "dbl_set": "array<double>", "str_set": "array<string>", "str_dbl_map": "map<string,double>", "str_dbl_unomap": "map<string,double>",
}
TAGS = {"float": "float", "double": "double", "smallint": "short", "int": "int", "bigint": "long", "string": "string", "boolean": "bool", "timestamp": "DateTimeISO", "array<double>": "dbl_vec", "array<string>": "str_vec", "map<string,double>": "str_dbl_map"}
_HEAD = re.compile(r"\s*([^:]+):(\d*):<([^>]+)>\s*:?")


def _value(text: str, tag: str):
    text = text.strip()
    if text == "" or (text.lower() == "nan" and tag != "string"):
        return None
    kind = TYPES[tag]
    if kind in ("float", "double"):
        return float(text)
    if kind in ("smallint", "int", "bigint"):
        return int(float(text)) if "." in text else int(text)
    if kind == "boolean":
        return text not in ("0", "false", "False")
    if kind == "timestamp":
        return _time(text, tag)
    body = re.sub(r"^\d*[\[{<]|[\]}>]$", "", text)
    if kind.startswith("array"):
        items = [x for x in body.split("|") if x != ""]
        items = [float(x) for x in items] if "double" in kind else items
        return sorted(set(items)) if tag.endswith("set") else items
    if kind.startswith("map"):
        return {k: float(v) for k, _, v in (x.rpartition(":") for x in body.split("|") if x)}
    if kind.startswith("struct"):
        first, _, second = body.partition(":")
        return (float(first) if tag == "dbl_dbl_pair" else first, second if tag == "str_str_pair" else float(second))
    return text


def _time(text: str, tag: str):
    from datetime import datetime, timedelta, timezone

    if re.fullmatch(r"-?\d+(\.\d+)?", text) and len(text.split(".")[0]) != 8:
        seconds, _, rest = text.partition(".")
        return datetime(1970, 1, 1, tzinfo=timezone.utc).replace(tzinfo=None) + timedelta(seconds=int(seconds), microseconds=int((rest or "0").ljust(9, "0")[:6]))
    numbers = [int(x) for x in re.findall(r"\d+", text)]
    if len(text.split()[0]) == 8 and text[:8].isdigit():
        date, rest = (int(text[:4]), int(text[4:6]), int(text[6:8])), numbers[1:]
    else:
        a, b, c = numbers[:3]
        date, rest = ((a, b, c) if tag in ("DateTimeISO", "DateTime") or a > 31 else (c, a, b) if tag == "DateTimeAME" else (c, b, a)), numbers[3:]
    clock = [*rest[:3], 0, 0, 0][:3]
    micro = int(str(rest[3]).ljust(6, "0")[:6]) if len(rest) > 3 else 0
    return datetime(*date, *clock, micro)


def _frame(spark: SparkSession, columns: list[tuple[str, str, list]]) -> DataFrame:
    """Columns of different lengths as one table; short ones end in nulls. __pos is the row's place."""
    n = max((len(v) for _, _, v in columns), default=0)
    schema = T.StructType([T.StructField("__pos", T.LongType()), *T.StructType.fromDDL(", ".join(f"`{name}` {TYPES[tag]}" for name, tag, _ in columns)).fields])
    return spark.createDataFrame([(i, *[v[i] if i < len(v) else None for _, _, v in columns]) for i in range(n)], schema)


def from_string(spark: SparkSession, text: str) -> DataFrame:
    return _frame(spark, [_column(x) for x in text.splitlines() if x.strip() and not x.startswith("#")])


def _column(line: str) -> tuple[str, str, list]:
    head = _HEAD.match(line)
    if not head or head[3] not in TYPES:
        raise ValueError(f"no column header in {line[:60]!r}")
    parts = line[head.end() :].split(",")
    if parts and parts[-1].strip() == "":
        parts.pop()
    return head[1], head[3], [_value(x, head[3]) for x in parts]


def _by_column(lines: DataFrame, head: str, items: Callable[[Column], Column]) -> DataFrame:
    """A table from lines that hold a column each: heads are read first, then all cells are dealt out by their place."""
    line = F.col("value")
    heads = lines.select(F.regexp_extract(line, head, 1).alias("name"), F.regexp_extract(line, head, 2).alias("tag"), F.monotonically_increasing_id().alias("at")).where("name <> ''")
    names = sorted(heads.groupBy("name").agg(F.min_by("tag", "at").alias("tag"), F.min("at").alias("at")).collect(), key=lambda r: r["at"])
    unknown = [r["tag"] for r in names if r["tag"] not in TYPES]
    if unknown:
        raise ValueError(f"unknown column types {unknown}")
    cells = lines.select(F.regexp_extract(line, head, 1).alias("name"), items(line).alias("items")).where("name <> ''")
    cells = cells.withColumn("items", F.when(F.trim(F.element_at("items", -1)) == "", F.slice("items", 1, F.size("items") - 1)).otherwise(F.col("items")))
    cells = cells.select("name", F.posexplode("items").alias("__pos", "cell"))
    picks = [_cast(F.trim(F.max(F.when(F.col("name") == r["name"], F.col("cell")))), r["tag"]).alias(r["name"]) for r in names]
    return cells.groupBy(F.col("__pos").cast("long").alias("__pos")).agg(*picks)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """One line per column; lines that are empty or begin with # are skipped, short columns end in nulls."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    return _by_column(lines, r"^\s*([^:]+):\d*:<([^>]+)>", lambda x: F.split(F.regexp_replace(x, r"^\s*[^:]+:\d*:<[^>]+>\s*:?", ""), ",", -1))


def read_csv2(spark: SparkSession, path: str, schema: list[tuple[str, str]] | None = None, delimiter: str = ",", skip_header: bool = False, first_row: int = 0, n_rows: int | None = None) -> DataFrame:
    """Row-wise text, read in parallel. The header, or ``schema`` as (name, tag), gives names and types.

    ``first_row`` and ``n_rows`` choose a range of rows by their place in the file.
    """
    from larkspur.plans import POS, with_positions

    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    if schema is None:
        header = lines.first()[0]
        schema = [(m[1].strip(), m[3]) for m in (_HEAD.match(x) for x in header.split(delimiter)) if m]
        lines = lines.where(F.col("value") != header)
    elif skip_header:
        lines = lines.where(F.col("value") != lines.first()[0])
    parts = F.split("value", re.escape(delimiter), -1)
    cell = lambda i: F.trim(F.regexp_replace(F.get(F.col("__p"), F.lit(i)), r'^\s*"|"\s*$', ""))
    out = with_positions(lines).withColumn("__p", parts).select(POS, *[_cast(cell(i), tag).alias(name) for i, (name, tag) in enumerate(schema)])
    if first_row or n_rows is not None:
        out = out.where((F.col(POS) >= first_row) & ((F.col(POS) < first_row + n_rows) if n_rows is not None else F.lit(True)))
    return out


def _cast(x, tag: str):
    kind = TYPES[tag]
    filled = F.when(x != "", x)
    if kind == "boolean":
        return ~filled.isin("0", "false", "False")
    if kind == "timestamp":
        pattern = {"DateTimeAME": "M/d/yyyy[ H:m:s[.SSSSSS]]", "DateTimeEUR": "d/M/yyyy[ H:m:s[.SSSSSS]]"}.get(tag)
        epoch = F.when(filled.rlike(r"^-?\d+(\.\d+)?$"), F.timestamp_micros((filled.cast("decimal(28,9)") * 1000000).cast("bigint")))
        parsed = F.try_to_timestamp(F.replace(filled, F.lit("-"), F.lit("/")) if pattern else filled, F.lit(pattern)) if pattern else F.try_to_timestamp(filled)
        return F.coalesce(epoch, parsed)
    body = F.regexp_replace(filled, r"^\d*[\[{<]|[\]}>]$", "")
    if kind.startswith("array"):
        items = F.filter(F.split(body, r"\|"), lambda v: v != "").cast(kind)
        return F.array_sort(F.array_distinct(items)) if tag.endswith("set") else items
    if kind.startswith("map"):
        pairs = F.transform(F.filter(F.split(body, r"\|"), lambda v: v != ""), lambda v: F.struct(F.regexp_extract(v, "^(.*):", 1).alias("k"), F.regexp_extract(v, ":([^:]*)$", 1).cast("double").alias("v")))
        return F.map_from_entries(pairs)
    if kind.startswith("struct"):
        return F.struct(F.substring_index(body, ":", 1).alias("first"), F.regexp_extract(body, ":(.*)$", 1).alias("second")).cast(kind)
    return filled if kind == "string" else filled.try_cast(kind)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Objects {"name": {"N": count, "T": type, "D": [values]}}; bare characters and empty items are let through.

    Values that hold the closing "]}" of a column themselves are not read whole.
    """
    lines = spark.read.option("lineSep", "]}").text(path)  # one column each
    head = r'"([^"]+)"\s*:\s*\{\s*"N"\s*:\s*\d+\s*,\s*"T"\s*:\s*"([^"]+)"\s*,\s*"D"\s*:\s*\['

    def items(x: Column) -> Column:
        body = F.regexp_extract(x, head + r"([\s\S]*)$", 3)
        plain = F.transform(F.split(body, ",", -1), lambda v: F.regexp_replace(F.trim(v), r'^"|"$', ""))
        return F.coalesce(F.transform(F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<string>"), lambda v: F.coalesce(v, F.lit(""))), plain)

    return _by_column(lines, head, items)


def _tag(df: DataFrame, name: str) -> str:
    return TAGS.get(df.schema[name].dataType.simpleString(), "string")


def _text(v, precision: int) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "1" if v else "0"
    if isinstance(v, float):
        return f"{v:.{precision}g}"
    if isinstance(v, list):
        return f"{len(v)}[{'|'.join(_text(x, precision) for x in v)}]"
    if isinstance(v, dict):
        return f"{len(v)}{{{'|'.join(f'{k}:{_text(x, precision)}' for k, x in v.items())}}}"
    return str(v)


def bounded(df: DataFrame, max_recs: int) -> DataFrame:
    """The first rows by position, or the last ones when ``max_recs`` is negative."""
    pos = F.col("__pos")
    return df.orderBy(pos).limit(max_recs) if max_recs >= 0 else df.orderBy(pos.desc()).limit(-max_recs).orderBy(pos)


def to_string(df: DataFrame, max_recs: int = 1000, precision: int = 12) -> str:
    """The csv form of at most ``max_recs`` rows."""
    rows = bounded(df, max_recs).collect()
    names = [c for c in df.columns if c != "__pos"]
    return "".join(f"{c}:{len(rows)}:<{_tag(df, c)}>:{','.join(_text(r[c], precision) for r in rows)},\n" for c in names)


def _as_text(df: DataFrame, name: str) -> Column:
    kind, x = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.BooleanType):
        return x.cast("int").cast("string")
    if isinstance(kind, T.ArrayType):
        return F.concat(F.size(x), F.lit("["), F.array_join(x.cast("array<string>"), "|"), F.lit("]"))
    if isinstance(kind, T.MapType):
        pairs = F.transform(F.array_sort(F.map_entries(x)), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")))
        return F.concat(F.size(x), F.lit("{"), F.array_join(pairs, "|"), F.lit("}"))
    if isinstance(kind, T.StructType):
        return F.concat(F.lit("<"), F.concat_ws(":", *[x[f].cast("string") for f in kind.fieldNames()]), F.lit(">"))
    return x.cast("string")


def _column_lines(df: DataFrame) -> DataFrame:
    """name, tag, count and texts in order of the columns."""
    names = [c for c in df.columns if c != "__pos"]
    long = df.select("__pos", F.explode(F.array(*[F.struct(F.lit(i).alias("number"), F.coalesce(_as_text(df, c), F.lit("")).alias("cell")) for i, c in enumerate(names)])).alias("c")).select("__pos", "c.*")
    columns = long.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("__pos", "cell"))).alias("cells"))
    label = lambda texts: F.element_at(F.array(*[F.lit(t) for t in texts]), F.col("number") + 1)
    return columns.select("number", label(names).alias("name"), label([_tag(df, c) for c in names]).alias("tag"), F.size("cells").alias("count"), F.col("cells.cell").alias("texts"))


def write_csv(df: DataFrame, path: str) -> None:
    """One line per column; each is put together by one task."""
    line = F.concat(F.col("name"), F.lit(":"), F.col("count"), F.lit(":<"), F.col("tag"), F.lit(">:"), F.array_join("texts", ","), F.lit(","))
    _column_lines(df).repartitionByRange("number").sortWithinPartitions("number").select(line.alias("value")).write.text(path)


def write_json_files(df: DataFrame, path: str) -> None:
    """A file for each column, {"name": {"N", "T", "D"}}, which ``read_json`` reads together."""
    bare = F.col("tag").isin("float", "double", "short", "int", "long", "bool")
    quoted = F.transform("texts", lambda v: F.when(bare, v).otherwise(F.substring(F.to_json(F.array(v)), 2, 1 << 30).substr(F.lit(1), F.length(F.to_json(F.array(v))) - 2)))
    line = F.concat(F.lit('{"'), F.col("name"), F.lit('":{"N":'), F.col("count"), F.lit(',"T":"'), F.col("tag"), F.lit('","D":['), F.array_join(quoted, ","), F.lit("]}}"))
    _column_lines(df).repartition("number").select(line.alias("value")).write.text(path)


def write_csv2(df: DataFrame, path: str, delimiter: str = ",", columns_only: bool = False) -> None:
    """Typed header as a comment-free first column name line in every file; rows are written in parallel."""
    names = [c for c in df.columns if c != "__pos" and not (columns_only and c == "INDEX")]
    header = [f"{c}::<{_tag(df, c)}>" for c in names]
    df.select(*[_as_text(df, c).alias(h) for c, h in zip(names, header)]).write.option("header", True).option("sep", delimiter).csv(path)


def write_binary(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def read_binary(spark: SparkSession, path: str, first_row: int = 0, n_rows: int | None = None) -> DataFrame:
    """What ``write_binary`` wrote, or rows of it by their place."""
    df = spark.read.parquet(path)
    if not first_row and n_rows is None:
        return df
    from larkspur.plans import with_positions

    df = df if "__pos" in df.columns else with_positions(df)
    return df.where((F.col("__pos") >= first_row) & ((F.col("__pos") < first_row + n_rows) if n_rows is not None else F.lit(True)))


def serialize(df: DataFrame, max_recs: int) -> bytes:
    """At most ``max_recs`` rows as bytes, an Arrow stream; the bound is the caller's, since bytes live in one process."""
    import pyarrow as pa

    table = (bounded(df, max_recs) if "__pos" in df.columns else df.limit(max_recs)).toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def deserialize(spark: SparkSession, data: bytes) -> DataFrame:
    import pyarrow as pa

    with pa.ipc.open_stream(data) as reader:
        return spark.createDataFrame(reader.read_all())


def write_json(df: DataFrame, max_recs: int = 1000) -> str:
    rows = bounded(df, max_recs).collect()
    return json.dumps({c: {"N": len(rows), "T": _tag(df, c), "D": [r[c] for r in rows]} for c in df.columns if c != "__pos"}, default=str)


def render(df: DataFrame, style: str = "pretty", max_recs: int = 100, precision: int = 12) -> str:
    """pretty, markdown, latex or html text of a bounded number of rows."""
    names = [c for c in df.columns if c != "__pos"]
    rows = [[_text(r[c], precision) for c in names] for r in bounded(df, max_recs).collect()]
    if style == "html":
        cells = lambda tag, r: "".join(f"<{tag}>{x}</{tag}>" for x in r)
        return "<table>\n" + "\n".join(f"<tr>{cells('th' if i == 0 else 'td', r)}</tr>" for i, r in enumerate([names, *rows])) + "\n</table>\n"
    if style == "latex":
        return "\\begin{tabular}{" + "l" * len(names) + "}\n" + "".join(" & ".join(r) + " \\\\\n" for r in [names, *rows]) + "\\end{tabular}\n"
    if style == "markdown":
        return "".join("| " + " | ".join(r) + " |\n" for r in [names, ["---"] * len(names), *rows])
    wide = [max(len(r[i]) for r in [names, *rows]) for i in range(len(names))]
    return "".join("  ".join(x.rjust(w) for x, w in zip(r, wide)) + "\n" for r in [names, *rows])
