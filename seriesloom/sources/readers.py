"""Readers and writers: files by suffix, literal arrays, nested manifests, columns from paths, synthetic rows.

File order is no order in Spark: whoever needs one passes an ordinal column.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {"parquet": "parquet", "csv": "csv", "json": "json", "jsonl": "json"}
PAYLOAD = T.StructType([T.StructField("id", T.LongType()), T.StructField("true", T.ArrayType(T.DoubleType())), T.StructField("distractors", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("decimals", T.IntegerType())])


def read_local(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """By suffix: parquet, csv, json or jsonl; anything else is an error. Blank lines of json are skipped."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"no reader for .{suffix}")
    reader = spark.read.format(FORMATS[suffix]).schema(schema)
    return (reader.option("header", True) if suffix == "csv" else reader).load(path)


def write_local(df: DataFrame, path: str, kind: str, mode: str = "errorifexists") -> None:
    """jsonl, csv with a header, or parquet; Spark's committer makes the output appear as a whole."""
    writer = df.write.mode(mode)
    {"jsonl": writer.json, "parquet": writer.parquet, "csv": writer.option("header", True).csv}[kind](path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; where it is unset on a local master, beside the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written in the shared folder and read back: its lineage ends there, and numbers given to rows hold for every later read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def discarded(df: DataFrame) -> None:
    """Deletes a stored table that no later plan reads."""
    spark, path = df.sparkSession, getattr(df, "_loom_path", None)
    if path:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def first_ids(spark: SparkSession, path: str, id_col: str, n: int, drop: list[str] | None = None, first: int = 2, growth: int = 2) -> tuple[DataFrame, int]:
    """Rows of the ``n`` smallest ids in the first files of a source that repeats ids, and how many files were read.

    Files are taken by name, ``first`` of them and then ``growth`` times as many, until they hold ``n`` ids; the last id may go
    on in the next file, so one more is read.  The limit counts ids, not rows; with fewer ids all rows come.
    """
    files = sorted(spark.read.parquet(path).inputFiles())
    taken = first
    while taken < len(files) and spark.read.parquet(*files[:taken]).select(id_col).distinct().limit(n + 1).count() <= n:
        taken = min(len(files), taken * growth)
    used = files[: taken + 1]
    rows = spark.read.parquet(*used).drop(*(drop or []))
    wanted = rows.select(id_col).distinct().orderBy(id_col).limit(n)
    return rows.join(wanted, id_col, "left_semi"), len(used)


def forecast_series(spark: SparkSession, path: str, target: str = "OT", order: str = "date") -> DataFrame:
    """(order, value) of a CSV's target column; a file without it is an error."""
    rows = spark.read.option("header", True).option("inferSchema", True).csv(path)
    if target not in rows.columns:
        raise ValueError(f"no column {target} among {', '.join(rows.columns)}")
    return rows.select(F.col(order).cast("long" if order != "date" else "timestamp").alias(order), F.col(target).cast("double").alias("value"))


def series_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, series) from a folder per id (``id=...``) of text with one value a line."""
    text = spark.read.text(path, wholetext=True)
    values = F.transform(F.filter(F.split("value", r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))
    return text.select("id", values.alias("series"))


def licensed_union(parts: dict[str, DataFrame], unclear: set[str], accept_unclear: bool = False) -> DataFrame:
    """All parts in one table with their ``source``; parts of an unclear licence are an error unless they are accepted."""
    if (held := sorted(unclear & set(parts))) and not accept_unclear:
        raise ValueError(f"the licence of {', '.join(held)} is unclear: accept it or leave them out")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("source", F.lit(name)) for name, df in parts.items()))


def timeout_stems(lines: DataFrame, key: str, order: str, text: str, most: int = 60) -> DataFrame:
    """(key, stem) of decision lines that come next after a time-out line of the same log."""
    form = r"\(\d+/\d+\)\s+\[(KEEP|CORRECT|DROP)\].*?\|\s*(.*)$"
    late = F.contains(text, F.lit("Request timed out"))
    decided = ~late & F.col(text).rlike(form)
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    place = lambda c: F.max(F.when(c, F.col(order))).over(before)
    rows = lines.select(key, text, decided.alias("decided"), place(late).alias("late"), place(decided).alias("last"))
    armed = F.col("late").isNotNull() & (F.col("last").isNull() | (F.col("late") > F.col("last")))
    return rows.where(F.col("decided") & armed).select(key, F.trim(F.substr(F.regexp_extract(text, form, 2), F.lit(1), F.lit(most))).alias("stem")).distinct()


def literal_array(text: Column, strict: bool = True) -> Column:
    """``[1.0, 2.5]`` as array<double>. Strict: an empty or malformed text fails the query; else bare nan is read and trouble gives null."""
    if strict:
        parsed = F.from_json(text, T.ArrayType(T.DoubleType()))
        return F.when(F.trim(text) == "", F.raise_error(F.lit("empty series")).cast("array<double>")).otherwise(F.coalesce(parsed, F.raise_error(F.concat(F.lit("not a list of numbers: "), text)).cast("array<double>")))
    inner = F.regexp_replace(text, r"[\[\]]", "")
    return F.when(F.trim(inner) != "", F.transform(F.split(inner, ","), lambda x: F.trim(x).try_cast("double")))


def manifest_payloads(lines: DataFrame, column: str = "message") -> DataFrame:
    """Unwraps a message list whose third content is a printed list of one (json, '') pair."""
    message = F.from_json(column, "array<struct<role:string,content:string>>")
    inner = F.regexp_extract(message[2]["content"], r"(?s)^\[\('(.*)',\s*''\)\]$", 1)
    return lines.select(F.from_json(F.regexp_replace(inner, r"\\(['\\])", "$1"), PAYLOAD).alias("p")).select("p.*")


def from_path(path: Column, pattern: str, names: list[str]) -> list[Column]:
    """One column per group of a pattern over a path."""
    return [F.nullif(F.regexp_extract(path, pattern, i), F.lit("")).alias(n) for i, n in enumerate(names, 1)]


def stem_parts(stem: Column) -> tuple[Column, Column, Column]:
    """(arm, control, order) of a file stem: known suffixes are the control or the order."""
    order = F.when(stem.endswith("_random"), "random").otherwise("knn")
    rest = F.regexp_replace(stem, "_random$", "")
    control = F.when(rest == "empty", "empty").otherwise(F.coalesce(F.nullif(F.regexp_extract(rest, "_(mismatch|valmask|nummask)$", 1), F.lit("")), F.lit("none")))
    return F.regexp_replace(rest, "_(mismatch|valmask|nummask)$", ""), control, order


def unparsed_share(lines: DataFrame, column: str = "value") -> DataFrame:
    """(bad, total) summed over every ``unparsed=a/b``; nulls where none was logged."""
    hits = lines.select(F.explode(F.regexp_extract_all(column, F.lit(r"unparsed=(\d+/\d+)"), 1)).alias("h"))
    return hits.agg(F.sum(F.split("h", "/")[0].cast("long")).alias("bad"), F.sum(F.split("h", "/")[1].cast("long")).alias("total"))


def report_drops(lines: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Dropped questions of a markdown report, by document ``key`` and line ``order``: header carried on, questions counted, stem from the next line."""
    w = Window.partitionBy(key).orderBy(order)
    header = F.nullif(F.regexp_extract(text, r"^## (\S+)", 1), F.lit(""))
    rows = lines.withColumn("image", F.last(header, ignorenulls=True).over(w)).withColumn("next", F.lead(text).over(w))
    asked = rows.withColumn("q", F.col(text).rlike(r"^- ").cast("int")).withColumn("question", F.sum("q").over(Window.partitionBy(key, "image").orderBy(order)) - 1)
    dropped = asked.where(F.col(text).rlike(r"\*\*DROP\*\*"))
    return dropped.select(key, "image", "question", F.trim(F.regexp_extract(text, r"— (.*)$", 1)).alias("reason"), F.trim(F.regexp_replace("next", r"^\s*-\s*", "")).alias("stem"))


def fold_annotations(rows: DataFrame) -> DataFrame:
    """(uid, series, annotations) from rows (uid, ord, series, annotation): the first finite series opens a uid, later rows add their distinct annotations."""
    from ..functions.sequence import is_finite

    ok = F.when(is_finite(F.col("series")) & (F.size("series") > 0), F.col("ord"))
    clean = rows.where(F.length(F.trim("annotation")) > 0).withColumn("first_ok", F.min(ok).over(Window.partitionBy("uid"))).where("ord >= first_ok")
    listed = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.trim("annotation").alias("a")))), lambda x: x["a"]))
    return clean.groupBy("uid").agg(F.min_by("series", "ord").alias("series"), listed.alias("annotations"))


def synthetic_fragments(ids: DataFrame, seed: int = 0) -> DataFrame:
    """(id, series, caption) of each row of ``ids`` (id): trend, bump, sine or step by id, of 24, 48 or 96 points, around 10."""
    base = ids.select("id", F.element_at(F.array(*map(F.lit, (24, 48, 96))), (F.col("id") % 3 + 1).cast("int")).alias("len"))
    noise = lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(1000)) / 1000 - 0.5) * 0.2
    kind, x = F.col("id") % 4, lambda i: i / F.col("len")
    value = lambda i: F.when(kind == 0, 5 * x(i)).when(kind == 1, 4 * F.exp(-F.pow((x(i) - 0.5) * 6, F.lit(2.0)))).when(kind == 2, 2 * F.sin(12.566 * x(i))).otherwise(F.when(x(i) < 0.5, 0.0).otherwise(3.0))
    series = F.transform(F.sequence(F.lit(0), F.col("len") - 1), lambda i: value(i) + noise(i) + 10)
    word = F.element_at(F.array(*map(F.lit, ("trend", "bump", "sine", "step"))), (kind + 1).cast("int"))
    return base.select("id", series.alias("series"), F.concat(F.lit("a "), word).alias("caption"))


def synthetic_items(rows: DataFrame, length: int = 96) -> DataFrame:
    """(id, label, split, series) of each row (id, lift): a rise, a wave or a step by id, ``lift`` higher than 1; the first 60 % by id train, the next 20 % validate."""
    from ..operators.neighbours import placed

    i, size = F.col("id"), F.lit(1) + F.col("lift")
    rise = lambda t: t / (length - 1.0) * size
    wave = lambda t: F.sin(F.lit(2) * F.pi() * t * (1 + i % 5) / length)
    step = lambda t: F.when(t < length // 2, 0.0).otherwise(size)
    series = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda t: F.when(i % 3 == 0, rise(t)).when(i % 3 == 1, wave(t)).otherwise(step(t)))
    label = F.element_at(F.array(*map(F.lit, ("rise", "wave", "step"))), (i % 3 + 1).cast("int"))
    split = F.when(F.col("place") < 0.6 * F.col("size"), "train").when(F.col("place") < 0.8 * F.col("size"), "val").otherwise("test")
    numbered = placed(rows.select(F.lit(0).alias("all"), "id", "lift"), ["all"], ["id"])
    return numbered.select("id", label.alias("label"), split.alias("split"), series.alias("series"))


def synthetic_annotations(ids: DataFrame, points: int = 12) -> DataFrame:
    """(id, cls, series, annotations) of each row: rising, falling, flat or spiky by id, with two annotations."""
    kind, places = F.col("id") % 4, F.sequence(F.lit(0), F.lit(points - 1))
    value = lambda t: F.when(kind == 0, t).when(kind == 1, points - 1 - t).when(kind == 2, F.lit(5)).otherwise(F.when(t % 5 == 3, 5).otherwise(0)).cast("double")
    named = lambda *words: F.element_at(F.array(*map(F.lit, words)), (kind + 1).cast("int"))
    annotations = F.array(F.concat(F.lit("the line "), named("rises", "falls", "is flat", "is spiky")), F.concat(F.lit("values "), named("go up", "go down", "stay", "jump")))
    return ids.select("id", named("rising", "falling", "flat", "spiky").alias("cls"), F.transform(places, value).alias("series"), annotations.alias("annotations"))


def data_uri(content: Column, kind: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(content))
