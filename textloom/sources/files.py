"""Small structured files: JSON with defaults, CSV, checkpoints' names, manifests, reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "fact_id string, truth_value string, domain string, entity_tier string, arm string, assigned_frequency int, rendering_id string, embedded string, heldout string, shard_file string"
SCORES = "arm string, probe_set string, fact_id string, pass string, template_idx int, truth_value string, entity_tier string, assigned_frequency string, is_frame0 string, logp_value double, logp_competing double, n_tok_value int, n_tok_competing int"
PROBE = "struct<subject:string,prompt:string,target_true:struct<str:string>,target_new:struct<str:string>,requested_rewrite:struct<subject:string,prompt:string,target_true:struct<str:string>,target_new:struct<str:string>>>"


def shard_ids(spark: SparkSession, n: int, last: int) -> DataFrame:
    """The first ``n`` shards and always the last one, which is the validation shard."""
    return spark.range(min(n, last)).select(F.col("id").alias("shard")).unionByName(spark.range(last, last + 1).select(F.col("id").alias("shard")))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are left out; absent fields are null."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def write_manifest(rows: DataFrame, path: str, order: list[str]) -> None:
    """One CSV with a header. A manifest has a row an injected slot, so one file in a stated order is what its readers expect."""
    rows.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def with_defaults(raw: Column, schema: str, defaults: dict[str, str]) -> Column:
    """A JSON string as a struct of ``schema``, with defaults for keys that older writers didn't have."""
    parsed = F.from_json(raw, schema)
    for name, value in defaults.items():
        parsed = parsed.withField(name, F.coalesce(parsed[name], F.lit(value)))
    return parsed


def latest_step(files: DataFrame, path: str = "path", modified: str | None = None) -> DataFrame:
    """Of checkpoint files, the model and its last step, by name: model, depth and step.

    The model with the largest tag d<N> counts; if none has one, that of the file last ``modified`` (a column). No
    files give no row.
    """
    step, model = F.regexp_extract(path, r"model_(\d+)\.pt$", 1), F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1)
    tag = F.regexp_extract(model, r"^d(\d+)$", 1)
    when = F.lit(0) if modified is None else F.col(modified)
    rows = files.where(step != "").select(model.alias("model"), F.nullif(tag, F.lit("")).cast("int").alias("depth"), step.cast("int").alias("step"), when.alias("at"))
    models = rows.groupBy("model").agg(F.max("depth").alias("depth"), F.max("step").alias("step"), F.max("at").alias("at"))
    rank = F.struct(F.coalesce("depth", F.lit(-1)).alias("depth"), F.when(F.col("depth").isNull(), F.col("at")).alias("at"), "model")
    return models.agg(F.max_by(F.struct("model", "depth", "step"), rank).alias("m")).where("m is not null").select("m.model", "m.depth", "m.step")


def external_probes(lines: DataFrame, limit: int | None = None, line: str = "value", number: str = "line_no") -> DataFrame:
    """External facts, of which ``limit`` keeps the first by place: subject, cloze, true_value, false_value; fields are nested or flat, the subject is put into the prompt."""
    rows = (lines if limit is None else lines.where(F.col(number) < limit)).withColumn("r", F.from_json(line, PROBE))
    either = lambda name: F.coalesce(F.col(f"r.requested_rewrite.{name}"), F.col(f"r.{name}"))
    stem = F.rtrim(F.replace(either("prompt"), F.lit("{}"), either("subject")))
    out = rows.select(number, either("subject").alias("subject"), F.concat(stem, F.lit(" ___.")).alias("cloze"), either("target_true.str").alias("true_value"), either("target_new.str").alias("false_value"))
    return out.where("subject is not null and true_value is not null and false_value is not null")


def report_section(title: str, metrics: DataFrame, at: Column, key: str = "key", value: str = "value", order: str = "place") -> DataFrame:
    """file and text of a report's section: a heading, a time, and a line a metric in order."""
    from textloom.functions.render import slug

    lines = metrics.agg(F.array_sort(F.collect_list(F.struct(order, F.concat(F.lit("- "), key, F.lit(": "), value).alias("line")))).alias("x"))
    body = F.array_join(F.transform("x", lambda s: s["line"]), "\n")
    head = F.concat(F.lit(f"## {title}\ntimestamp: "), F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("\n\n"))
    return lines.select(F.concat(slug(F.lit(title)), F.lit(".md")).alias("file"), F.concat(head, body, F.lit("\n\n")).alias("text"))


def environment(spark: SparkSession) -> DataFrame:
    """One row on where a run took place."""
    import os
    import platform

    return spark.createDataFrame([(platform.system(), platform.python_version(), spark.version, os.cpu_count())], "system string, python string, spark string, cpus int")


def list_files(spark: SparkSession, folders: list[str], pattern: str = "*.parquet") -> DataFrame:
    """path, file and place (by name, from 0) of the first of ``folders`` that has files of the pattern; none gives no rows.

    A listing by Spark's reader: any store that it reads will do, and contents aren't opened. A shard that is a folder
    of parts counts as one file. Unfinished files end in .tmp and don't match.
    """
    for folder in folders:
        try:
            files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path")
        except AnalysisException:
            continue  # no such folder
        if not files.isEmpty():
            named = files.select(F.regexp_extract("path", r"^(.*?/([^/]+\.[a-z]+))(?:/|$)", 1).alias("path"), F.regexp_extract("path", r"/([^/]+\.[a-z]+)(?:/|$)", 1).alias("file")).distinct()
            return named.withColumn("place", (F.row_number().over(Window.orderBy("file")) - 1).cast("int"))
    return spark.createDataFrame([], "path string, file string, place int")


def splits(files: DataFrame) -> DataFrame:
    """``files`` (place) with split: the last one is 'val', all before it 'train'."""
    return files.withColumn("split", F.when(F.col("place") == F.max("place").over(Window.partitionBy()), "val").otherwise("train"))


def task_list(lines: DataFrame, key: str, line: str = "value", number: str = "line_no") -> DataFrame:
    """task (from 0), name and value of a YAML file's list ``key`` of flat maps: scalars, and the first item of short lists.

    Of YAML this reads what task lists use: items that begin with a dash, ``name: value`` lines, comments, quotes, lists
    in brackets.
    """
    bare = F.regexp_replace(F.col(line), r"\s+#.*$|^#.*$", "")
    rows = lines.select(F.col(number).alias("n"), bare.alias("line")).where(F.trim("line") != "")
    by = Window.orderBy("n")  # a configuration file: some hundred lines
    top = F.when(~F.col("line").rlike(r"^[\s-]"), F.regexp_extract("line", r"^([^:]+):", 1))
    rows = rows.withColumn("top", F.last(top, ignorenulls=True).over(by)).where((F.col("top") == key) & F.col("line").rlike(r"^[\s-]"))
    rows = rows.withColumn("task", F.sum(F.col("line").rlike(r"^\s*-\s").cast("int")).over(by) - 1)
    name = F.regexp_extract("line", r"^\s*(?:-\s+)?([^:\s]+)\s*:", 1)
    value = F.trim(F.regexp_extract("line", r"^\s*(?:-\s+)?[^:\s]+\s*:(.*)$", 1))
    first = F.when(value.startswith("["), F.trim(F.split(F.regexp_replace(value, r"^\[|\]$", ""), ",")[0])).otherwise(value)
    plain = F.regexp_replace(first, "^(['\"])(.*)\\1$", "$2")
    return rows.where(name != "").select(F.col("task").cast("int").alias("task"), name.alias("name"), plain.alias("value"))


def write_scores(scores: DataFrame, path: str, order: list[str]) -> None:
    """Belief scores as one CSV in a stated order, log-probabilities rounded half to even to five places."""
    rounded = scores.withColumn("logp_value", F.bround("logp_value", 5)).withColumn("logp_competing", F.bround("logp_competing", 5))
    rounded.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def result_lines(results: DataFrame) -> DataFrame:
    """place and line of a table of results (place, label, accuracy, centered): padded columns, a head, and the mean of the centered ones at the end."""
    number = lambda c: F.rpad(F.format_string("%.6f", c), 10, " ")
    line = lambda a, b, c: F.concat(F.rpad(a, 35, " "), F.lit(", "), b, F.lit(", "), c)
    blank = lambda t: F.rpad(F.lit(t), 10, " ")
    label = F.when(F.length("label") > 35, F.col("label")).otherwise(F.rpad("label", 35, " "))
    body = results.select((F.col("place") + 1).cast("int").alias("place"), F.concat(label, F.lit(", "), number("accuracy"), F.lit(", "), number("centered")).alias("line"))
    ends = results.agg(F.max("place").alias("last"), F.avg("centered").alias("core"))
    head = ends.select(F.lit(0).alias("place"), line(F.lit("Task"), blank("Accuracy"), blank("Centered")).alias("line"))
    tail = ends.select((F.coalesce("last", F.lit(-1)) + 2).cast("int").alias("place"), line(F.lit("CORE"), blank(""), F.coalesce(number("core"), blank("nan"))).alias("line"))
    return head.unionByName(body).unionByName(tail)


def write_lines(lines: DataFrame, path: str, place: str = "place", line: str = "line") -> None:
    """A report of some hundred lines as one text file in order."""
    lines.orderBy(place).coalesce(1).select(line).write.mode("overwrite").text(path)
