"""Session documents: the JSON beside a drawing, read tolerantly and written whole; and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import migrated
from ..schema import LEDGER

ROW_FIELDS = ", ".join(f for f in LEDGER.split(", ") if f.split()[0] not in ("doc_id", "seq"))
SESSION = "ledger array<struct<" + ", ".join(f"{a}: {b}" for a, b in (f.split(" ", 1) for f in ROW_FIELDS.split(", "))) + ">>, uid_seq long, next_num long"


def parsed(documents: DataFrame) -> DataFrame:
    """IO-5: ``doc_id, json`` -> ledger rows with ``seq`` and ``uid_seq``; what can't be read gives no rows."""
    d = documents.select("doc_id", F.from_json("json", SESSION).alias("s"))
    rows = d.select("doc_id", F.coalesce("s.uid_seq", "s.next_num", F.lit(1)).cast("long").alias("uid_seq"), F.posexplode("s.ledger").alias("pos", "r"))
    return rows.select("doc_id", (F.col("pos") + 1).cast("long").alias("seq"), "r.*", "uid_seq")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """IO-5: all session files under a path; a drawing's id is its file's name. Migrated as on loading."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("doc_id"), F.col("value").alias("json"))
    return migrated(parsed(files).drop("uid_seq"))


def documents(ledger: DataFrame) -> DataFrame:
    """IO-6: ``doc_id, json``: each drawing's rows, in order, as one document."""
    fields = [c for c in ledger.columns if c not in ("doc_id", "seq", "uid_seq")]
    rows = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct(*fields).alias("r")))), lambda x: x["r"])
    whole = ledger.groupBy("doc_id").agg(rows.alias("ledger"), (F.coalesce(F.max("uid"), F.lit(0)) + 1).alias("uid_seq"))
    return whole.select("doc_id", F.to_json(F.struct("ledger", "uid_seq")).alias("json"))


def write_sessions(ledger: DataFrame, path: str) -> None:
    """IO-6: one line of text for each drawing's document; errors are raised."""
    documents(ledger).select("json").write.mode("overwrite").text(path)


def merged_config(defaults: dict, own: dict) -> dict:
    """IO-7: settings over their defaults; dictionaries merge one level deep."""
    return defaults | {k: defaults[k] | v if isinstance(v, dict) and isinstance(defaults.get(k), dict) else v for k, v in own.items()}


def read_config(spark: SparkSession, path: str, defaults: dict) -> dict:
    """IO-7: a small settings file; one that is missing or broken leaves the defaults."""
    import json

    from pyspark.errors import AnalysisException

    try:
        row = spark.read.text(path, wholetext=True).first()
        return merged_config(defaults, json.loads(row["value"]) if row else {})
    except (AnalysisException, ValueError):
        return dict(defaults)


def write_config(spark: SparkSession, path: str, config: dict) -> None:
    """IO-8."""
    import json

    spark.range(1).select(F.lit(json.dumps(config)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def merged_settings(own: Column, defaults: dict) -> Column:
    """IO-7 for many settings at once: JSON texts over the defaults -> map of ``name`` or ``section.name`` to a value's text.

    Sections, which are the dictionaries of the defaults, merge one level deep; one that is given
    as something else is replaced. NULL and what can't be read leave the defaults.
    """
    none = F.create_map().cast("map<string,string>")
    read = lambda text: F.coalesce(F.from_json(text, "map<string,string>"), none)
    over = lambda base, more: F.map_zip_with(base, more, lambda k, a, b: F.when(F.map_contains_key(more, k), b).otherwise(a))
    literal = lambda pairs: F.create_map(*[F.lit(v if i == 0 or isinstance(v, str) else str(v)) for pair in pairs for i, v in enumerate(pair)]).cast("map<string,string>")
    sections = {k: v for k, v in defaults.items() if isinstance(v, dict)}
    given = read(own)
    is_section = lambda text: F.coalesce(text.startswith("{"), F.lit(False))
    merged = over(literal([(k, v) for k, v in defaults.items() if k not in sections]), F.map_filter(given, lambda k, v: ~(k.isin(*sections) & is_section(v))))

    def section(name: str) -> Column:
        text = F.try_element_at(given, F.lit(name))
        inner = F.transform_keys(read(F.when(is_section(text), text)), lambda k, _: F.concat(F.lit(f"{name}."), k))
        base = literal([(f"{name}.{k}", v) for k, v in sections[name].items()])
        return F.when(F.map_contains_key(given, F.lit(name)) & ~is_section(text), none).otherwise(over(base, inner))

    for name in sections:
        merged = over(merged, section(name))
    return merged


def write_settings(settings: DataFrame, path: str) -> None:
    """IO-8: ``id, settings map<string,string>`` as a line of JSON each; NULL values are written too."""
    settings.select(F.to_json(F.struct("id", "settings"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """IO-8: what ``write_settings`` wrote; lines that can't be read are left out."""
    return spark.read.text(path).select(F.from_json("value", "id long, settings map<string,string>").alias("s")).select("s.*").where("id IS NOT NULL")
