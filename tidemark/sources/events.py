"""Event sources: bounded scans, streams, and documents that carry their event as JSON."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import EVENTS
from tidemark.sources.files import exists
from tidemark.sources.tables import recover


def scan_events(spark: SparkSession, path: str, schema=EVENTS, fmt="parquet", **options) -> DataFrame:
    """A declared-schema scan. Parquet, ORC, JSON and CSV all take the same call."""
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


def scan_if_present(spark: SparkSession, path: str, schema=EVENTS, fmt="parquet", **options) -> DataFrame:
    """As :func:`scan_events`; a table that is not there yet is empty. Other errors are raised."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    recover(spark, path)
    return scan_events(spark, path, schema, fmt, **options)


def stream_events(spark: SparkSession, path: str, schema=EVENTS, fmt="parquet", files_per_batch=None, **options):
    """The growing table as a stream of the files added to it."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def decode_documents(documents: DataFrame, schema=EVENTS, body="body", required="doc_id") -> DataFrame:
    """JSON bodies to typed columns. Missing and malformed bodies are dropped.

    A malformed body parses to a row of nulls, so a required field is tested as well.
    """
    others = [c for c in documents.columns if c != body]
    parsed = documents.withColumn("_source", F.from_json(body, schema))
    kept = parsed.filter(F.col("_source").isNotNull() & F.col(f"_source.{required}").isNotNull())
    return kept.select(*others, "_source.*")


# Why a document is set aside.
MISSING, MALFORMED, NOT_AN_OBJECT, NO_ID = "missing body", "malformed body", "body is no object", "no value of a required field"
NOT_OF_TYPE = "field not of its type: "


def _judged(documents: DataFrame, schema, body, required) -> DataFrame:
    """``documents`` with the parsed body (``_body``, a variant) and why the document is set aside (``_reason``, null if not)."""
    # From a generator, whose output is worked out once: parsing as a plain column would be put into the filters on the
    # reason, once for each place that names it, and with it whatever the body is made of.
    parsed = documents.select("*", F.stack(F.lit(1), F.try_parse_json(F.col(body))).alias("_body"))
    value = {f.name: F.try_variant_get("_body", f"$.{f.name}", f.dataType.simpleString()) for f in schema.fields}
    raw = {f.name: F.try_variant_get("_body", f"$.{f.name}", "string") for f in schema.fields}
    # A field that is there, is not null, and cannot be read as its type. What can be read at all can be read as text.
    typed = [f.name for f in schema.fields if f.dataType.simpleString() != "string"]
    wrong = [F.when(value[n].isNull() & raw[n].isNotNull(), F.lit(n)) for n in typed] or [F.lit(None).cast("string")]
    # Only if blanks come before the brace need the schema be worked out.
    is_object = F.startswith(F.col(body), F.lit("{")) | F.schema_of_variant("_body").startswith("OBJECT")
    reason = (
        F.when(F.col(body).isNull(), MISSING)
        .when(F.col("_body").isNull(), MALFORMED)
        .when(~is_object, NOT_AN_OBJECT)
        .when(raw[required].isNull(), NO_ID)
        .when(F.coalesce(*wrong).isNotNull(), F.concat(F.lit(NOT_OF_TYPE), F.coalesce(*wrong)))
    )
    return parsed.withColumn("_reason", reason)


def decode_or_set_aside(documents: DataFrame, schema=EVENTS, body="body", required="doc_id", unknown="unknown"):
    """(accepted, set aside): every document is in exactly one of the two.

    Accepted: the declared columns, and ``unknown``, a map of the fields that the schema does not name, as JSON text, so
    that what a newer sender adds is kept. Set aside: the document as it came, and ``reason``. Null fields are null columns,
    absent ones too. Columns of ``documents`` other than the body pass through.
    """
    others = [c for c in documents.columns if c != body]
    judged = _judged(documents, schema, body, required)
    names = F.array(*[F.lit(f.name) for f in schema.fields])
    fields = F.from_json(F.col(body), "map<string,string>")
    typed = [F.try_variant_get("_body", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in schema.fields]
    accepted = judged.filter("_reason IS NULL").select(
        *others, *typed, F.map_filter(fields, lambda k, _: ~F.array_contains(names, k)).alias(unknown)
    )
    return accepted, judged.filter("_reason IS NOT NULL").select(*documents.columns, F.col("_reason").alias("reason"))
