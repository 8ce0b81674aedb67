"""Message streams: a JSON body decoded by the declared payload schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..spec import SourceSpec, SpecError

# Prefix of the bus options a document may set, and the one it may not.
BUS_PREFIX = "eventhubs."
BUS_CONNECTION = "eventhubs.connectionString"
# Columns of a quarantine: the body, why it was not decoded, and whether.
BODY, ERROR, BAD = "_body", "_error", "_bad"
_CORRUPT = "__corrupt"


def decode_json(
    messages: DataFrame, body: str, schema: StructType, keep: Sequence[str] = ()
) -> DataFrame:
    """Payload columns of a JSON ``body``, after any ``keep`` columns.

    A body that is not JSON gives NULL in every payload column.
    """
    payload = F.from_json(F.col(body).cast("string"), schema)
    return messages.select(*keep, payload.alias("payload")).select(*keep, "payload.*")


def decode_or_explain(
    messages: DataFrame, body: str, schema: StructType, keep: Sequence[str] = ()
) -> DataFrame:
    """Payload columns as of ``decode_json``, then the body as text and why it was not decoded.

    A row is decoded (``_error`` is NULL) or it is not, then its payload is NULL: there
    is no body, it is not JSON, a value has another type than the schema says, or
    a field that must not be null is missing.
    """
    taken = {name.lower() for name in (*schema.names, *keep)} & {BODY, ERROR, BAD}
    if taken:
        raise SpecError(f"columns {sorted(taken)} are the quarantine's own")
    text = F.col(body).cast("string")
    loose = StructType([StructField(f.name, f.dataType) for f in schema] + [StructField(_CORRUPT, StringType())])
    found = F.from_json(text, loose, {"columnNameOfCorruptRecord": _CORRUPT, "mode": "PERMISSIVE"})
    read = messages.select(*keep, text.alias(BODY), found.alias("__found"))
    needed = [f.name for f in schema if not f.nullable]
    lacking = F.array_compact(
        F.array(*[F.when(F.col("__found")[name].isNull(), F.lit(name)) for name in needed])
        if needed
        else F.array().cast("array<string>")
    )
    error = (
        F.when(F.col(BODY).isNull(), "no body")
        .when(F.col("__found").isNull(), "no object")
        .when(F.col("__found")[_CORRUPT].isNotNull(), "not JSON of the declared schema")
        .when(F.size(lacking) > 0, F.concat(F.lit("lacks "), F.array_join(lacking, ", ")))
    )
    explained = read.withColumn(ERROR, error)
    payload = [F.when(F.col(ERROR).isNull(), F.col("__found")[f.name]).alias(f.name) for f in schema]
    return explained.select(*keep, *payload, BODY, ERROR, F.col(ERROR).isNotNull().alias(BAD))


def decoded_part(rows: DataFrame) -> DataFrame:
    """The rows that were decoded, without the columns that explain."""
    return rows.where(~F.col(BAD)).drop(BODY, ERROR, BAD)


def undecoded_part(rows: DataFrame, schema: StructType) -> DataFrame:
    """The rows that were not decoded: envelope columns, body and error."""
    return rows.where(BAD).drop(BAD, *schema.names)


def bus_options(source: SourceSpec) -> dict[str, str]:
    """Options handed to the bus reader.

    With a ``connection`` setting only bus options pass, and none of them can
    replace the connection string.
    """
    connection = source.optional("connection")
    if connection is None:
        return dict(source.options)
    allowed = {
        key: value
        for key, value in source.options.items()
        if key.startswith(BUS_PREFIX) and key != BUS_CONNECTION
    }
    return allowed | {BUS_CONNECTION: str(connection)}


def quarantined(source: SourceSpec | None) -> bool:
    """Whether a source tells rows that cannot be decoded from the others."""
    return source is not None and str(source.optional("quarantine", False)).lower() == "true"


def load_messages(spark: SparkSession, source: SourceSpec) -> DataFrame:
    """Stream of any Spark source whose rows carry a JSON body.

    ``envelope`` is the row schema for formats that need one declared, ``body``
    the column holding the JSON, ``keep`` the envelope columns to retain.  With
    ``quarantine`` rows that cannot be decoded come, too, marked and with their body.
    """
    if source.schema is None:
        raise SpecError("a message source needs the schema of its payload")
    reader = spark.readStream.format(source.format or "eventhubs")
    reader = reader.options(**bus_options(source))
    envelope = source.optional("envelope")
    if envelope is not None:
        reader = reader.schema(envelope)
    messages = reader.load(source.path) if source.path else reader.load()
    decode = decode_or_explain if quarantined(source) else decode_json
    return decode(
        messages,
        source.optional("body", "body"),
        source.schema,
        source.optional("keep", ()),
    )
