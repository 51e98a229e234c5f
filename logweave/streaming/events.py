"""Live log events to entries: XML events and structured (JSON) events. Works on batches and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.fields import from_epoch_millis
from logweave.operators.stitch import CHUNK_BITS, stitch
from logweave.schema import DISCONNECT, REMOTE_APP

# Tags of the XML event format.
XML_END = "</log4j:event>"
_XML_EVENT = r"(?s)<log4j:event[\s>].*?</log4j:event>"
_XML_TAG = r"""(?s)<log4j:event((?:\s+[\w:.\-]+\s*=\s*"[^"]*")*)\s*>"""
_XML_MESSAGE = r"(?s)<log4j:message><!\[CDATA\[(.*?)\]\]></log4j:message>"
_XML_THROWABLE = r"(?s)<log4j:throwable><!\[CDATA\[(.*?)\]\]></log4j:throwable>"

# Why an event cannot be read.
NO_EVENT = "no event in the frame"
UNKNOWN_FAMILY, NO_JSON, NO_MESSAGE = "unknown family", "the payload is no JSON", "the payload has no message"

# Field names of the three structured event families.
FAMILIES = {
    "logback": "struct<timeStamp:bigint,level:string,threadName:string,loggerName:string,"
    "formattedMessage:string,mdc:struct<application:string>,throwable:string>",
    "log4j1": "struct<timeStamp:bigint,level:string,threadName:string,loggerName:string,"
    "renderedMessage:string,mdc:struct<application:string>,throwable:array<string>>",
    "log4j2": "struct<timeMillis:bigint,level:string,threadName:string,loggerName:string,"
    "message:string,contextData:struct<application:string>,thrown:string>",
}


def frame_xml(lines: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Batch framing: lines of each connection up to one with an end tag are one frame.

    ``lines`` has remote, seq, line and event_kind. The result has remote, seq (of the closing line) and xml;
    lines without an end tag before a disconnect or the end are not complete and left out.
    """
    gone = F.col("event_kind") == DISCONNECT
    keyed = lines.select(
        F.col("remote").alias("source_path"),
        F.lit(0).cast("long").alias("block_start"),
        F.col("seq").alias("line_id"),
        F.when(gone, F.lit("")).otherwise(F.col("line")).alias("value"),
        (gone | F.contains("line", F.lit(XML_END))).alias("is_start"),
    )
    framed = stitch(keyed, keep=(), chunk_bits=chunk_bits, closing=True).filter(F.col("headed") & F.contains("raw", F.lit(XML_END)))
    return framed.select(F.col("source_path").alias("remote"), F.col("line_id").alias("seq"), F.concat("raw", F.lit("\n")).alias("xml"))


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"""\s{name}\s*=\s*"([^"]*)\"""", 1)


def tagged_xml(frames: DataFrame, zone: str = "UTC") -> DataFrame:
    """What :func:`read_xml` gives, and in the same pass, with a ``reason``, the frames and events that cannot be read.

    Their text is in ``raw``. Write the result once and split it by ``reason`` to keep both.
    """
    one = F.when(
        F.regexp_count("xml", F.lit(XML_END)) <= 1, F.when(F.regexp_like("xml", F.lit(_XML_TAG)), F.array("xml"))
    ).otherwise(F.regexp_extract_all("xml", F.lit(_XML_EVENT), F.lit(0)))
    rest = [c for c in frames.columns if c != "xml"]
    tagged = (
        frames.select(*rest, F.col("xml").alias("_frame"), F.posexplode_outer(one).alias("event", "xml"))
        .withColumn("_tag", F.coalesce(F.regexp_extract("xml", _XML_TAG, 1), F.lit("")))
    )
    throwable = F.regexp_extract("xml", _XML_THROWABLE, 1)
    message = F.regexp_extract("xml", _XML_MESSAGE, 1)
    has_throwable = F.regexp_like("xml", F.lit(_XML_THROWABLE))
    return tagged.select(
        *rest,
        "event",
        from_epoch_millis(_attribute(F.col("_tag"), "timestamp").try_cast("bigint"), zone).alias("timestamp"),
        *[_attribute(F.col("_tag"), a).alias(a) for a in ("level", "thread", "logger")],
        F.when(has_throwable, F.concat(message, F.lit("\n"), throwable)).otherwise(message).alias("message"),
        F.lit(REMOTE_APP).alias("source"),
        F.coalesce("xml", "_frame").alias("raw"),
        F.when(F.col("_tag") == "", NO_EVENT).alias("reason"),
    )


def read_xml(frames: DataFrame, zone: str = "UTC") -> DataFrame:
    """XML frames to entries: typed attributes in any order, CDATA message, throwable appended.

    A frame with several events gives several entries (``event`` counts them); one without any is left out, see
    :func:`tagged_xml`. A time that is no number gives a null timestamp.
    """
    return _read(tagged_xml(frames, zone))


def _read(tagged: DataFrame) -> DataFrame:
    return tagged.filter(F.col("reason").isNull()).drop("reason")


def tagged_structured(events: DataFrame, zone: str = "UTC") -> DataFrame:
    """What :func:`read_structured` gives, and in the same pass, with a ``reason``, the events that cannot be read.

    Their payload is in ``raw``.
    """
    parsed = events
    for family, schema in FAMILIES.items():
        parsed = parsed.withColumn(f"_{family}", F.when(F.col("family") == family, F.from_json("payload", schema)))
    a, b, c = F.col("_logback"), F.col("_log4j1"), F.col("_log4j2")

    def either(name):
        return F.coalesce(a[name], b[name], c[name])

    message = F.coalesce(a["formattedMessage"], b["renderedMessage"], c["message"])
    thrown = F.coalesce(a["throwable"], F.array_join(b["throwable"], "\n"), c["thrown"])
    whole = F.concat(message, F.coalesce(F.concat(F.lit("\n"), thrown), F.lit("")))
    app = F.coalesce(a["mdc"]["application"], b["mdc"]["application"], c["contextData"]["application"])
    millis = F.coalesce(a["timeStamp"], b["timeStamp"], c["timeMillis"])
    rest = [x for x in events.columns if x not in ("payload", "level", "thread", "logger", "message", "source", "raw", "reason")]
    known = F.coalesce(F.col("family").isin(*FAMILIES), F.lit(False))
    is_json = F.get_json_object("payload", "$").isNotNull()
    reason = F.when(~known, UNKNOWN_FAMILY).when(~is_json, NO_JSON).otherwise(NO_MESSAGE)
    return parsed.select(
        *rest,
        from_epoch_millis(millis, zone).alias("timestamp"),
        either("level").alias("level"),
        either("threadName").alias("thread"),
        either("loggerName").alias("logger"),
        whole.alias("message"),
        F.when(app != "", app).otherwise(REMOTE_APP).alias("source"),
        F.coalesce(whole, F.col("payload")).alias("raw"),
        F.when(message.isNull(), reason).alias("reason"),
    )


def read_structured(events: DataFrame, zone: str = "UTC") -> DataFrame:
    """Structured events (family, payload JSON) to entries; unknown families and broken payloads are left out, see
    :func:`tagged_structured`.

    The ``application`` context property names the source, else ``RemoteApp``; a throwable is appended to
    the message.
    """
    return _read(tagged_structured(events, zone))
